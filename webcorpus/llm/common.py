"""Helpers shared by the operators: the shared folder, word rules, Arrow batches, bounded samples, logistic fits."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.session import checkpoint_dir

_C = ctypes.CDLL(None)
#: Characters that part words (ASCII blanks only), as a regex class and as text.
SPACE_CLASS = r"[\\x20\\x09-\\x0D]"
#: Hash buckets of ``narrowed``: at most so many numbers are broadcast.
BUCKETS = 1 << 20
SPACES = " \t\n\x0b\x0c\r"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The rows are computed once, the lineage ends there, and any executor can read them again after a loss. The table
    stays until ``spark.checkpoint.dir`` is cleared.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrowed(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in ``keys``, found before any shuffle.

    Keys are reduced to BUCKETS hash buckets, so what is broadcast is bounded whatever the number of keys; with many
    more keys than buckets it only saves less. A join on the key itself has to follow.
    """
    bucket = F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")
    return df.withColumn("__bucket", bucket).join(F.broadcast(keys.select(bucket.alias("__bucket")).distinct()), "__bucket", "left_semi").drop("__bucket")


def remainder(doc_id: str, modulus: int) -> str:
    """SQL: crc32 of the id as text, modulo ``modulus`` (the fold of a row; a null id falls in fold 0)."""
    return f"coalesce(crc32(cast({doc_id} AS STRING)) % {modulus}, 0)"


def let(value: Column, body) -> Column:
    """``body`` applied to ``value`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of characters other than ASCII blanks; an empty array for null, empty or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def free_memory() -> None:
    """Give memory that is free now back to the system: workers live on from stage to stage, and each would keep its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_C, "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of ``column`` (at least one row), so that memory is bounded; it is
    given back after the last one."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)
        del batch
    free_memory()


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of every text, in one array, and the row offsets into it (blank strings at the ends of texts are kept)."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.flatten()


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]] of every i, joined."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
    return values[index]


def hash_share(doc_id: str, seed: int, share: float) -> Column:
    """True for about ``share`` of all ids, the same ones in every run."""
    return F.expr(f"pmod(xxhash64({doc_id}, {seed}), 1000000)") < int(min(1.0, share) * 1_000_000)


def bounded_sample(df: DataFrame, seed: int, bound: int, key: str = "doc_id") -> DataFrame:
    """All rows of ``df`` if there are at most ``bound``, else about ``bound`` of them chosen by a hash of the key."""
    n = df.count()
    return df if n <= bound else df.filter(hash_share(key, seed, bound / n))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Ridge-penalised logistic regression on standardised columns (damped Newton); coefficients for the raw columns.

    The intercept is last and almost unpenalised.
    """
    x = np.asarray(x, float).reshape(len(y), -1)
    y, w = np.asarray(y, float), np.ones(len(y)) if weight is None else np.asarray(weight, float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-12] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(y), 1))])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-3)

    def loss(b: np.ndarray) -> float:
        t = z @ b
        return float(w @ (np.logaddexp(0, t) - y * t) + 0.5 * penalty @ (b * b))

    beta, now = np.zeros(z.shape[1]), loss(np.zeros(z.shape[1]))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (w * (y - p)) - penalty * beta)
        size = 1.0
        while (after := loss(beta + size * step)) > now and size > 1e-6:
            size /= 2
        beta, gain, now = beta + size * step, now - after, min(now, after)
        if gain < 1e-9:
            break
    raw = beta[:-1] / scale
    return np.append(raw, beta[-1] - raw @ mean)


def logistic(columns: list[Column], beta) -> Column:
    z = F.lit(float(beta[-1]))
    for c, b in zip(columns, beta[:-1], strict=True):
        z = z + c * F.lit(float(b))
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
