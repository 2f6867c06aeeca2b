"""Operator 3: nearest neighbours by inner product over randomly rotated one-bit codes.

A vector x is centred, rotated by a fixed random rotation and reduced to the signs of its components: packed bits and
two correction scalars (its centred length and the inner product of the code with the direction it stands for). Popcounts of a
query's bit planes against the codes give an estimate of every inner product with an error bound. A vector is reranked
on its original components if its upper bound reaches the k-th largest lower bound; all others cannot belong to
the result unless a bound fails (EPSILON).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, cut

#: Width of the error bound in standard deviations of the estimate; bits of a query's quantised components.
EPSILON, QUERY_BITS = 2.5, 8
#: Vectors and queries in a block; rows that the centre is taken from.
BLOCK_VECTORS, BLOCK_QUERIES, CENTRE_ROWS = 8192, 2048, 10_000
SEED = 7


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (rows of 64-bit words), centred lengths, and the codes' inner products with their directions."""
    rest = (vectors - centre) @ turn.T
    length = np.linalg.norm(rest, axis=1)
    fit = np.abs(rest).sum(axis=1) / np.sqrt(vectors.shape[1]) / np.where(length > 0, length, 1)
    bits = np.packbits(rest > 0, axis=1, bitorder="little")
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
    return np.ascontiguousarray(bits).view(np.uint64), length, np.where(length > 0, fit, 1.0)


def estimate(query: np.ndarray, codes, lengths, fits, ones, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of ``query`` with the coded vectors, and the width of their error bounds."""
    dim = len(query)
    q = turn @ query
    low = q.min()
    step = max((q.max() - low) / ((1 << QUERY_BITS) - 1), 1e-300)
    quantised = np.rint((q - low) / step).astype(np.uint16)
    total = np.zeros(len(codes), np.int64)
    for j in range(QUERY_BITS):
        plane = np.packbits((quantised >> j) & 1, bitorder="little")
        plane = np.pad(plane, (0, -len(plane) % 8)).view(np.uint64)
        total += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << j
    signed = (2 * (low * ones + step * total) - q.sum()) / np.sqrt(dim)
    norm = np.linalg.norm(query)
    spread = np.sqrt(np.maximum(0, 1 - fits**2) / max(1, dim - 1)) * EPSILON * norm + step * np.sqrt(dim)
    return float(query @ centre) + lengths * signed / fits, lengths * spread / fits


def valid(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dim: int | None = None) -> DataFrame:
    """key, v (array<double>): vectors that take part, only those of ``dim`` components (else the commonest length, ties: the longer)."""
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    if dim is not None:
        return v.filter(F.size("v") == dim)
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return v.filter(F.size("v") == (sizes["d"] if sizes else 0))


def _blobs(df: DataFrame, block: str, dim: int) -> DataFrame:
    """One row per block: ids and vectors as binary."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)[order]
        return pa.table({block: table[block].combine_chunks()[:1], "ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([flat.tobytes()], pa.binary())})

    return df.groupBy(block).applyInArrow(run, f"{block} int, ids binary, vectors binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest of ``vectors`` for each row of ``queries``.

    Both have vec_id and embedding; a query is not its own neighbour. Nearness is the inner product of the original
    components in double precision, ties go to the smaller vec_id; all candidates, if fewer than ``k``. Null, zero and
    non-finite vectors take no part; with mixed lengths only the commonest of ``vectors`` does, among the queries too. Of equal vectors only the k + 1 with
    the smallest ids can be among anyone's nearest, so a hot vector is cut to those before the search. Repeated ids count
    once. An empty table gives no rows. Blocks of queries meet blocks of vectors: work is queries x vectors bit
    operations, memory one block of each.
    """
    spark = vectors.sparkSession
    base = cut(valid(vectors).dropDuplicates(["vec_id"]), "search-vectors")
    first = base.first()
    asked = cut(valid(queries, dim=len(first["v"]) if first else 0).dropDuplicates(["vec_id"]), "search-queries")
    sample = bounded_sample(base, 31, CENTRE_ROWS, "vec_id").toPandas()
    if sample.empty or not asked.take(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    data = np.stack(sample["v"].to_numpy())
    dim, centre = data.shape[1], data[np.argsort(sample["vec_id"].to_numpy())].mean(axis=0)
    turn = rotation(dim)
    same = Window.partitionBy("v").orderBy("vec_id")
    base = cut(base.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1).drop("r"), "search-base")
    n_base, n_asked = base.count(), asked.count()
    data_blocks, query_blocks = -(-n_base // BLOCK_VECTORS), -(-n_asked // BLOCK_QUERIES)
    split = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = _blobs(base.withColumn("db", split(data_blocks)), "db", dim).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = _blobs(asked.withColumn("qb", split(query_blocks)), "qb", dim).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(data_blocks - 1))))
    right = right.select("db", "qb", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    both = left.join(right, ["db", "qb"]).repartition("db", "qb")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, q_ids = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("ids", "q_ids"))
                x, qs = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, dim) for c in ("vectors", "q_vectors"))
                codes, lengths, fits = encode(x, centre, turn)
                ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
                out = []
                for q_id, q in zip(q_ids.tolist(), qs, strict=True):
                    middle, width = estimate(q, codes, lengths, fits, ones, centre, turn)
                    other = ids != q_id
                    lower = np.where(other, middle - width, -np.inf)
                    least = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else -np.inf
                    chosen = np.flatnonzero(other & (middle + width >= least))
                    scores = x[chosen] @ q
                    best = np.lexsort((ids[chosen], -scores))[:k]
                    out.append((np.full(len(best), q_id), ids[chosen[best]], scores[best], np.full(len(best), len(chosen))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score", "reranked"])

    found = both.select("ids", "vectors", "q_ids", "q_vectors").mapInArrow(run, "query_id long, vec_id long, score double, reranked long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "reranked")
