"""Skew-safe ordered computations (running totals, first-wins ranking).

A plain ``Window.partitionBy(site).orderBy(seq)`` sends every row of a site to one
task; when one site holds a third of the log that task holds a third of the data.
``running_sums`` splits each group into order-preserving buckets (range partitions
of group and order), computes bucket totals with a map-side combined
aggregation, turns them into per-bucket offsets with a window over the (small)
bucket table, and finishes with a window per (group, bucket).  No task ever holds
more than one bucket of one group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the key columns of ``left`` stay."""
    for i, k in enumerate(keys):
        right = right.withColumnRenamed(k, f"_k{i}")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return left.join(right, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    count_col: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add a running (inclusive) total per ``keys`` in ``order`` for each ``sums``
    entry, and optionally a running row count (``count_col``: 1, 2, 3, …).

    Buckets are the parts of a range partitioning by (keys, order), written to the shared checkpoint folder: they
    follow the number of rows, whatever the values (a burst is split, sparse rows share a part).
    NULL keys are a group of their own, rows with a NULL order come first, a NULL measure adds nothing.
    """
    measures = dict(sums)
    if count_col:
        measures[count_col] = F.lit(1).cast("bigint")
    checkpoint_dir(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df
    for name, expr in measures.items():
        base = base.withColumn(f"_m_{name}", F.coalesce(expr, F.lit(0)))
    base = base.repartitionByRange(n, *keys, *order).withColumn("_b", F.spark_partition_id()).checkpoint()
    totals = base.groupBy(*keys, "_b").agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in measures])
    prior = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(prior), F.lit(0)).alias(f"_o_{n}") for n in measures]
    )
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_null_safe(base, offsets, [*keys, "_b"])
    for n in measures:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.sum(f"_m_{n}").over(within))
    return out.drop("_b", *[f"_m_{n}" for n in measures], *[f"_o_{n}" for n in measures])


def first_wins(df: DataFrame, keys: list[str], order: Column, flag: str = "is_first") -> DataFrame:
    """Mark the first row per ``keys`` by ``order`` (ties → all tied rows would win, so
    ``order`` should be unique, e.g. a sequence number).  A grouped ``min`` (partially
    aggregated map-side) joined back; the join is the only shuffle and AQE splits a
    hot key on the large side."""
    firsts = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    return (
        df.withColumn("_ord", order)
        .join(firsts, keys, "left")
        .withColumn(flag, F.col("_ord") == F.col("_first"))
        .drop("_ord", "_first")
    )


def number_rows(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2, … over all rows in ``order`` (equal rows in any order), without one task seeing them all.

    Rows are range-partitioned and sorted, the parts are written to the shared checkpoint folder (so that their borders
    stay as they are), and each part starts at the number of rows in the parts before it: one number per part goes through
    the driver."""
    checkpoint_dir(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint()
    place = F.spark_partition_id()
    counts = {r.p: r.n for r in parts.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(F.lit(total))
        total += counts.get(p, 0)
    if not starts:
        return parts.withColumn(name, F.lit(0).cast("bigint"))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return parts.withColumn(name, (F.array(*starts)[place] + within).cast("bigint"))


def top_k_per_group(df: DataFrame, keys: list[str], order: list[str], k: int, buckets: int = 64,
                    rank_col: str | None = None) -> DataFrame:
    """The first ``k`` rows per group by ``order`` (unique within a group), skew-safe.

    Phase 1 ranks inside (group, salt bucket) and keeps ≤ k rows per bucket, so a group
    holding a third of the data is spread over ``buckets`` tasks; phase 2 ranks the
    ≤ k × buckets survivors per group.  With no ``keys`` this is a global top-k whose final
    step sees at most k × buckets rows."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(buckets))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    pre = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    w2 = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*order)
    out = pre.drop("_salt", "_r").withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k)
    return out.withColumnRenamed("_r", rank_col) if rank_col else out.drop("_r")
