"""Operator 10: mixing sources to target weights (native DataFrame operations only).

Sizes are added up per source, targets follow from the weights, and each document is emitted floor(rate) times plus
one copy more with probability equal to the fraction, drawn from a hash of its id (so reruns agree).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: No source and no document is repeated more often than this.
MOST = 3


def copies_draw(doc_id: str, seed: int) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of md5('seed:id'); a null id counts as ''."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def source_targets(sizes: DataFrame, weights: tuple = (1, 2, 3), share: float = 1.0, most: int = MOST) -> DataFrame:
    """Per source of ``sizes`` (source, size): source_size and target.

    Sources in code point order, null last, get the weights in turn. Their targets share ``share`` of all sizes by
    weight; a target stops at ``most`` times its source's size and the excess goes to the others by weight until none
    is above. That fixed point is found in closed form: sources are capped in order of size per weight, and the
    first prefix whose remaining level no next source would exceed is the capped set. The windows run over one row
    per source, after aggregation.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # the level (words per weight) if exactly the sources before this one are capped
        .withColumn("level", (share * F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    )
    free = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("level", F.min(F.when(free, F.struct(F.col("weight_before").alias("o"), F.col("level").alias("l")))).over(everything)["l"])
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap"))
    return per.select("source", "source_size", target.alias("target"))


def mixed_sizes(documents: DataFrame, seed: int = 0, weights: tuple = (1, 2, 3), share: float = 1.0) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, n_copies.

    Null text has size 0; a null source is a source of its own; a source without words has target 0 and its documents
    are not taken. Repeated rows draw alike, as the draw depends on doc_id alone. Other columns are ignored.
    """
    sizes = cut(documents.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sizes, weights, share).withColumnRenamed("source", "mix_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(F.lit(0.0))
    extra = (copies_draw("doc_id", seed) < rate - F.floor(rate)).cast("int")
    return sizes.join(targets, F.col("source").eqNullSafe(F.col("mix_source"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.floor(rate).cast("int") + extra).alias("n_copies")
    )


def mix(documents: DataFrame, seed: int = 0, weights: tuple = (1, 2, 3), share: float = 1.0) -> DataFrame:
    """The mixed documents: every row of ``documents`` as often as the mix takes it, with its own columns only."""
    names = documents.columns
    sizes = documents.select("source", n_words(F.col("text")).alias("size"))
    targets = cut(source_targets(sizes, weights, share), "mix-targets").select(
        F.col("source").alias("__mix_source"), F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0).alias("__mix_rate")
    )
    rate = F.col("__mix_rate")
    extra = (copies_draw("doc_id", seed) < rate - F.floor(rate)).cast("int")
    times = (F.floor(rate).cast("int") + extra).alias("__mix_times")
    taken = documents.join(targets, F.col("source").eqNullSafe(F.col("__mix_source"))).select(*names, times).filter("__mix_times > 0")
    return taken.select(*names, F.explode(F.sequence(F.lit(1), F.col("__mix_times"))).alias("__mix_copy")).select(*names)
