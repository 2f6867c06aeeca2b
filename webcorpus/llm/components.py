"""Connected components of a link table, by alternating star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b: long): the least id that links reach, itself included.

    Large-star and small-star steps in turn; every step keeps components as they are and shortens paths, until each id
    points to its least one. A hub with many links is aggregated before it is joined. Ids without links are not listed.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct(), "cc")
    mark = None
    while True:  # the steps only shorten paths, so they end
        # large star: of each id, all larger neighbours are tied to the least of it and its neighbours
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        # small star: of each id, all smaller neighbours and itself are tied to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
        edges = cut(small.select("e.*").filter("u < v").distinct(), "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("u").alias("id")).distinct().join(edges.select(F.col("v").alias("id")), "id", "left_anti")
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).union(roots.select("id", F.col("id").alias("component")))
