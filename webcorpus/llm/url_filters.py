"""Operator 1: URL filters as a temporal list join.

Dated list entries (add, remove) become validity intervals per list and pattern; an as-of join evaluates every capture
against the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import narrowed

#: A pattern is ``example.com`` (the host and all hosts below it) or ``host/a/b`` (that path and all below it).
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
#: Hosts that are addresses: no other host lies above them.
ADDRESS = r"^(\[.*\]|\d+\.\d+\.\d+\.\d+)$"
PATH = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, without a dot at its end; an IPv6 address with its brackets."""
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def patterns_of(url: Column) -> Column:
    """All patterns that would match a URL: its host's suffixes, and its host with each leading part of its path."""
    host = host_of(url)
    parts = F.split(host, "\\.")
    steps = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    suffixes = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), F.size(steps)), lambda i: i > 0), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, since, until (exclusive; null: still listed) from entries (list, pattern, action, at).

    Of entries of one list, pattern and time a removal wins; repeated additions go on with the interval that runs. Rows
    with a null list, pattern or time, and actions other than add and remove, are ignored.
    """
    known = entries.select("list", F.lower("pattern").alias("pattern"), "at", "action").filter("action IN ('add', 'remove')").dropna()
    known = known.groupBy("list", "pattern", "at").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("off"))
    order = Window.partitionBy("list", "pattern").orderBy("at")
    turns = known.withColumn("was_off", F.lag("off", 1, 1).over(order)).filter("off != was_off")
    turns = turns.withColumn("until", F.lead("at").over(order))
    return turns.filter("off = 0").select("list", "pattern", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (capture_id, url, fetched): blocked, n_active, and the first active entry.

    n_active counts the (list, pattern) pairs active at ``fetched``; list, pattern and since are of the first of them in
    order of (list, pattern). Null or unparsable URLs and null times match nothing. Captures with one id are evaluated
    together; other columns are ignored. Addresses match themselves only, a dot at a host's end is ignored. Keys of captures are narrow (id,
    pattern, time) when they are joined, and those whose hash bucket no pattern of the lists has (such as ``com``) are dropped before;
    intervals of one list and pattern never overlap, so a capture meets each list entry once at most, and Spark may split a hot host.
    """
    keys = captures.select("capture_id", "fetched", F.explode(patterns_of(F.col("url"))).alias("pattern")).filter("fetched IS NOT NULL")
    valid = intervals(entries)
    active = (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    hits = narrowed(keys, "pattern", valid).join(valid, "pattern").filter(active).select("capture_id", F.struct("list", "pattern", "since").alias("hit"))
    every = captures.select("capture_id", F.lit(None).cast(dict(hits.dtypes)["hit"]).alias("hit"))
    per = every.unionByName(hits).groupBy("capture_id").agg(F.min("hit").alias("first"), F.count("hit").alias("n_active"))
    return per.select("capture_id", (F.col("n_active") > 0).alias("blocked"), "n_active", F.col("first.list").alias("list"), F.col("first.pattern").alias("pattern"), F.col("first.since").alias("since"))
