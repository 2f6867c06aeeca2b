"""Sitemaps (S6, S7, J8, E1, T1): XML parsed by Spark's ``from_xml``, index expansion as
an iterative self-join with an exact global page cap."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .windows import top_k_per_group

URLSET_SCHEMA = "url array<struct<loc:string,lastmod:string,priority:string,changefreq:string>>"
INDEX_SCHEMA = "sitemap array<struct<loc:string>>"


def sitemap_kind(xml) -> Column:
    """Local name of the root element ('urlset', 'sitemapindex', …); prefixes and the prolog skipped."""
    c = F.col(xml) if isinstance(xml, str) else xml
    return F.regexp_extract(c, r"<(?![?!])(?:[\w.-]+:)?([\w.-]+)", 1)


def _locs_any_namespace(c: Column, parent: str) -> Column:
    """Fallback for prefixed names (sm:url/sm:loc): local-name() XPath."""
    return F.xpath(c, F.lit(f"//*[local-name()='{parent}']/*[local-name()='loc']/text()"))


def read_sitemaps(df: DataFrame, xml_col: str = "xml", source_col: str = "sitemap_url") -> DataFrame:
    """One row per <url> of every urlset: source, pos, url, lastmod, priority, changefreq
    (strings, as written) plus typed companions; empty <loc> skipped; the reference's
    defaults for title, description, status and content type."""
    xml = F.col(xml_col)
    # elements of the sitemap namespace may carry a prefix: the one that <…:url> has is taken off every tag
    prefix = F.regexp_extract(xml, r"<([\w.-]+:)url[\s>]", 1)
    plain = F.replace(F.replace(xml, F.concat(F.lit("<"), prefix), F.lit("<")), F.concat(F.lit("</"), prefix), F.lit("</"))
    parsed = F.from_xml(F.when(prefix != "", plain).otherwise(xml), URLSET_SCHEMA, {"mode": "PERMISSIVE"})
    entries = F.coalesce(parsed.url, F.array().cast(URLSET_SCHEMA.split(" ", 1)[1]))
    rows = df.where(sitemap_kind(xml) == "urlset").select(source_col, F.posexplode(entries).alias("pos", "e"))
    loc = F.trim(F.col("e.loc"))
    return rows.where(loc.isNotNull() & (loc != "")).select(
        source_col, "pos", loc.alias("url"), loc.alias("title"), F.lit("").alias("description"),
        F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"),
        F.col("e.lastmod").alias("lastmod"), F.col("e.priority").alias("priority"),
        F.col("e.changefreq").alias("changefreq"),
        F.try_to_timestamp(F.col("e.lastmod")).alias("lastmod_ts"),
        F.col("e.priority").try_cast("double").alias("priority_d"),
    )


_END = re.compile(r"</(?:[\w.-]+:)?$")
_OPEN = re.compile(r"(?s)^.*<(?:[\w.-]+:)?url\s[^>]*>")
_ATTRIBUTES, _PREFIX = re.compile(r"<([\w.:-]+)\s[^>]*?(/?)>"), re.compile(r"(</?)[\w.-]+:")
ENTRY_FIELDS = ("loc", "lastmod", "priority", "changefreq")


def parse_entry(piece: str) -> list[str | None] | None:
    """The fields of the <url> element that ends with a piece of text cut at every ``url>``; None if none does or it is no XML."""
    if not _END.search(piece):
        return None
    body = _OPEN.sub("", _END.sub("", piece))
    try:
        root = ElementTree.fromstring("<url>" + _PREFIX.sub(r"\1", _ATTRIBUTES.sub(r"<\1\2>", body)) + "</url>")
    except ElementTree.ParseError:
        return None
    return [root.findtext(f) for f in ENTRY_FIELDS]


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """S6 from files, split inside: the text source cuts at the tags of <url> elements, whatever their prefix, so one
    (uncompressed) file of any size is read by several tasks and no document is ever one value. Columns as of
    ``read_sitemaps`` but ``pos`` (a row's place in its file is not known to a split). Files need not be well-formed beyond their
    <url> elements; an element that is not gives no row. No job runs before the result is asked for."""

    def run(batches):
        for batch in batches:
            found = [parse_entry(x) for x in batch.column("value").to_pylist()]
            keep = [i for i, f in enumerate(found) if f is not None]
            columns = [pa.array([found[i][k] for i in keep], pa.string()) for k in range(len(ENTRY_FIELDS))]
            yield pa.RecordBatch.from_arrays([batch.column("sitemap_url").take(pa.array(keep, pa.int64())), *columns], ["sitemap_url", *ENTRY_FIELDS])

    pieces = spark.read.option("lineSep", "url>").text(path).select(F.col("_metadata.file_path").alias("sitemap_url"), "value")
    rows = pieces.mapInArrow(run, "sitemap_url string, " + ", ".join(f"{f} string" for f in ENTRY_FIELDS))
    loc = F.trim("loc")
    return rows.where(loc.isNotNull() & (loc != "")).select(
        "sitemap_url", loc.alias("url"), loc.alias("title"), F.lit("").alias("description"), F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"), "lastmod", "priority", "changefreq",
        F.try_to_timestamp(F.col("lastmod")).alias("lastmod_ts"), F.col("priority").try_cast("double").alias("priority_d"))


def index_children(df: DataFrame, xml_col: str = "xml", source_col: str = "sitemap_url") -> DataFrame:
    """Child sitemap locations of every sitemap index: source, pos, child."""
    xml = F.col(xml_col)
    parsed = F.from_xml(xml, INDEX_SCHEMA, {"mode": "PERMISSIVE"})
    prefixed = xml.rlike(r"<[\w.-]+:sitemap[\s>]")
    locs = F.when(prefixed, F.coalesce(_locs_any_namespace(xml, "sitemap"), F.array().cast("array<string>"))).otherwise(
        F.coalesce(F.transform(parsed.sitemap, lambda s: s.loc), F.array().cast("array<string>")))
    rows = df.where(sitemap_kind(xml) == "sitemapindex").select(source_col, F.posexplode(locs).alias("pos", "child"))
    return rows.where(F.col("child").isNotNull() & (F.trim("child") != "")).withColumn("child", F.trim("child"))


def expand_sitemaps(sitemaps: DataFrame, roots: DataFrame, max_pages: int | None = None) -> DataFrame:
    """J8 + E1 + T1: from each root sitemap url, follow indexes to their children to any depth (a sitemap is
    read once per root, on its first path, so cycles end) and return the page urls in order (child by
    child, url by url); with ``max_pages`` exactly that many per root at most (Q14), else all.

    ``sitemaps(sitemap_url, xml)`` is the fetched sitemap table; ``roots(root)``."""
    spark = sitemaps.sparkSession
    checkpoint_dir(spark)
    urls = read_sitemaps(sitemaps).select(F.col("sitemap_url"), "pos", "url", "lastmod", "priority", "changefreq")
    kids = index_children(sitemaps)
    frontier = roots.select(F.col("root"), F.col("root").alias("sitemap_url"), F.array().cast("array<int>").alias("path"))
    seen = frontier.select("root", "sitemap_url")
    found = None
    while True:
        level = frontier.join(urls, "sitemap_url").select(
            "root", "url", F.concat("path", F.array(F.col("pos").cast("int"))).alias("order"),
            "lastmod", "priority", "changefreq")
        found = level if found is None else found.unionByName(level)
        nxt = frontier.join(kids, "sitemap_url").select(
            "root", F.col("child").alias("sitemap_url"), F.concat("path", F.array(F.col("pos").cast("int"))).alias("path"))
        nxt = nxt.groupBy("root", "sitemap_url").agg(F.min("path").alias("path"))
        nxt = nxt.join(seen, ["root", "sitemap_url"], "left_anti").checkpoint()
        if nxt.isEmpty():
            break
        seen = seen.unionByName(nxt.select("root", "sitemap_url")).checkpoint()
        frontier = nxt
    found = found.checkpoint()
    return found if max_pages is None else top_k_per_group(found, ["root"], ["order"], max_pages)
