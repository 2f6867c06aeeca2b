"""Link validation and repair over a Markdown corpus.

Input: ``docs(path, content)``.  The pages map (original_url → path) is built from the
front matter; links are joined to it by key.  ``resolve=True`` (default) resolves each
link against the document's own original_url and joins on url keys (Q9); ``resolve=False``
is the reference's literal string equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import urls_sql as US
from .markdown import MD_LINK_RE, md_links, parse_front_matter


def _unquote(c: Column) -> Column:
    """Q9: strip surrounding quotes and angle brackets."""
    return F.regexp_replace(c, r"^[\"'<]+|[\"'>]+$", "")


def is_external(url) -> Column:
    """scheme http/https (Python urlsplit rules) → external."""
    return U.url_split(url).scheme.isin("http", "https")


def pages_map(docs: DataFrame, resolve: bool = True) -> DataFrame:
    """original_url → path (the greatest path wins when two files claim one URL)."""
    m = docs.select("path", parse_front_matter(F.col("content")).alias("original_url")).where(
        F.col("original_url").isNotNull() & (F.col("original_url") != ""))
    if resolve:
        m = m.withColumn("original_url", _unquote(F.col("original_url")))
    key = U.url_key("original_url") if resolve else F.col("original_url")
    return m.withColumn("key", key).groupBy("key").agg(
        F.max_by("original_url", "path").alias("original_url"), F.max("path").alias("target_path"))


def find_links(docs: DataFrame, resolve: bool = True) -> DataFrame:
    """M8 + F10/F11 per document: every [text](url) with its kind:
    'image' (./images/…), 'md' (already a relative .md path), 'anchor' (#… in resolve mode),
    'external' (http/https) or 'internal'."""
    base = parse_front_matter(F.col("content"))
    rows = docs.select("path", _unquote(base).alias("doc_url"), F.explode(md_links(F.col("content"))).alias("l"))
    url = F.col("l.url")
    kind = (
        F.when(url.startswith("./images/"), F.lit("image"))
        .when(url.endswith(".md") & (url.contains("/") | url.contains("\\")), F.lit("md"))
    )
    if resolve:
        kind = kind.when(url.startswith("#"), F.lit("anchor"))
    kind = kind.when(is_external("l.url"), F.lit("external")).otherwise(F.lit("internal"))
    if resolve:
        rows = rows.withColumn("_base", F.coalesce(F.col("doc_url"), F.lit(""))).withColumn("_href", _unquote(url))
        key = F.expr(US.url_key(US.url_join("`_base`", "`_href`", U.USES_RELATIVE, U.USES_NETLOC)))
    else:
        key = url
    return rows.select("path", F.col("l.pos").alias("pos"), F.col("l.text").alias("text"), url.alias("url"),
                       kind.alias("kind"), key.alias("key"))


def validate_links(docs: DataFrame, resolve: bool = True, map_df: DataFrame | None = None) -> DataFrame:
    """J4 (+J5): each link with status 'fixed' (its target is a corpus page; ``to`` is the path
    relative to the linking file, U19), 'broken' (internal, not in the corpus), 'external',
    or skipped ('image', 'md', 'anchor').  In resolve mode an absolute link to a corpus page is
    fixable too.  The map side has one row per key; AQE broadcasts it when it is small."""
    links = find_links(docs, resolve)
    m = (map_df if map_df is not None else pages_map(docs, resolve)).select("key", "target_path")
    j = links.join(m, "key", "left")
    eligible = F.col("kind").isin("internal", "external") if resolve else (F.col("kind") == "internal")
    status = (
        F.when(eligible & F.col("target_path").isNotNull(), F.lit("fixed"))
        .when(F.col("kind") == "internal", F.lit("broken"))
        .otherwise(F.col("kind"))
    )
    from_dir = U.dirname(F.col("path"))
    to = F.when(status == "fixed", U.relative_path(F.col("target_path"), from_dir))
    return j.select("path", "pos", "text", "url", "kind", status.alias("status"), to.alias("to"))


def broken_links(docs: DataFrame, resolve: bool = True) -> DataFrame:
    """Internal links with no page (left anti join against the map)."""
    links = find_links(docs, resolve).where(F.col("kind") == "internal")
    return links.join(pages_map(docs, resolve).select("key"), "key", "left_anti").select("path", "url", "text")


def fix_links(docs: DataFrame, resolve: bool = True) -> DataFrame:
    """Documents with fixed link targets replaced by relative paths.

    The text between matches (``split`` on the link pattern) is zipped with the rebuilt
    links, so no offsets are needed; fixes are collected per document (bounded by that
    document's own links) and joined back by path."""
    v = validate_links(docs, resolve)
    fixes = v.where(F.col("status") == "fixed").groupBy("path").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "to"))).alias("_fix"))
    c = F.col("content")
    gaps = F.split(c, MD_LINK_RE, -1)
    links = md_links(c)
    rebuilt = F.transform(
        links,
        lambda l: F.concat(F.lit("["), l.text, F.lit("]("),
                           F.coalesce(U.at(F.col("_fix"), l.pos), l.url), F.lit(")")),
    )
    body = F.concat(
        U.at(gaps, 1),
        F.array_join(F.zip_with(rebuilt, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(1))),
                                lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""),
    )
    return docs.join(fixes, "path", "left").select(
        "path", F.when(F.col("_fix").isNull(), c).otherwise(body).alias("content"),
        F.coalesce(F.size("_fix"), F.lit(0)).alias("fixed"))


def validation_summary(docs: DataFrame, resolve: bool = True) -> DataFrame:
    """A7 as (metric, value) rows: pages mapped, files with internal links, external,
    fixed and broken links: one aggregate over the map, one over the validated links."""
    from .report import metrics

    v = validate_links(docs, resolve)
    mapped = metrics(pages_map(docs, resolve), {"pages_mapped": F.count("*")})
    counts = metrics(v, {
        "files_with_internal_links": F.count_distinct(F.when(F.col("kind") == "internal", F.col("path"))),
        "external_links": F.count_if(F.col("kind") == "external"),
        "fixed_links": F.count_if(F.col("status") == "fixed"),
        "broken_links": F.count_if(F.col("status") == "broken"),
    })
    return mapped.unionByName(counts)
