"""Links: extraction (H3), page summary (H2), crawl-form links (H4), link graph
and the per-site link report (the flagship query).

All native Column work on the parsed ``nodes`` array; the only shuffles are the
ones the question needs (link target lookup, per-site totals), and both sides of
the lookup are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.urls import at
from .html import attr_eq, get_text, has_attr, parse_pages, py_strip, select_all, select_first, string_of, tag


def anchors(nodes) -> Column:
    """array<struct<pos, href, text>>: every ``a[href]`` in document order; text is the stripped get_text.
    ``nodes`` is a column name (emitted as SQL text, parsed once) or a Column."""
    if isinstance(nodes, str):
        from ..functions.urls_sql import _v, ident
        from . import nodes_sql as N

        a, i, ns = _v("a"), _v("i"), ident(nodes)
        found = N.select_all(ns, N.all_of(N.tag("a"), N.has_attr("href")))
        return F.expr(f"transform({found}, ({a}, {i}) -> named_struct('pos', {i}, 'href', "
                      f"try_element_at({a}.attrs, 'href'), 'text', {N.py_strip(N.get_text(ns, a))}))")
    return F.transform(
        select_all(nodes, lambda ns, n: tag("a")(ns, n) & has_attr("href")(ns, n)),
        lambda a, i: F.struct(
            i.alias("pos"),
            at(a.attrs, F.lit("href")).alias("href"),
            py_strip(get_text(nodes, a)).alias("text"),
        ),
    )


def extract_links(parsed: DataFrame, url_col: str = "url", nodes_col: str = "nodes") -> DataFrame:
    """H3: one row per ``a[href]`` whose href is non-empty and not a fragment.

    Columns: page_id, src_url, pos, href, url (href joined to the page url), text
    ("(No text)" when empty, first 100 characters), internal (same site, www. ignored).
    """
    return links_from_anchors(parsed.select("page_id", url_col, anchors(nodes_col).alias("anchors")), url_col)


def links_from_anchors(df: DataFrame, url_col: str = "url", anchors_col: str = "anchors") -> DataFrame:
    """H3 from a precomputed ``anchors`` array (see ``anchors``)."""
    kept = F.filter(F.col(anchors_col), lambda a: (a.href != "") & ~a.href.startswith("#"))
    rows = df.select("page_id", F.col(url_col).alias("src_url"), F.explode(kept).alias("a"))
    text = F.when(F.col("a.text") == "", F.lit("(No text)")).otherwise(F.col("a.text"))
    return rows.select(
        "page_id",
        "src_url",
        F.col("a.pos").alias("pos"),
        F.col("a.href").alias("href"),
        U.url_join("src_url", "a.href").alias("url"),
        F.left(text, F.lit(100)).alias("text"),
    ).withColumn("internal", U.same_site("url", "src_url"))


def links_from_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) → links; parse and extract in one map-only stage."""
    return extract_links(parse_pages(pages.select("page_id", "url", "html")))


def summary_columns(nodes: Column) -> list[Column]:
    """H2 columns: title and description."""
    title_node = select_first(nodes, tag("title"))
    desc_node = select_first(nodes, lambda ns, n: tag("meta")(ns, n) & attr_eq("name", "description")(ns, n))
    title = F.when(title_node.isNull(), F.lit("No Title")).otherwise(string_of(nodes, title_node))
    desc = F.coalesce(at(desc_node.attrs, F.lit("content")), F.lit("No description"))
    return [title.alias("title"), desc.alias("description")]


def page_summary(parsed: DataFrame) -> DataFrame:
    """H2: title (``<title>`` string or 'No Title') and meta description (or 'No description')."""
    return parsed.select("page_id", "url", *summary_columns(F.col("nodes")))


def crawl_links(links: DataFrame, scope: str = "origin", start_url: str | None = None,
                drop_fragment: bool = True) -> DataFrame:
    """H4: crawl-form targets of each page: skip '#…'/'javascript:' (F2), keep in-scope
    targets (F4), strip queries (U8), optionally drop fragments, dedup per page.

    scope: 'origin' (same scheme://netloc as the start url, or as the page when no
    start url is given), 'prefix' (the reference's string-prefix test, Q4) or 'any'.
    """
    href = F.col("href")
    out = links.where(~href.startswith("#") & ~href.startswith("javascript:"))
    base = F.lit(start_url) if start_url is not None else F.col("src_url")
    if scope == "origin":
        out = out.where(U.origin("url") == U.origin(base))
    elif scope == "prefix":
        out = out.where(F.col("url").startswith(U.origin(base)))
    target = U.strip_query("url")
    if drop_fragment:
        target = U.drop_fragment(target)
    out = out.withColumn("target", target)
    # first occurrence per (page, target) keeps its position: a grouped min, no sort
    return out.groupBy("page_id", "src_url", "target").agg(F.min("pos").alias("pos"))


def page_keys(pages: DataFrame) -> DataFrame:
    """Distinct url keys (U9) of the corpus with the smallest page_id per key."""
    return pages.select(U.url_key("url").alias("key"), "page_id").groupBy("key").agg(
        F.min("page_id").alias("target_page_id")
    )


def link_graph(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: out-degree, distinct targets, in-degree from other pages, dangling links.

    Edges are first reduced to (page, target key) counts, so a target that a third of
    all pages link to becomes one row per linking page before the shuffle-join.
    """
    edges = links.select("page_id", U.url_key("url").alias("key")).groupBy("page_id", "key").agg(
        F.count("*").alias("n")
    )
    # read by the out- and the in-degree branch: computed (and the pages parsed) once
    keyed = edges.join(page_keys(pages), "key", "left").persist(StorageLevel.MEMORY_AND_DISK)
    out_deg = keyed.groupBy("page_id").agg(
        F.sum("n").alias("out_links"),
        F.count("*").alias("out_targets"),
        F.sum(F.when(F.col("target_page_id").isNull(), F.col("n")).otherwise(0)).alias("dangling_links"),
    )
    in_deg = (
        keyed.where(F.col("target_page_id").isNotNull() & (F.col("target_page_id") != F.col("page_id")))
        .groupBy(F.col("target_page_id").alias("page_id"))
        .agg(F.sum("n").alias("in_links"), F.count("*").alias("in_pages"))
    )
    return (
        pages.select("page_id", "url")
        .join(out_deg, "page_id", "left")
        .join(in_deg, "page_id", "left")
        .select(
            "page_id",
            "url",
            F.coalesce("out_links", F.lit(0)).cast("bigint").alias("out_links"),
            F.coalesce("out_targets", F.lit(0)).cast("bigint").alias("out_targets"),
            F.coalesce("dangling_links", F.lit(0)).cast("bigint").alias("dangling_links"),
            F.coalesce("in_links", F.lit(0)).cast("bigint").alias("in_links"),
            F.coalesce("in_pages", F.lit(0)).cast("bigint").alias("in_pages"),
        )
    )


def link_report(pages: DataFrame) -> DataFrame:
    """Flagship: per site (netloc), pages, links, internal/external, resolved to a corpus
    page, and dangling (internal but not in the corpus)."""
    links = links_from_pages(pages)
    per_target = (
        links.select(U.get_domain("src_url").alias("site"), U.url_key("url").alias("key"), "internal")
        .groupBy("site", "key", "internal")
        .agg(F.count("*").alias("n"))
    )
    keys = page_keys(pages).select("key", F.lit(True).alias("in_corpus"))
    resolved = per_target.join(keys, "key", "left")
    per_site = resolved.groupBy("site").agg(
        F.sum("n").alias("links"),
        F.sum(F.when(F.col("internal"), F.col("n")).otherwise(0)).alias("internal_links"),
        F.sum(F.when(~F.col("internal"), F.col("n")).otherwise(0)).alias("external_links"),
        F.sum(F.when(F.col("in_corpus"), F.col("n")).otherwise(0)).alias("resolved_links"),
        F.sum(F.when(F.col("internal") & F.col("in_corpus").isNull(), F.col("n")).otherwise(0)).alias("dangling_links"),
    )
    site_pages = pages.select(U.get_domain("url").alias("site")).groupBy("site").agg(
        F.count("*").alias("pages")
    )
    return site_pages.join(per_site, "site", "left").select(
        "site",
        "pages",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in
          ("links", "internal_links", "external_links", "resolved_links", "dangling_links")],
    )
