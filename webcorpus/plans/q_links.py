"""Phase 0 queries: URLs, links, link graph, per-site link report.

Every query reads the driver tables under ``sf_dir`` (or views Spark derives from
them) in full; nothing is sampled or capped unless the cap is the feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.urls import at
from ..operators import links as L
from ..operators.html import parse_pages
from ..sources.fixtures import FX_PAGES_SQL, fx_pages
from ..sources.tables import load
from . import sqlfrag as S

from .registry import register


# ---------------------------------------------------------------------------
# Phase 0: URLs, links, link graph
# ---------------------------------------------------------------------------

LINK_REPORT_SQL = f"""
WITH {FX_PAGES_SQL}, {S.anchors_cte()},
keys AS (SELECT DISTINCT {S.url_key('url')} AS key FROM pages),
l AS (SELECT {S.netloc('src_url')} AS site, {S.url_key('url')} AS key,
             {S.site_key('url')} = {S.site_key('src_url')} AS internal FROM links),
per_site AS (
  SELECT site, count(*) AS links,
         count(*) FILTER (WHERE internal) AS internal_links,
         count(*) FILTER (WHERE NOT internal) AS external_links,
         count(*) FILTER (WHERE k.key IS NOT NULL) AS resolved_links,
         count(*) FILTER (WHERE internal AND k.key IS NULL) AS dangling_links
  FROM l LEFT JOIN keys k ON k.key = l.key GROUP BY site),
site_pages AS (SELECT {S.netloc('url')} AS site, count(*) AS pages FROM fx_pages GROUP BY 1)
SELECT sp.site, sp.pages,
       coalesce(links, 0) AS links, coalesce(internal_links, 0) AS internal_links,
       coalesce(external_links, 0) AS external_links, coalesce(resolved_links, 0) AS resolved_links,
       coalesce(dangling_links, 0) AS dangling_links
FROM site_pages sp LEFT JOIN per_site ps ON ps.site = sp.site
"""


@register("link_report", LINK_REPORT_SQL)
def q_link_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per-site link report over the whole corpus."""
    return L.link_report(fx_pages(spark, sf_dir))


@register(
    "links",
    f"""
WITH {FX_PAGES_SQL}, {S.anchors_cte()}
SELECT page_id, src_url, pos, href, url, text, {S.site_key('url')} = {S.site_key('src_url')} AS internal FROM links
""",
)
def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3 extract_links over every page."""
    return L.links_from_pages(fx_pages(spark, sf_dir))


@register(
    "page_summary",
    f"""
SELECT page_id, url,
       coalesce({S.unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, 'No Title') AS title,
       'No description' AS description
FROM pages
""",
)
def q_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 page summary (title / meta description)."""
    return L.page_summary(parse_pages(load(spark, sf_dir, "pages")))


@register(
    "url_parts",
    f"""
SELECT page_id, url, {S.scheme('url')} AS scheme, {S.netloc('url')} AS netloc, {S.path('url')} AS path,
       {S.query('url')} AS query, {S.fragment('url')} AS fragment, {S.url_key('url')} AS url_key,
       CASE WHEN {S.query('url')} <> '' THEN {S.url_key('url')} ELSE url END AS stripped,
       replace({S.netloc('url')}, '.', '_') AS site_folder, {S.site_key('url')} AS site,
       {S.path('url')} || CASE WHEN {S.query('url')} <> '' THEN '?' || {S.query('url')} ELSE '' END
         || CASE WHEN {S.fragment('url')} <> '' THEN '#' || {S.fragment('url')} ELSE '' END AS relative
FROM pages
""",
)
def q_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U4, U7, U8, U9, U13, site key."""
    p = load(spark, sf_dir, "pages").select("page_id", "url")
    s = U.url_split("url")
    return p.select(
        "page_id",
        "url",
        s.scheme.alias("scheme"),
        s.netloc.alias("netloc"),
        s.path.alias("path"),
        s.query.alias("query"),
        s.fragment.alias("fragment"),
        U.url_key("url").alias("url_key"),
        U.strip_query("url").alias("stripped"),
        U.site_folder("url").alias("site_folder"),
        U.site_key("url").alias("site"),
        U.to_relative("url", U.origin("url")).alias("relative"),
    )


def _sql_trim_slash(p: str) -> str:
    return f"trim({p}, '/')"


_P = _sql_trim_slash(S.path("url"))
_LAST = f"regexp_extract({_P}, '([^/]*)$', 1)"
_MIRROR = (
    f"CASE WHEN {_P} = '' THEN replace({S.netloc('url')}, '.', '_') || '_index.html' "
    f"WHEN {_LAST} LIKE '%.%' THEN {_P} ELSE {_P} || '.html' END"
)
_SLUG_STEPS = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_P}, '^(blog|posts|articles|news)/', ''), "
    f"'^\\d{{4}}/\\d{{2}}/\\d{{2}}/', ''), '/+$', ''), '\\.(html|php|asp)$', '')"
)
_SLUG = f"regexp_extract({_SLUG_STEPS}, '([^/]*)$', 1)"


def _sql_sanitize(x: str) -> str:
    f = f"regexp_replace({x}, '[<>:\"/\\\\|?*]', '_', 'g')"
    stem = f"coalesce(nullif(regexp_extract({f}, '^(\\.*[^.].*)\\.[^.]*$', 1), ''), {f})"
    reserved = "('CON','PRN','AUX','NUL','COM1','COM2','COM3','COM4','COM5','COM6','COM7','COM8','COM9'," \
               "'LPT1','LPT2','LPT3','LPT4','LPT5','LPT6','LPT7','LPT8','LPT9')"
    pref = f"CASE WHEN upper({stem}) IN {reserved} THEN '_' || {f} ELSE {f} END"
    cut = f"regexp_replace({pref}, '[. ]+$', '')"
    return f"coalesce(nullif({cut}, ''), 'unnamed')"


_NAME = _sql_sanitize(
    f"regexp_replace(CASE WHEN {_SLUG} <> '' THEN {_SLUG} WHEN {_P} = '' THEN 'index' ELSE {_LAST} END, "
    f"'\\.(html|php|asp)$', '')"
)
_MDNAME = f"CASE WHEN {_NAME} LIKE '%.md' THEN {_NAME} ELSE {_NAME} || '.md' END"
_MDPATH = f"CASE WHEN {_P} LIKE '%/%' THEN regexp_extract({_P}, '^(.*)/[^/]*$', 1) || '/' || {_MDNAME} ELSE {_MDNAME} END"
_FN = f"translate(replace({S.netloc('url')} || {S.path('url')}, '://', '_'), '/.?&= %', '_______')"
_REC = f"replace({S.netloc('url')} || '_' || CASE WHEN {_P} = '' THEN 'index' ELSE {_LAST} END || '.json', '.', '_')"


@register(
    "url_paths",
    f"""
SELECT page_id,
       'page_' || CASE WHEN length({_FN}) > 200 THEN left({_FN}, 100) || '_' || left(md5(url), 16) ELSE {_FN} END
         || '.html' AS filename,
       {_MIRROR} AS mirror_path,
       regexp_extract({_MIRROR}, '^(.*/)?[^/]*$', 1)
         || coalesce(nullif(regexp_extract(regexp_extract({_MIRROR}, '([^/]*)$', 1), '^(\\.*[^.].*)\\.[^.]*$', 1), ''),
                     regexp_extract({_MIRROR}, '([^/]*)$', 1)) || '_meta.json' AS metadata_path,
       {_SLUG} AS slug,
       {_MDPATH} AS markdown_path,
       CASE WHEN length({_REC}) > 100 THEN left({_REC}, 95) || '_' || CAST(page_id AS VARCHAR) || '.json'
            ELSE {_REC} END AS record_filename,
       {_sql_sanitize(_LAST)} AS safe_name
FROM pages
""",
)
def q_url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U10-U12, U14, U15, U17, U18 over every page url."""
    p = load(spark, sf_dir, "pages").select("page_id", "url")
    last = at(F.split(F.regexp_replace(U.url_split("url").path, r"^/+|/+$", ""), "/"), -1)
    mirror = U.mirror_path("url")
    return p.select(
        "page_id",
        U.url_to_filename("url").alias("filename"),
        mirror.alias("mirror_path"),
        U.metadata_path(mirror).alias("metadata_path"),
        U.slug("url").alias("slug"),
        U.markdown_path("url", U.slug("url")).alias("markdown_path"),
        U.record_filename("url", F.col("page_id")).alias("record_filename"),
        U.sanitize_filename(last).alias("safe_name"),
    )


@register(
    "link_graph",
    f"""
WITH {FX_PAGES_SQL}, {S.anchors_cte()},
keys AS (SELECT {S.url_key('url')} AS key, min(page_id) AS target_page_id FROM fx_pages GROUP BY 1),
e AS (SELECT l.page_id, k.target_page_id FROM links l LEFT JOIN keys k ON k.key = {S.url_key('l.url')}),
o AS (SELECT page_id, count(*) AS out_links,
             count(DISTINCT coalesce(CAST(target_page_id AS VARCHAR), 'x')) AS t1,
             count(*) FILTER (WHERE target_page_id IS NULL) AS dangling_links FROM e GROUP BY 1),
ot AS (SELECT page_id, count(*) AS out_targets FROM
        (SELECT DISTINCT l.page_id, {S.url_key('l.url')} AS key FROM links l) GROUP BY 1),
i AS (SELECT target_page_id AS page_id, count(*) AS in_links, count(DISTINCT page_id) AS in_pages
      FROM e WHERE target_page_id IS NOT NULL AND target_page_id <> page_id GROUP BY 1)
SELECT p.page_id, p.url, coalesce(out_links, 0) AS out_links, coalesce(out_targets, 0) AS out_targets,
       coalesce(dangling_links, 0) AS dangling_links, coalesce(in_links, 0) AS in_links,
       coalesce(in_pages, 0) AS in_pages
FROM fx_pages p LEFT JOIN o ON o.page_id = p.page_id LEFT JOIN ot ON ot.page_id = p.page_id
LEFT JOIN i ON i.page_id = p.page_id
""",
)
def q_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 in/out degree and dangling links per page."""
    pages = fx_pages(spark, sf_dir)
    return L.link_graph(L.links_from_pages(pages), pages)
