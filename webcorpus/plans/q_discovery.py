"""Phase 3 queries: crawl frontier, sitemaps, URL exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frontier as FR
from ..operators import sitemap as SM
from ..sources.fixtures import FX_PAGES_SQL, FX_WEB_SQL, fx_pages, fx_sitemap_index, fx_sitemaps, fx_web
from ..sources.tables import load
from . import sqlfrag as S
from .registry import register

_TARGET = f"split_part(CASE WHEN {S.query('url')} <> '' THEN {S.url_key('url')} ELSE url END, '#', 1)"

CRAWL_SQL = f"""
WITH RECURSIVE {FX_PAGES_SQL}, {S.anchors_cte()},
e AS (SELECT page_id, {_TARGET} AS target FROM links WHERE NOT starts_with(href, 'javascript:')),
keys AS (SELECT {S.url_key('url')} AS key, min(page_id) AS page_id FROM pages GROUP BY 1),
bfs(url, depth) AS (
  SELECT url, 0 FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)
  UNION
  SELECT e.target, b.depth + 1
  FROM bfs b JOIN keys k ON k.key = {S.url_key('b.url')} JOIN e ON e.page_id = k.page_id
  WHERE b.depth < (SELECT count(*) FROM pages)),
v AS (SELECT url, min(depth) AS depth FROM bfs GROUP BY url)
SELECT v.url, CAST(v.depth AS INTEGER) AS depth, k.page_id,
       coalesce({S.unescape("regexp_extract(p.html, '<title>([^<]*)</title>', 1)")}, 'No Title') AS title,
       'No description' AS description, 200 AS status_code, 'text/html' AS content_type
FROM v JOIN keys k ON k.key = {S.url_key('v.url')} JOIN pages p ON p.page_id = k.page_id"""


@register("crawl", CRAWL_SQL)
def q_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 (+H4, F2, F4, U8, J7, E4): BFS over the whole corpus from its first page, links
    across hosts followed (scope 'any'), without a budget."""
    pages = fx_pages(spark, sf_dir)
    # the seed: url of the smallest page id (a partial aggregate, one row to the driver)
    start = load(spark, sf_dir, "pages").agg(F.min_by("url", "page_id").alias("u")).first()[0]
    return FR.crawl(pages, start, scope="any").drop("order")


CRAWL_BUDGET_SQL = f"""
WITH RECURSIVE {FX_WEB_SQL}, {S.anchors_cte('fx_web')},
e AS (SELECT l.page_id, {_TARGET.replace('url', 'l.url')} AS target, min(pos) AS pos FROM links l JOIN fx_web w ON w.page_id = l.page_id
      WHERE NOT starts_with(href, 'javascript:') AND status_code IS NOT NULL AND contains(content_type, 'text/html') GROUP BY 1, 2),
keys AS (SELECT {S.url_key('url')} AS key, min(page_id) AS page_id FROM pages GROUP BY 1),
walk(url, depth, place) AS (
  SELECT url, 0, [page_id] FROM pages WHERE page_id < 3
  UNION ALL
  SELECT e.target, w.depth + 1, list_append(w.place, e.pos)
  FROM walk w JOIN keys k ON k.key = {S.url_key('w.url')} JOIN e ON e.page_id = k.page_id WHERE w.depth < 12),
visit AS (SELECT url, depth, place FROM walk QUALIFY row_number() OVER (PARTITION BY url ORDER BY depth, place) = 1),
taken AS (SELECT url, depth, row_number() OVER (ORDER BY depth, place) - 1 AS "order" FROM visit
          QUALIFY row_number() OVER (ORDER BY depth, place) <= 2 * (SELECT count(*) FROM pages))
SELECT t.url, CAST(depth AS INTEGER) AS depth, "order", p.page_id, status_code, content_type,
       coalesce({S.unescape("regexp_extract(p.html, '<title>([^<]*)</title>', 1)")}, 'No Title') AS title, 'No description' AS description
FROM taken t JOIN keys k ON k.key = {S.url_key('t.url')} JOIN fx_web p ON p.page_id = k.page_id
WHERE status_code IS NOT NULL AND contains(content_type, 'text/html')"""


@register("crawl_budget", CRAWL_BUDGET_SQL)
def q_crawl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + T1: BFS from three seeds over pages that answer with errors, other types or not at all, until twice as many visits
    as there are pages are made (in the middle of a level)."""
    pages = load(spark, sf_dir, "pages")
    seeds = pages.where("page_id < 3").select("url", F.col("page_id").alias("seq"))
    return FR.crawl(fx_web(spark, sf_dir), seeds, max_pages=2 * pages.count(), scope="any")


@register(
    "sitemap_urls",
    f"""SELECT split_part(url, '/', 3) AS host, url, url AS title, '' AS description, 200 AS status_code,
       'text/html' AS content_type FROM pages""",
)
def q_sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every <url> of every sitemap file (from_xml)."""
    maps = fx_sitemaps(spark, sf_dir)
    rows = SM.read_sitemaps(maps)
    return rows.join(maps.select("sitemap_url", "host"), "sitemap_url").select(
        "host", "url", "title", "description", "status_code", "content_type")


@register(
    "sitemap_expand",
    """SELECT 'https://' || split_part(url, '/', 3) || '/sitemap_index.xml' AS root, url FROM pages""",
)
def q_sitemap_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + J8 + E1 + T1: expand each host's sitemap index to its page urls (cap above the counts)."""
    sm = fx_sitemap_index(spark, sf_dir)
    roots = sm.where(F.col("sitemap_url").endswith("/sitemap_index.xml")).select(F.col("sitemap_url").alias("root"))
    return SM.expand_sitemaps(sm.select("sitemap_url", "xml"), roots, max_pages=2**31 - 1).select("root", "url")


EXCLUDE = [r"\?utm_source=", r"/(fr|de)/", r"#top$"]


@register(
    "exclude_urls",
    """SELECT page_id, url FROM pages
WHERE NOT (regexp_matches(url, '\\?utm_source=') OR regexp_matches(url, '/(fr|de)/') OR regexp_matches(url, '#top$'))""",
)
def q_exclude_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL exclusion patterns over every page url."""
    return FR.exclude_urls(load(spark, sf_dir, "pages").select("page_id", "url"), EXCLUDE)


_PATTERN = "concat('://', replace({host}, '.', '{dot}'), '/[a-z]+/', page_id % 10)"


@register(
    "exclude_by_table",
    f"""WITH t AS (SELECT DISTINCT {_PATTERN.format(host="split_part(url, '/', 3)", dot=chr(92) + '.')} AS pattern FROM pages)
SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM t WHERE regexp_matches(p.url, t.pattern))""",
)
def q_exclude_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 with a pattern table that grows with the corpus: one pattern per host and last digit of a page id."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    patterns = pages.select(F.expr(_PATTERN.format(host="split_part(url, '/', 3)", dot=chr(92) * 2 + ".")).alias("pattern"))
    return FR.exclude_urls(pages, patterns)
