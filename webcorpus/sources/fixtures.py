"""Derived views that turn the driver tables into the five tables the operators need.

All of them are Spark plans over the given tables (their size grows with the data);
the SQL text of each is kept next to it for the DuckDB oracle.  The modulo
arithmetic below *defines* the derived graph/log (i -> 7i+1 mod n, status by
event id); it is not a sampling filter: every row of the source tables is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import load


def _next_ids(pages: DataFrame) -> DataFrame:
    """page_id → (7 · page_id + 1) mod n, n as an uncorrelated scalar subquery (computed once)."""
    n = pages.select(F.count("*")).scalar()
    return pages.withColumn("next_id", (F.col("page_id") * 7 + 1) % n)


def fx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages plus, inside <article>: a link to page (7i+1) mod n, a PDF link and an image."""
    pages = load(spark, sf_dir, "pages")
    q = pages.select(F.col("page_id").alias("next_id"), F.col("url").alias("q_url"))
    p = _next_ids(pages).join(q, "next_id")
    extra = F.concat(
        F.lit('<a href="'), F.replace(F.col("q_url"), F.lit("&"), F.lit("&amp;")), F.lit('">next</a><a href="/files/'),
        (F.col("page_id") % 9).cast("string"), F.lit('.pdf">doc</a><img src="/img/'), (F.col("page_id") % 20).cast("string"),
        F.lit(".png?v="), (F.col("page_id") % 3).cast("string"), F.lit('"></article>'),
    )
    return p.select("page_id", "url", F.replace(F.col("html"), F.lit("</article>"), extra).alias("html"))


FX_PAGES_SQL = """
fx_pages AS (
  SELECT p.page_id, p.url,
         replace(p.html, '</article>',
           concat('<a href="', replace(q.url, '&', '&amp;'), '">next</a><a href="/files/',
                  CAST(p.page_id % 9 AS VARCHAR), '.pdf">doc</a><img src="/img/', CAST(p.page_id % 20 AS VARCHAR),
                  '.png?v=', CAST(p.page_id % 3 AS VARCHAR), '"></article>')) AS html
  FROM (SELECT page_id, url, html, (page_id * 7 + 1) % (SELECT count(*) FROM pages) AS next_id FROM pages) p
  JOIN pages q ON q.page_id = p.next_id
)"""


def fx_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as visits answer them: links to pages (7i+1) and (3i+2) mod n, to the top, to a script and to a page that
    is missing; some answers are errors, some no HTML, some never come (NULL status)."""
    pages = load(spark, sf_dir, "pages")
    n = pages.select(F.count("*")).scalar()
    q = pages.select(F.col("page_id").alias("q_id"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("q_url"))
    r = pages.select(F.col("page_id").alias("r_id"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("r_url"))
    p = pages.withColumn("q_id", (F.col("page_id") * 7 + 1) % n).withColumn("r_id", (F.col("page_id") * 3 + 2) % n)
    extra = F.concat(F.lit('<a href="'), F.col("q_url"), F.lit('">n</a><a href="#top">t</a><a href="javascript:go()">j</a><a href="'),
                     F.col("r_url"), F.lit('">r</a><a href="/missing/'), (F.col("page_id") % 50).cast("string"), F.lit('">m</a></article>'))
    i = F.col("page_id")
    return p.join(q, "q_id").join(r, "r_id").select(
        "page_id", "url", F.replace("html", F.lit("</article>"), extra).alias("html"),
        F.when(i % 13 == 5, 500).when(i % 17 == 3, F.lit(None)).otherwise(200).cast("int").alias("status_code"),
        F.when(i % 7 == 3, "application/pdf").when(i % 5 == 2, "text/html; charset=utf-8").otherwise("text/html").alias("content_type"))


FX_WEB_SQL = """
fx_web AS (
  SELECT p.page_id, p.url,
         replace(p.html, '</article>',
           concat('<a href="', replace(q.url, '&', '&amp;'), '">n</a><a href="#top">t</a><a href="javascript:go()">j</a><a href="',
                  replace(r.url, '&', '&amp;'), '">r</a><a href="/missing/', CAST(p.page_id % 50 AS VARCHAR), '">m</a></article>')) AS html,
         CAST(CASE WHEN p.page_id % 13 = 5 THEN 500 WHEN p.page_id % 17 = 3 THEN NULL ELSE 200 END AS INTEGER) AS status_code,
         CASE WHEN p.page_id % 7 = 3 THEN 'application/pdf' WHEN p.page_id % 5 = 2 THEN 'text/html; charset=utf-8'
              ELSE 'text/html' END AS content_type
  FROM (SELECT *, (page_id * 7 + 1) % (SELECT count(*) FROM pages) AS q_id, (page_id * 3 + 2) % (SELECT count(*) FROM pages) AS r_id FROM pages) p
  JOIN pages q ON q.page_id = p.q_id JOIN pages r ON r.page_id = p.r_id
)"""

#: Appended to each article: every kind of media reference, of the page's site and of another one, in three quotings.
_MEDIA_PARTS = ('<img src="/img/', "@20", '.png?v=1"><script src=\'/js/a&amp;b.js\'></script><link rel="preload stylesheet" href=/css/site.css>'
                '<video src="/v/', "@5", '.mp4"></video><audio src="//cdn.example.org/a.mp3"></audio><source src="/v/s.webm">'
                '<a href="/files/', "@9", '.pdf">doc</a><a href="/about">about</a><img src="https://other.example/x.png"></article>')


def media_parts(number, text, concat):
    """The appended text: ``text`` of literal parts, ``number`` of page_id modulo a part's number, joined by ``concat``."""
    return concat([number(int(p[1:])) if p.startswith("@") else text(p) for p in _MEDIA_PARTS])


def fx_media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = media_parts(lambda k: (F.col("page_id") % k).cast("string"), F.lit, lambda parts: F.concat(*parts))
    return load(spark, sf_dir, "pages").select("page_id", "url", F.replace("html", F.lit("</article>"), extra).alias("html"))


def fx_fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch log: one row per event, url of page (user_id mod n), status from the event type."""
    pages = load(spark, sf_dir, "pages")
    n = pages.select(F.count("*")).scalar()
    events = load(spark, sf_dir, "events").withColumn("pid", F.col("user_id") % n)
    e = events.join(pages.select(F.col("page_id").alias("pid"), "url"), "pid")
    status = (
        F.when(F.col("event_type") == "error",
               F.when(F.col("event_id") % 5 == 0, 404).when(F.col("event_id") % 5 == 1, 429)
               .when(F.col("event_id") % 5 == 2, 500).when(F.col("event_id") % 5 == 3, 502).otherwise(503))
        .when(F.col("event_type") == "signup", 301).otherwise(200)
    )
    attempt = F.row_number().over(Window.partitionBy("url").orderBy("ts", "event_id"))
    return e.select(
        F.col("event_id").alias("seq"), "ts", "url", status.cast("int").alias("status_code"),
        F.floor(F.abs(F.col("value")) * 1000).cast("bigint").alias("size_bytes"),
        F.when(F.col("event_type") == "purchase", F.lit("application/pdf"))
        .otherwise(F.lit("text/html; charset=utf-8")).alias("content_type"),
        attempt.cast("int").alias("attempt"),
    )


FX_FETCH_LOG_SQL = """
fx_fetch_log AS (
  SELECT e.event_id AS seq, e.ts, p.url,
         CAST(CASE WHEN e.event_type = 'error' THEN
                CASE e.event_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 502 ELSE 503 END
              WHEN e.event_type = 'signup' THEN 301 ELSE 200 END AS INTEGER) AS status_code,
         CAST(floor(abs(e.value) * 1000) AS BIGINT) AS size_bytes,
         CASE WHEN e.event_type = 'purchase' THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
         CAST(row_number() OVER (PARTITION BY p.url ORDER BY e.ts, e.event_id) AS INTEGER) AS attempt
  FROM (SELECT *, user_id % (SELECT count(*) FROM pages) AS pid FROM events) e
  JOIN pages p ON p.page_id = e.pid
)"""


def fx_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown documents with front matter and five kinds of link, one per page."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    q = pages.select(F.col("page_id").alias("next_id"), F.col("url").alias("q_url"))
    p = _next_ids(pages).join(q, "next_id")
    pid = F.col("page_id").cast("string")
    nl = F.lit("\n")
    content = F.concat(
        F.lit("---"), nl, F.lit("title: t"), pid, nl, F.lit("original_url: "), F.col("url"), nl, F.lit("---"), nl, nl,
        F.lit("[next]("), F.col("q_url"), F.lit(") [home](/) ![i](./images/1.png) [ext](https://other.example/"), pid,
        F.lit(") [self](#top)"),
    )
    path = F.concat(F.lit("pages/"), (F.col("page_id") % 4).cast("string"), F.lit("/"), pid, F.lit(".md"))
    return p.select(path.alias("path"), content.alias("content"))


FX_MARKDOWN_SQL = """
fx_markdown AS (
  SELECT concat('pages/', CAST(p.page_id % 4 AS VARCHAR), '/', CAST(p.page_id AS VARCHAR), '.md') AS path,
         concat('---', chr(10), 'title: t', CAST(p.page_id AS VARCHAR), chr(10), 'original_url: ', p.url, chr(10), '---',
                chr(10), chr(10), '[next](', q.url, ') [home](/) ![i](./images/1.png) [ext](https://other.example/',
                CAST(p.page_id AS VARCHAR), ') [self](#top)') AS content
  FROM (SELECT page_id, url, (page_id * 7 + 1) % (SELECT count(*) FROM pages) AS next_id FROM pages) p
  JOIN pages q ON q.page_id = p.next_id
)"""


SITEMAP_MAX_URLS = 50_000  # the sitemap protocol's per-file limit


def fx_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap XML files listing every page url: (host, sitemap_url, xml).

    A host's urls are hashed into ceil(n / 50,000) files, so no file (and no
    ``collect_list`` group) exceeds the protocol's limit, however big one host is."""
    pages = load(spark, sf_dir, "pages").select("url").withColumn("host", F.split("url", "/").getItem(2))
    per_host = pages.groupBy("host").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / F.lit(SITEMAP_MAX_URLS)).cast("bigint")
    keyed = pages.join(per_host, "host").withColumn("chunk", F.pmod(F.xxhash64("url"), chunks))
    locs = F.transform(
        F.array_sort(F.collect_list("url")),
        lambda u: F.concat(F.lit("<url><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")),
    )
    return keyed.groupBy("host", "chunk").agg(
        F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(locs, ""),
                 F.lit("</urlset>")).alias("xml")
    ).select("host", F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap-"), F.col("chunk").cast("string"),
                              F.lit(".xml")).alias("sitemap_url"), "xml")


def fx_sitemap_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sitemap index per host over that host's sitemap files, plus the files themselves:
    (host, sitemap_url, xml); roots are 'https://{host}/sitemap_index.xml'."""
    maps = fx_sitemaps(spark, sf_dir)
    locs = F.transform(F.array_sort(F.collect_list("sitemap_url")),
                       lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>")))
    index = maps.groupBy("host").agg(
        F.concat(F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
                 F.array_join(locs, ""), F.lit("</sitemapindex>")).alias("xml")
    ).select("host", F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap_index.xml")).alias("sitemap_url"), "xml")
    return maps.unionByName(index)
