"""Phase 1 queries: media references and their download outcome, content dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import media as M
from ..operators.html import parse_pages
from ..operators import rewrite as RW
from ..operators.links import extract_links
from ..sources import sinks as SK
from ..sources.fixtures import FX_PAGES_SQL, fx_media_pages, fx_pages, media_parts
from ..sources.tables import load
from . import sqlfrag as S
from .registry import register

_DOC_EXT = ", ".join(f"'{e}'" for e in M.DOCUMENT_EXTENSIONS)
_IMG_EXT = ", ".join(f"'{e}'" for e in M.IMAGE_EXTENSIONS)

MEDIA_CTE = f"""
{FX_PAGES_SQL},
raw AS (
  SELECT page_id, url AS src_url,
         regexp_extract_all(html, '<img src="([^"]*)"', 1) AS imgs,
         regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs
  FROM fx_pages),
imgs AS (SELECT page_id, src_url, 'img' AS kind, unnest(range(len(imgs))) AS i, unnest(imgs) AS ref FROM raw),
anchors AS (SELECT page_id, src_url, unnest(range(len(hrefs))) AS i, replace(unnest(hrefs), '&amp;', '&') AS ref FROM raw),
docs AS (
  SELECT page_id, src_url, 'document' AS kind, i,
         CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN ref ELSE {S.origin('src_url')} || ref END AS ref
  FROM anchors WHERE ref <> ''),
all_refs AS (
  SELECT page_id, src_url, kind, 0 AS grp, i, {S.origin('src_url')} || ref AS url FROM imgs WHERE ref <> ''
  UNION ALL
  SELECT page_id, src_url, kind, 1 AS grp, i, ref AS url FROM docs
  WHERE lower(regexp_extract(regexp_extract(split_part(ref, '?', 1), '([^/]*)$', 1), '^\\.*[^.].*(\\.[^.]*)$', 1))
        IN ({_DOC_EXT})),
media AS (
  SELECT page_id, src_url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY grp, i) - 1 AS INTEGER) AS pos,
         kind, url FROM all_refs),
st AS (
  SELECT *, {S.site_key('url')} = {S.site_key('src_url')} AS same_site, {S.url_key('url')} AS url_key,
         replace({S.netloc('url')}, '.', '_') AS site,
         CASE WHEN trim({S.path('url')}, '/') = '' THEN NULL ELSE trim({S.path('url')}, '/') END AS file_path,
         page_id * 1000000 + pos AS ord
  FROM media),
kf AS (SELECT url_key, min(ord) AS key_first FROM st WHERE same_site GROUP BY 1),
pf AS (SELECT site, file_path, min(ord) AS path_first FROM st JOIN kf USING (url_key)
       WHERE same_site AND ord = key_first GROUP BY 1, 2),
status AS (
  SELECT st.*, CASE WHEN NOT same_site THEN NULL WHEN ord > key_first THEN 'exists'
                    WHEN ord > path_first THEN 'skipped' ELSE 'downloaded' END AS status
  FROM st LEFT JOIN kf USING (url_key) LEFT JOIN pf USING (site, file_path))"""


@register(
    "media",
    f"""WITH {MEDIA_CTE}
SELECT page_id, src_url, pos, kind, url, same_site, url_key, site, file_path, status,
       regexp_extract(lower(regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1)), '^\\.*[^.].*\\.([^.]*)$', 1)
         IN ({_IMG_EXT}) AS allowed_image
FROM status""",
)
def q_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every media reference with its download outcome."""
    st = M.media_status(M.extract_media(parse_pages(fx_pages(spark, sf_dir))))
    return st.select(
        "page_id", "src_url", "pos", "kind", "url", "same_site", "url_key", "site", "file_path", "status",
        M.allowed_image(F.col("url")).alias("allowed_image"),
    )


@register(
    "media_summary",
    f"""WITH {MEDIA_CTE}
SELECT page_id, count(*) AS total, count(status) AS downloaded,
       count(*) FILTER (WHERE status = 'downloaded') AS new_files, count(*) FILTER (WHERE status = 'exists') AS "exists",
       count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE NOT same_site) AS external
FROM status GROUP BY page_id""",
)
def q_media_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 per page."""
    return M.media_summary(M.media_status(M.extract_media(parse_pages(fx_pages(spark, sf_dir)))))


_NUMBER = "CAST(page_id % {k} AS VARCHAR)"
_EXTRA = media_parts(lambda k: _NUMBER.format(k=k), lambda p: "'" + p.replace("'", "''") + "'", " || ".join)
_MIRROR_DIR = f"""(CASE WHEN trim({S.path('url')}, '/') = '' THEN '' ELSE regexp_extract(trim({S.path('url')}, '/'), '^(.*)/[^/]*$', 1) END)"""


_PATH = f"trim({S.path('url')}, '/')"
_MIRROR = f"""CASE WHEN {_PATH} = '' THEN replace({S.netloc('url')}, '.', '_') || '_index.html'
  WHEN regexp_extract({_PATH}, '([^/]*)$', 1) LIKE '%.%' THEN {_PATH} ELSE {_PATH} || '.html' END""".replace("(url", "(p.url")


@register(
    "rewritten_pages",
    f"""
WITH f AS (SELECT page_id, url, html, repeat('../', CASE WHEN {_MIRROR_DIR} = '' THEN 1
             ELSE 2 + length({_MIRROR_DIR}) - length(replace({_MIRROR_DIR}, '/', '')) END) || 'media/' AS m FROM pages)
SELECT page_id, url, 8 AS "references", 6 AS rewritten,
  replace(html, '</article>',
    '<img src="' || m || 'img/' || {_NUMBER.format(k=20)} || '.png"><script src="' || m || 'js/a&amp;b.js"></script>'
    || '<link rel="preload stylesheet" href="' || m || 'css/site.css"><video src="' || m || 'v/' || {_NUMBER.format(k=5)} || '.mp4"></video>'
    || '<audio src="//cdn.example.org/a.mp3"></audio><source src="' || m || 'v/s.webm"><a href="' || m || 'files/' || {_NUMBER.format(k=9)}
    || '.pdf">doc</a><a href="/about">about</a><img src="https://other.example/x.png"></article>') AS html
FROM f""",
)
def q_rewritten_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8, H10 (+F6, F7, U16, U19): every page with its same-site media references pointing to local files."""
    return RW.rewrite_media_refs(fx_media_pages(spark, sf_dir))


@register(
    "content_dedup",
    """
WITH h AS (SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS size FROM documents),
o AS (SELECT content_hash, min(doc_id) AS original, count(*) AS copies FROM h GROUP BY 1)
SELECT h.doc_id, h.content_hash, h.size, o.original, o.copies, h.doc_id <> o.original AS is_duplicate
FROM h JOIN o USING (content_hash)""",
)
def q_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 exact-content dedup over the whole documents table."""
    return M.content_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select(
        "doc_id", "content_hash", F.col("size").cast("bigint").alias("size"), "original", "copies", "is_duplicate"
    )


def _title_sql() -> str:
    t = f"trim({S.unescape(chr(39).join(['regexp_extract(html, ', '<title>([^<]*)</title>', ', 1)']))})"
    for sep in X.TITLE_SEPARATORS:
        t = f"(CASE WHEN contains({t}, '{sep}') THEN trim(split_part({t}, '{sep}', 1)) ELSE {t} END)"
    h1 = f"trim({S.unescape(chr(39).join(['regexp_extract(html, ', '<h1>([^<]*)</h1>', ', 1)']))})"
    return f"coalesce(nullif({t}, ''), {h1})"


@register(
    "metadata",
    f"""
SELECT page_id, url, {_title_sql()} AS title, '' AS excerpt, '' AS date_published, '' AS date_modified,
       '' AS author, '' AS categories, '' AS tags, '' AS featured_image, 'post' AS content_type,
       regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({S.path('url')}, '/'),
         '^(blog|posts|articles|news)/', ''), '^\\d{{4}}/\\d{{2}}/\\d{{2}}/', ''), '/+$', ''), '\\.(html|php|asp)$', ''),
         '([^/]*)$', 1) AS slug
FROM pages""",
)
def q_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H11-H20 article metadata for every page (lists joined with '|' for the comparison)."""
    md = X.extract_metadata(parse_pages(load(spark, sf_dir, "pages")), with_timestamp=False)
    return md.withColumn("categories", F.array_join("categories", "|")).withColumn("tags", F.array_join("tags", "|"))


@register(
    "page_metadata",
    f"""WITH {MEDIA_CTE}, {S.anchors_cte()},
l AS (SELECT page_id, count(*) AS n_links, string_agg(url || ' ' || text, '|' ORDER BY pos) AS links FROM links GROUP BY 1),
m AS (SELECT page_id, count(*) AS n_media, count(status) AS n_handled, string_agg(file_path || ' ' || status, '|' ORDER BY pos) FILTER (WHERE status IS NOT NULL) AS media FROM status GROUP BY 1)
SELECT p.page_id, p.url, 200 AS status_code, strlen(p.html) AS size_bytes, CAST(p.page_id % 90 AS BIGINT) AS download_time_ms, 'text/html' AS content_type,
       'nginx' AS server, {_MIRROR} AS download_path, regexp_replace({_MIRROR}, '\\.[^./]*$', '') || '_meta.json' AS metadata_path,
       CAST(n_links AS INTEGER) AS n_links, links, CAST(n_media AS INTEGER) AS n_media, CAST(n_handled AS INTEGER) AS n_handled, media
FROM pages p LEFT JOIN l ON l.page_id = p.page_id LEFT JOIN m ON m.page_id = p.page_id""",
)
def q_page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 (+H3, W3, A5, U14, U15): the metadata record of every page."""
    pages = fx_pages(spark, sf_dir)
    log = load(spark, sf_dir, "pages").select(
        "page_id", "url", F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.octet_length("html").alias("size_bytes"),
        (F.col("page_id") % 90).alias("download_time_ms"), F.create_map(F.lit("Server"), F.lit("nginx")).alias("headers"))
    parsed = parse_pages(pages)
    status = M.media_status(M.extract_media(parsed))
    record = SK.page_metadata(log, extract_links(parsed), M.media_items(status), M.media_summary(status))
    return record.select(
        "page_id", "url", "status_code", "size_bytes", "download_time_ms", "content_type", F.col("headers")["Server"].alias("server"), "download_path", "metadata_path",
        F.size("links").alias("n_links"), F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x.url, x.text)), "|").alias("links"),
        F.col("media.total").alias("n_media"), F.col("media.downloaded").alias("n_handled"),
        F.array_join(F.transform("media.items", lambda x: F.concat_ws(" ", x.file_path, x.status)), "|").alias("media"))
