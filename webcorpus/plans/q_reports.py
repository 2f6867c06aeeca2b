"""Phase 5 queries: table of contents, page records, download report, error lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fetchlog as FL
from ..operators import linkcheck as LC
from ..operators import report as R
from ..operators.markdown import convert, parse_front_matter
from ..sources.fixtures import FX_FETCH_LOG_SQL, FX_MARKDOWN_SQL, fx_fetch_log, fx_markdown
from ..sources.tables import load
from . import sqlfrag as S
from .q_markdown import _LINKS_SQL, _convertible
from .registry import register


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion results of the Markdown corpus: url and title from the front matter, path,
    images referenced, converted flag."""
    d = fx_markdown(spark, sf_dir)
    return d.select(
        F.regexp_extract(F.col("path"), r"([0-9]+)\.md$", 1).cast("bigint").alias("idx"),
        parse_front_matter(F.col("content")).alias("url"),
        F.regexp_extract(F.col("content"), r"(?m)^title: (.*)$", 1).alias("title"),
        F.col("path").alias("markdown_path"),
        "content",
        F.regexp_extract_all(F.col("content"), F.lit(r"!\[[^\]]*\]\(\./images/([^)]+)\)"), 1).alias("images"),
        F.lit(None).cast("string").alias("download_date"),
        F.lit(True).alias("converted"),
    )


_DOCS_SQL = f"""{FX_MARKDOWN_SQL},
docs AS (SELECT CAST(regexp_extract(path, '([0-9]+)\\.md$', 1) AS BIGINT) AS idx,
                trim(regexp_extract(content, 'original_url:\\s*([^\\n]*)', 1)) AS url,
                regexp_extract(content, '\\ntitle: ([^\\n]*)', 1) AS title, path AS markdown_path, content,
                len(regexp_extract_all(content, '!\\[[^\\]]*\\]\\(\\./images/([^)]+)\\)', 1)) AS n_images
         FROM fx_markdown)"""


@register(
    "table_of_contents",
    f"""WITH {_DOCS_SQL},
f AS (SELECT {S.netloc('url')} AS site, markdown_path AS path, title,
             regexp_extract(markdown_path, '^pages/([^/]*)/', 1) AS k FROM docs)
SELECT site, 2 AS depth, '1pages' || chr(1) || '1' || k || chr(1) || '0' || title AS sort_key,
       '    - [' || title || '](' || path || ')' AS line FROM f
UNION
SELECT DISTINCT site, 0, '1pages', '- **pages/**' FROM f
UNION
SELECT DISTINCT site, 1, '1pages' || chr(1) || '1' || k, '  - **' || k || '/**' FROM f""",
)
def q_table_of_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + T4: ToC lines per site with depth and sort key."""
    return R.table_of_contents(conversions(spark, sf_dir)).select(
        "site", F.col("depth").cast("int").alias("depth"), "sort_key", "line")


@register(
    "page_records",
    f"""WITH {_DOCS_SQL},
r AS (SELECT *, replace({S.netloc('url')} || '_' ||
        CASE WHEN trim({S.path('url')}, '/') = '' THEN 'index'
             ELSE regexp_extract(trim({S.path('url')}, '/'), '([^/]*)$', 1) END || '.json', '.', '_') AS fn,
        CASE WHEN contains(content, '---') THEN regexp_extract(content, '(?s)^.*?---(?:.*?---)?(.*)$', 1)
             ELSE content END AS body FROM docs),
w AS (SELECT *, CAST(len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words FROM r)
SELECT url, title, markdown_path, CAST(n_images AS INTEGER) AS n_images, words AS word_count,
       CASE WHEN words > 0 THEN floor((words + 10) / 20) / 10.0 ELSE 0.0 END AS reading_time,
       CASE WHEN length(fn) > 100 THEN left(fn, 95) || '_' || CAST(idx AS VARCHAR) || '.json' ELSE fn END AS record_file
FROM w""",
)
def q_page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 + U18 + M9 + M10 + F12."""
    r = R.page_records(conversions(spark, sf_dir))
    return r.select("url", "title", "markdown_path", F.size("images").alias("n_images"), "word_count",
                    "reading_time", "record_file")


@register(
    "download_report",
    f"""WITH {_LINKS_SQL}, {FX_FETCH_LOG_SQL.strip()},
last AS (SELECT url, arg_max(status_code, attempt) AS st FROM fx_fetch_log GROUP BY url)
SELECT 'crawled_urls' AS metric, (SELECT count(*) FROM pages) AS value
UNION ALL SELECT 'downloaded_pages', count(*) FILTER (WHERE st < 400) FROM last
UNION ALL SELECT 'failed_downloads', count(*) FILTER (WHERE st >= 400) FROM last
UNION ALL SELECT 'converted_pages', (SELECT count(*) FROM fx_markdown)
UNION ALL SELECT 'failed_conversions', 0
UNION ALL SELECT 'downloaded_images', (SELECT count(*) FROM vv WHERE kind = 'image')
UNION ALL SELECT 'fixed_links', count(*) FILTER (WHERE status = 'fixed') FROM vv
UNION ALL SELECT 'broken_links', count(*) FILTER (WHERE status = 'broken') FROM vv""",
)
def q_download_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl, download, conversion and link-repair counters."""
    discovered = load(spark, sf_dir, "pages").select("url")
    downloads = FL.error_summary(fx_fetch_log(spark, sf_dir)).select("url", (~F.col("failed")).alias("downloaded"))
    conv = conversions(spark, sf_dir)
    validation = LC.validate_links(fx_markdown(spark, sf_dir))
    return R.download_report(discovered, downloads, conv, validation)


@register(
    "error_lists",
    f"""WITH {_LINKS_SQL},
b AS (SELECT path, pos, url, text, row_number() OVER (ORDER BY path, pos) AS rank FROM vv WHERE status = 'broken'),
n AS (SELECT count(*) AS n FROM b)
SELECT 'Broken Links' AS section, CAST(rank AS INTEGER) AS rank,
       '- In **' || path || '**: `' || url || '` (Text: "' || text || '")' AS line FROM b WHERE rank <= 10
UNION ALL SELECT 'Broken Links', 11, '- ... and ' || CAST(n - 10 AS VARCHAR) || ' more' FROM n WHERE n > 10""",
)
def q_error_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ten broken links and the '... and N more' line."""
    v = LC.validate_links(fx_markdown(spark, sf_dir)).where(F.col("status") == "broken")
    # The report's broken-link line format.
    line = F.concat(F.lit("- In **"), F.col("path"), F.lit("**: `"), F.col("url"), F.lit('` (Text: "'),
                    F.col("text"), F.lit('")'))
    out = R.first_errors(v, ["path", "pos"], line, "Broken Links")
    return out.select("section", F.col("rank").cast("int").alias("rank"), "line")


@register(
    "site_index",
    f"""WITH {_DOCS_SQL},
s AS (SELECT DISTINCT {S.netloc('url')} AS site FROM docs),
f AS (SELECT {S.netloc('url')} AS site, markdown_path AS path, title, regexp_extract(markdown_path, '^pages/([^/]*)/', 1) AS k FROM docs)
SELECT site, '000' || i AS sort_key, CASE i WHEN 0 THEN '# Pages of ' || site WHEN 2 THEN 'Markdown copies of the pages of ' || site || '.'
         WHEN 4 THEN '## Pages' ELSE '' END AS line FROM s, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i)
UNION ALL SELECT site, '11pages' || chr(1) || '1' || k || chr(1) || '0' || title, '    - [' || title || '](' || path || ')' FROM f
UNION ALL SELECT DISTINCT site, '11pages', '- **pages/**' FROM f
UNION ALL SELECT DISTINCT site, '11pages' || chr(1) || '1' || k, '  - **' || k || '/**' FROM f
UNION ALL SELECT site, '2000', '' FROM s UNION ALL SELECT site, '2001', 'Written on 2024-05-06.' FROM s""",
)
def q_site_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of every site."""
    return R.site_index(conversions(spark, sf_dir), F.lit("2024-05-06").cast("date"))


@register(
    "conversion_errors",
    f"""WITH {FX_FETCH_LOG_SQL.strip()},
e AS (SELECT page_id, url, CASE WHEN page_id % 43 = 9 THEN 'the page has no HTML' ELSE 'Invalid IPv6 URL' END AS error,
             row_number() OVER (ORDER BY page_id) AS rank FROM pages WHERE page_id % 43 = 9 OR page_id % 41 = 7),
l AS (SELECT url, status_code, row_number() OVER (ORDER BY seq) AS rank FROM fx_fetch_log WHERE status_code >= 400)
SELECT 'Conversion Errors' AS section, CAST(rank AS INTEGER) AS rank, '- ' || url || ': ' || error AS line FROM e WHERE rank <= 10
UNION ALL SELECT 'Conversion Errors', 11, '- ... and ' || CAST(count(*) - 10 AS VARCHAR) || ' more' FROM e HAVING count(*) > 10
UNION ALL SELECT 'Download Errors', CAST(rank AS INTEGER), '- ' || url || ': HTTP ' || status_code FROM l WHERE rank <= 10
UNION ALL SELECT 'Download Errors', 11, '- ... and ' || CAST(count(*) - 10 AS VARCHAR) || ' more' FROM l HAVING count(*) > 10""",
)
def q_conversion_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversion and download error lists."""
    failed = convert(_convertible(spark, sf_dir)).where(~F.col("converted"))
    one = R.first_errors(failed, ["page_id"], F.concat(F.lit("- "), F.col("url"), F.lit(": "), F.col("error")), "Conversion Errors")
    bad = fx_fetch_log(spark, sf_dir).where("status_code >= 400")
    two = R.first_errors(bad, ["seq"], F.concat(F.lit("- "), F.col("url"), F.lit(": HTTP "), F.col("status_code").cast("string")), "Download Errors")
    return one.unionByName(two).select("section", F.col("rank").cast("int").alias("rank"), "line")
