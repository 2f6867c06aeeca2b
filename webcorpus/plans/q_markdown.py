"""Phase 4 queries: Markdown rendering, link validation and repair, word counts, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linkcheck as LC
from ..operators import markdown as MD
from ..sources.fixtures import FX_MARKDOWN_SQL, FX_PAGES_SQL, fx_markdown, fx_pages
from ..sources.tables import load
from . import sqlfrag as S
from .q_media import _title_sql
from .registry import register

_LINKS_SQL = f"""
{FX_MARKDOWN_SQL},
raw AS (SELECT path, content,
               regexp_extract_all(content, '\\[([^\\]]*)\\]\\(([^)]+)\\)', 1) AS texts,
               regexp_extract_all(content, '\\[([^\\]]*)\\]\\(([^)]+)\\)', 2) AS urls,
               trim(regexp_extract(content, 'original_url:\\s*([^\\n]*)', 1)) AS doc_url
        FROM fx_markdown),
l AS (SELECT path, doc_url, CAST(unnest(range(len(urls))) AS INTEGER) AS pos, unnest(texts) AS text,
             unnest(urls) AS url FROM raw),
k AS (SELECT *,
        CASE WHEN starts_with(url, './images/') THEN 'image'
             WHEN url LIKE '%.md' AND (contains(url, '/') OR contains(url, '\\')) THEN 'md'
             WHEN starts_with(url, '#') THEN 'anchor'
             WHEN regexp_matches(url, '^[Hh][Tt][Tt][Pp][Ss]?:') THEN 'external' ELSE 'internal' END AS kind,
        CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {S.url_key('url')}
             WHEN starts_with(url, '/') THEN {S.origin('doc_url')} || {S.url_key('url')}
             ELSE NULL END AS key
      FROM l),
m AS (SELECT {S.url_key('trim(regexp_extract(content, ' + chr(39) + 'original_url:\\s*([^\\n]*)' + chr(39) + ', 1))')} AS key,
             max(path) AS target_path
      FROM fx_markdown GROUP BY 1),
v AS (
  SELECT k.path, k.pos, k.text, k.url, k.kind,
         CASE WHEN k.kind IN ('internal', 'external') AND m.target_path IS NOT NULL THEN 'fixed'
              WHEN k.kind = 'internal' THEN 'broken' ELSE k.kind END AS status,
         m.target_path
  FROM k LEFT JOIN m ON m.key = k.key),
vv AS (
  SELECT path, pos, text, url, kind, status,
         CASE WHEN status = 'fixed' THEN
           CASE WHEN regexp_extract(target_path, '^(.*)/[^/]*$', 1) = regexp_extract(path, '^(.*)/[^/]*$', 1)
                THEN regexp_extract(target_path, '([^/]*)$', 1)
                ELSE '../' || regexp_extract(target_path, '^pages/(.*)$', 1) END END AS "to"
  FROM v)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_markdown(spark, sf_dir)


@register("validate_links", f"WITH {_LINKS_SQL} SELECT * FROM vv")
def q_validate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every Markdown link with its status and repaired target."""
    return LC.validate_links(_docs(spark, sf_dir))


@register("broken_links", f"WITH {_LINKS_SQL} SELECT path, url, text FROM vv WHERE status = 'broken'")
def q_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 (left anti join against the pages map)."""
    return LC.broken_links(_docs(spark, sf_dir))


@register(
    "pages_map",
    f"""WITH {FX_MARKDOWN_SQL},
m AS (SELECT trim(regexp_extract(content, 'original_url:\\s*([^\\n]*)', 1)) AS u, path FROM fx_markdown)
SELECT {S.url_key('u')} AS key, arg_max(u, path) AS original_url, max(path) AS target_path FROM m GROUP BY 1""",
)
def q_pages_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    return LC.pages_map(_docs(spark, sf_dir))


@register(
    "fix_links",
    f"""WITH {_LINKS_SQL},
f AS (SELECT path, url, "to" FROM vv WHERE status = 'fixed'),
c AS (SELECT path, count(*) AS n FROM f GROUP BY 1)
SELECT d.path,
       CASE WHEN f.path IS NULL THEN d.content
            ELSE replace(d.content, '[next](' || f.url || ')', '[next](' || f."to" || ')') END AS content,
       CAST(coalesce(c.n, 0) AS INTEGER) AS fixed
FROM fx_markdown d LEFT JOIN f ON f.path = d.path LEFT JOIN c ON c.path = d.path""",
)
def q_fix_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 per-document rebuild with relative targets."""
    return LC.fix_links(_docs(spark, sf_dir))


@register(
    "validation_summary",
    f"""WITH {_LINKS_SQL}
SELECT 'pages_mapped' AS metric, (SELECT count(DISTINCT {S.url_key("trim(regexp_extract(content, 'original_url:" +
    "\\s*([^\\n]*)', 1))")}) FROM fx_markdown) AS value
UNION ALL SELECT 'files_with_internal_links', count(DISTINCT path) FILTER (WHERE kind = 'internal') FROM vv
UNION ALL SELECT 'external_links', count(*) FILTER (WHERE kind = 'external') FROM vv
UNION ALL SELECT 'fixed_links', count(*) FILTER (WHERE status = 'fixed') FROM vv
UNION ALL SELECT 'broken_links', count(*) FILTER (WHERE status = 'broken') FROM vv""",
)
def q_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    return LC.validation_summary(_docs(spark, sf_dir))


_WS = "[\\s\\x{a0}\\x{85}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}\\x{0b}]+"


@register(
    "word_count",
    f"""
WITH b AS (SELECT doc_id, CASE WHEN contains(text, '---')
                               THEN regexp_extract(text, '(?s)^.*?---(?:.*?---)?(.*)$', 1) ELSE text END AS body
           FROM documents),
w AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(body, '{_WS}'), lambda x: x <> '')) AS INTEGER) AS words
      FROM b)
SELECT doc_id, words, CASE WHEN words > 0 THEN floor((words + 10) / 20) / 10.0 ELSE 0.0 END AS reading_time FROM w""",
)
def q_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9, M10 over every document (whole texts)."""
    d = load(spark, sf_dir, "documents").select("doc_id", MD.word_count(F.col("text")).alias("words"))
    return d.withColumn("reading_time", MD.reading_time(F.col("words")))


@register(
    "markdown",
    f"""WITH {FX_PAGES_SQL},
a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS art FROM fx_pages)
SELECT page_id,
       CAST(len(regexp_extract_all(art, '<h[1-6][ >]')) AS INTEGER) AS headings,
       CAST(len(regexp_extract_all(art, '<a href=')) AS INTEGER) AS links,
       CAST(len(regexp_extract_all(art, '<img ')) AS INTEGER) AS images
FROM a""",
)
def q_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 with H6-H9: render every page (main content, boilerplate removed, absolute links,
    images rewritten) and count the Markdown structures."""
    md = MD.to_markdown(fx_pages(spark, sf_dir))
    body = F.col("body")
    return md.select(
        "page_id",
        F.size(F.regexp_extract_all(body, F.lit(r"(?m)^#{1,6} "), 0)).alias("headings"),
        F.size(F.regexp_extract_all(body, F.lit(r"(?<!!)\[[^\]]*\]\(<"), 0)).alias("links"),
        F.size(F.regexp_extract_all(body, F.lit(r"!\[[^\]]*\]\("), 0)).alias("images"),
    )


# Templates are user data (type → text with '{input_text}'); these are ours.
TEMPLATES = [
    ("general", "Correct spelling and grammar; keep Markdown intact.\n\n{input_text}"),
    ("technical", "Correct the technical text; keep code and terms unchanged.\n\n{input_text}"),
    ("blog", "Polish the blog post lightly; keep the author's voice.\n\n{input_text}"),
    ("light", "Fix only clear errors.\n\n{input_text}"),
]


@register(
    "correction_requests",
    """
WITH t(type, template) AS (VALUES """ + ", ".join(
        "('" + a + "', '" + b.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for a, b in TEMPLATES) + """),
d AS (SELECT doc_id, text, CASE lower(source) WHEN 'src1' THEN 'technical' WHEN 'src2' THEN 'BLOG'
                               WHEN 'src3' THEN 'Light' ELSE source END AS kind FROM documents)
SELECT d.doc_id, d.kind,
       CASE WHEN trim(coalesce(d.text, '')) = '' THEN d.text ELSE replace(t.template, '{input_text}', d.text) END AS prompt
FROM d JOIN t ON t.type = CASE WHEN lower(d.kind) IN ('general', 'technical', 'blog', 'light')
                               THEN lower(d.kind) ELSE 'general' END""",
)
def q_correction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One correction request per document (whole texts)."""
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", "text",
        F.when(F.lower("source") == "src1", F.lit("technical")).when(F.lower("source") == "src2", F.lit("BLOG"))
        .when(F.lower("source") == "src3", F.lit("Light")).otherwise(F.col("source")).alias("kind"))
    templates = spark.createDataFrame(TEMPLATES, "type string, template string")
    return MD.correction_requests(docs, templates, "kind", "text").select("doc_id", "kind", "prompt")



@register(
    "main_content",
    f"""WITH {FX_PAGES_SQL},
a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS art FROM fx_pages),
t AS (SELECT page_id, {S.unescape("regexp_replace(art, '<[^>]*>', '', 'g')")} AS txt FROM a)
SELECT page_id, 'article' AS root_tag,
       CAST(len(list_filter(regexp_split_to_array(txt, '{_WS}'), lambda x: x <> '')) AS INTEGER) AS words
FROM t""",
)
def q_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6 + H7 on the parsed tree: main-content root and its word count without boilerplate."""
    from ..operators.html import main_content_root, main_text, parse_pages

    parsed = parse_pages(fx_pages(spark, sf_dir))
    nodes = F.col("nodes")
    return parsed.select(
        "page_id",
        main_content_root(nodes).tag.alias("root_tag"),
        MD.word_count(main_text(nodes)).alias("words"),
    )


def _convertible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_pages, some of which cannot be converted: a link that is no URL, or no HTML at all."""
    p = fx_pages(spark, sf_dir)
    bad = F.replace(F.col("html"), F.lit("</article>"), F.lit('<a href="http://[bad">x</a></article>'))
    return p.withColumn("html", F.when(F.col("page_id") % 43 == 9, F.lit(None)).when(F.col("page_id") % 41 == 7, bad).otherwise(F.col("html")))


def _sub(x: str, *pairs: tuple[str, str]) -> str:
    """Replacements one after another; ``new`` is SQL."""
    for pattern, new in pairs:
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    return x


_GAP = "chr(10) || chr(10)"
# headings, paragraphs and unclosed bold text; links and the image (whose urls and names the view fixes)
_MARKED = _sub(
    "regexp_extract(html, '(?s)<article>(.*)</article>', 1)",
    ("<h1>([^<]*)</h1>", rf"'# \1' || {_GAP}"), ("<br>", "chr(10)"), ("<p><b>", f"{_GAP} || '**'"), ("</?p>", _GAP),
    ('<a href="/([^"]*)">([^<]*)</a>', r"'[\2](<' || " + S.origin("url") + r" || '/\1>)'"), ('<a href="([^"]*)">([^<]*)</a>', r"'[\2](<\1>)'"),
    ('<img src="/img/([0-9]*.png)[^"]*">', r"'![](images/\1)'"))
_BODY = _sub("rtrim(" + _sub(f"replace({S.unescape(_MARKED)}, chr(160), ' ')", (r" *\n *", "chr(10)"), (" +", "' '")) + ", ' ' || chr(10))", (r"\n\n+", _GAP))
_TIDY = _sub("body", ("(?m)^([*+-])([^ ]|$)", r"'\1 \2'"), (r"(?m)^(\d+\.)([^ ]|$)", r"'\1 \2'"))


def _scalar(x: str) -> str:
    needs = f"""regexp_matches({x}, '[:#''"\\[\\]{{}},&*!|>%@`]|^[\\s?-]|\\s$')"""
    quote = "chr(39)"
    return f"(CASE WHEN {needs} THEN {quote} || replace({x}, {quote}, {quote} || {quote}) || {quote} ELSE {x} END)"


@register(
    "convert",
    f"""WITH {FX_PAGES_SQL},
p AS (SELECT page_id, url, html, CASE WHEN page_id % 43 = 9 THEN 'the page has no HTML' WHEN page_id % 41 = 7 THEN 'Invalid IPv6 URL' END AS error,
             {_title_sql()} AS title, trim({S.path('url')}, '/') AS path FROM fx_pages),
b AS (SELECT *, {_BODY} || repeat('**', CAST(len(regexp_extract_all(html, '<p><b>')) AS INTEGER)) || chr(10) AS body,
             CASE WHEN path = '' THEN 'index' ELSE regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.(html|php|asp)$', '') END AS name FROM p)
SELECT page_id, url, CASE WHEN error IS NULL THEN title END AS title,
       CASE WHEN error IS NULL THEN CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)', 1) ELSE '' END || name || '.md' END AS markdown_path,
       CASE WHEN error IS NOT NULL THEN '---' || chr(10) || 'title: Error converting content' || chr(10) || 'url: ' || url || chr(10) || '---' || chr(10)
              || chr(10) || 'Error: ' || error
            ELSE '---' || chr(10) || CASE WHEN title <> '' THEN 'title: ' || {_scalar('title')} || chr(10) ELSE '' END
              || CASE WHEN path <> '' THEN 'permalink: /' || name || '/' || chr(10) ELSE '' END || 'original_url: ' || {_scalar('url')} || chr(10)
              || '---' || chr(10) || chr(10) || {_TIDY} END AS document,
       CASE WHEN error IS NULL THEN {S.origin('url')} || regexp_extract(html, '<img src="([^"]*)"', 1) || '=' || regexp_extract(html, '<img src="/img/([0-9]*.png)', 1) END AS images,
       error IS NULL AS converted, error
FROM b""",
)
def q_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7, F12 (+H1, H6-H9, H20, M1, M3, M5, U17): whole documents of every page; those that cannot be converted carry their error."""
    images = F.array_join(F.transform("images", lambda i: F.concat_ws("=", i.url, i["name"])), ",")
    return MD.convert(_convertible(spark, sf_dir)).withColumn("images", images)
