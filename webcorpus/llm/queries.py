"""One thin query per operator, over its whole table; SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.sources.tables import load

from . import language_id, mixing, ngram_join, one_bit_search, packing, quality_classifier, quality_rules, token_files, toxicity, url_filters
from .catalog import register
from .common import cut, remainder



def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """Content of a public tokenizer file; it goes to the executors with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


# ---------------------------------------------------------------- 2: quality rules


@register("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score(load(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


# ---------------------------------------------------------------- 8: quality classifier


@register("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = remainder("doc_id", 4)
    labels = load(spark, sf_dir, "labels").filter(f"{fold} != 2")
    scored = quality_classifier.score(load(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", F.expr(f"{fold} = 2").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


# ---------------------------------------------------------------- 9: language id


@register("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, fold = load(spark, sf_dir, "documents"), remainder("doc_id", 4)
    model = language_id.fit(documents.filter(f"{fold} != 2"))
    found = language_id.predict(documents, model)
    return found.select("doc_id", F.expr(f"{fold} = 2").alias("held_out"), "lang_pred", "score", "rejected")


# ---------------------------------------------------------------- 10: mixing

_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
        coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
      FROM s WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - cap_before) / ((SELECT sum(w) FROM s) - w_before) AS lvl FROM c),
t AS (SELECT source, source_size,
        least(coalesce((SELECT arg_min(lvl, w_before) FROM l WHERE lvl * w <= cap) * w, cap), cap) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate,
        CAST('0x' || substr(md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


@register("op10_source_mixing", _MIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_sizes(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).cast("long").alias("taken"))


# ---------------------------------------------------------------- 6: toxicity


@register("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = remainder("doc_id", 5)
    labels = load(spark, sf_dir, "labels").filter(f"{fold} != 0")
    scored = toxicity.score(load(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", F.expr(f"{fold} = 0").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# ---------------------------------------------------------------- 5 and 7: packing, token files


@register("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.assign(cut(packing.pieces(load(spark, sf_dir, "documents"), tokenizer_json(), checksums=True), "pack-pieces"))


@register("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.write_and_read(load(spark, sf_dir, "documents"), tokenizer_json())
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# ---------------------------------------------------------------- 4: n-gram Jaccard join


@register("op4_ngram_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(load(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 3: nearest neighbours


@register("op3_one_bit_search")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return one_bit_search.search(vectors, vectors.filter("vec_id % 20 = 0"))


# ---------------------------------------------------------------- 1: URL filters

#: Days after 2023-01-01 and switches of captures and list entries, from digits of an md5: both engines have it.
_HASH = {"spark": "CAST(conv(substr(md5(concat('{salt}', {x})), 1, 7), 16, 10) AS BIGINT)", "duckdb": "CAST('0x' || substr(md5(concat('{salt}', {x})), 1, 7) AS BIGINT)"}


def _hash(engine: str, salt: str, x: str) -> str:
    return _HASH[engine].format(salt=salt, x=x)


def _lists_sql(engine: str) -> str:
    """CTEs captures (capture_id, url, host, day) and entries (list, pattern, action, day) over the table ``pages``."""
    h = lambda salt, x: _hash(engine, salt, x)
    host, path = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))", r"regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/([^/?#]+)', 1)"
    if engine == "spark":
        host, path = host.replace("\\", "\\\\"), path.replace("\\", "\\\\")
    return f"""captures AS (SELECT page_id AS capture_id, url, {host} AS host, {path} AS step, {h("fetch", "CAST(page_id AS STRING)")} % 730 AS day FROM pages),
hosts AS (SELECT host, {h("host", "host")} AS x FROM captures WHERE host <> '' GROUP BY host),
steps AS (SELECT concat(host, '/', step) AS pattern, {h("step", "concat(host, '/', step)")} AS x FROM captures WHERE host <> '' AND step <> '' GROUP BY host, step),
entries AS (
  SELECT 'malware' AS list, host AS pattern, 'add' AS action, x % 600 AS day FROM hosts WHERE x % 4 = 0
  UNION ALL SELECT 'malware', host, 'remove', x % 600 + 90 FROM hosts WHERE x % 8 = 0
  UNION ALL SELECT 'malware', host, 'add', x % 600 + 150 FROM hosts WHERE x % 16 = 0
  UNION ALL SELECT 'adult', pattern, 'add', x % 700 FROM steps WHERE x % 3 = 0
  UNION ALL SELECT 'adult', pattern, 'remove', x % 700 + 200 FROM steps WHERE x % 6 = 0)"""


_FILTER_SQL = f"""
WITH {_lists_sql("duckdb").replace("AS STRING", "AS VARCHAR")},
turns AS (SELECT list, pattern, day, action, lag(action, 1, 'remove') OVER (PARTITION BY list, pattern ORDER BY day) AS was FROM entries),
kept AS (SELECT list, pattern, action, day AS since, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS til FROM turns WHERE action <> was),
hits AS (
  SELECT c.capture_id, k.list, k.pattern, k.since FROM captures c JOIN kept k ON k.action = 'add' AND c.day >= k.since AND (k.til IS NULL OR c.day < k.til)
    AND CASE WHEN k.list = 'malware' THEN k.pattern = c.host OR ends_with(c.host, '.' || k.pattern) ELSE k.pattern = concat(c.host, '/', c.step) END),
best AS (SELECT capture_id, count(*) AS n, min(struct_pack(a := list, b := pattern, c := since)) AS f FROM hits GROUP BY capture_id)
SELECT p.page_id, n IS NOT NULL AS blocked, CAST(coalesce(n, 0) AS BIGINT) AS n_active, f.a AS list, f.b AS pattern, coalesce(CAST(f.c AS BIGINT), -1) AS since
FROM pages p LEFT JOIN best ON p.page_id = best.capture_id
"""


@register("op1_url_filters", _FILTER_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are all pages, fetched on a day that their id gives; the dated lists are derived from their hosts and paths."""
    pages, lists = load(spark, sf_dir, "pages").select("page_id", "url"), _lists_sql("spark")
    captures = _derived(pages, lists, "SELECT capture_id, url, day AS fetched FROM captures")
    entries = _derived(pages, lists, "SELECT list, pattern, action, day AS at FROM entries")
    found = url_filters.evaluate(captures, entries)
    return found.select(F.col("capture_id").alias("page_id"), "blocked", "n_active", "list", "pattern", F.coalesce("since", F.lit(-1)).cast("long").alias("since"))


def _derived(pages: DataFrame, ctes: str, select: str) -> DataFrame:
    return pages.sparkSession.sql(f"WITH pages AS (SELECT * FROM {{table}}), {ctes} {select}", table=pages)
