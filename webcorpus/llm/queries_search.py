"""Queries of operators 11 to 13, over their whole tables, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.sources.tables import load

from . import cover_tree, hard_negatives, ranked_search
from .catalog import register

_FINITE = "len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0"

# ---------------------------------------------------------------- 11: near duplicates among vectors

_TREE_SQL = f"""
WITH RECURSIVE t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS MATERIALIZED (SELECT * FROM t WHERE e IS NOT NULL AND {_FINITE} AND len([x for x in e if x <> 0]) > 0),
pairs AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT x, x FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM pairs GROUP BY x)
SELECT t.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, t.vec_id) AS component_id,
       t.vec_id = coalesce(component_id, t.vec_id) AS kept
FROM t LEFT JOIN c ON c.x = t.vec_id LEFT JOIN n ON n.x = t.vec_id
"""


@register("op11_cover_tree", _TREE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(load(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- 12: hard negatives

_MINE_SQL = f"""
WITH t AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS MATERIALIZED (SELECT vec_id, label, [floor(256 * x) for x in e] AS e FROM t WHERE label IS NOT NULL AND e IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
                   FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


@register("op12_hard_negatives", _MINE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return hard_negatives.mine(vectors, "vec_id % 100 = 0")


# ---------------------------------------------------------------- 13: ranked search

_RANK_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
p AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, n, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, n GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term), n GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w <= 50
"""


@register("op13_ranked_search", _RANK_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
