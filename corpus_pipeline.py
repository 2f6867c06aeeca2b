"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Toxic documents go, then those without a clear language; one document of each group of near duplicates stays; sources
are mixed to their target weights; what is left is packed into sequences.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from webcorpus.llm import language_id, mixing, ngram_join, packing, toxicity  # noqa: E402
from webcorpus.llm.common import cut, remainder  # noqa: E402
from webcorpus.llm.queries import tokenizer_json  # noqa: E402
from webcorpus.session import ship  # noqa: E402
from webcorpus.sources.tables import load  # noqa: E402


#: Rows of whole texts go between the JVM and Python in batches of at most so many rows and bytes.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def _prepare(spark: SparkSession) -> None:
    """The package on the executors, and small Arrow batches for the session: each task holds one on either side."""
    ship(spark)
    for name, value in BATCHES.items():
        spark.conf.set(name, value)


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns) whose doc_id is not in ``rejected``; a null id is never rejected.

    ``rejected`` grows with the input, so it is merge joined at every size: one shuffle of the texts."""
    return docs.join(rejected.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; labels of one fifth of the ids are never learned from."""
    _prepare(spark)
    labels = load(spark, sf_dir, "labels").filter(f"{remainder('doc_id', 5)} != 0")
    return _without(docs, toxicity.score(docs, labels).filter("score >= 0.5"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear by compression; a fourth of the ids is never learned from."""
    _prepare(spark)
    model = language_id.fit(docs.filter(f"{remainder('doc_id', 4)} != 2"))
    return _without(docs, language_id.predict(docs, model).filter("rejected"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each component of the 5-word shingle join at 0.8."""
    _prepare(spark)
    joined = cut(ngram_join.join(docs, n=5, percent=80), "pipeline-components")
    return _without(docs, joined.filter("doc_id != component_id"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    _prepare(spark)
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in packed sequences; the ids as a checksum."""
    _prepare(spark)
    ship(spark)
    return packing.assign(cut(packing.pieces(docs, tokenizer_json(), checksums=True), "pack-pieces"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: The learned stages and the packing cannot be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
