"""Operator 9: language identification by compression.

Each language has a zstandard raw-content dictionary of its own text. A text belongs to the language whose dictionary
makes it smallest, after the bytes that naming the language itself costs (minus log2 of its share, in bytes), which
parts ties of very short texts; a narrow margin to the second best is a rejection. Case is folded first. Texts are
compressed in chunks that do not see each other: else a long text would match itself instead of the dictionary, and the
difference between languages would not grow with its length.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compression import dictionaries, excerpts, sizes

#: Excerpts of 1 KiB per language that the dictionaries are built from.
PER_LANGUAGE = 96
#: Bytes of a text that are compressed at a time.
CHUNK_BYTES = 1 << 10


def fit(documents: DataFrame, label: str = "lang") -> dict[str, tuple[bytes, float]]:
    """Dictionary and cost in bytes of each non-null label of ``documents`` (doc_id, text, label); empty if there is none."""
    known = documents.filter(F.col(label).isNotNull()).withColumn("text", F.lower("text"))
    counts = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}
    made = dictionaries(excerpts(known, label, PER_LANGUAGE, counts))
    return {k: (v, -math.log2(counts[k] / sum(counts.values())) / 8) for k, v in made.items()}


def predict(documents: DataFrame, model: dict[str, tuple[bytes, float]], slope: float = 60.0, least_margin: float = 0.0005) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, margin, rejected.

    margin: by how much smaller the best size is than the second best, relative to the text's bytes, sizes being sums over chunks of CHUNK_BYTES. score: a logistic
    curve of the margin, from 1 / number of languages (margin 0) towards 1; with one language 1. rejected: ``und``, or
    a margin under ``least_margin``. Null texts, texts without a letter and every text under an empty model get ``und``,
    score 0. Ties go to the label first in code point order. Repeated rows are scored alike; other columns are ignored.
    """
    labels = list(model)
    letters = F.coalesce(F.col("text"), F.lit("")).rlike("\\p{L}")
    if not labels:
        return documents.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"), F.lit(True).alias("rejected"))
    found = sizes(documents.select("doc_id", F.when(letters, F.lower("text")).alias("text")), [model[k][0] for k in labels], chunk_bytes=CHUNK_BYTES)
    costs = F.array(*[F.lit(model[k][1]) for k in labels])
    ranked = F.array_sort(F.transform("sizes", lambda x, i: F.struct((x + F.get(costs, i)).alias("size"), i.alias("i"))))
    best = found.withColumn("ranked", ranked).withColumn("known", F.col("n_bytes") > 0)
    second = F.get("ranked", F.lit(1))["size"] if len(labels) > 1 else 2 * F.col("n_bytes")
    best = best.withColumn("margin", F.when(F.col("known"), (second - F.get("ranked", F.lit(0))["size"]) / F.col("n_bytes")).otherwise(0.0))
    names = F.array(*[F.lit(x) for x in labels])
    least = 1.0 / len(labels)
    curve = least + (1 - least) * (1 - F.exp(-slope * F.col("margin")))
    return best.select(
        "doc_id",
        F.when(F.col("known"), F.get(names, F.get("ranked", F.lit(0))["i"])).otherwise("und").alias("lang_pred"),
        F.when(F.col("known"), F.lit(1.0) if len(labels) == 1 else curve).otherwise(0.0).alias("score"),
        "margin",
        (~F.col("known") | (F.col("margin") < least_margin)).alias("rejected"),
    )
