"""Operator 8: quality classification by compression.

zstandard dictionaries are built from good and from bad labelled text. The difference of a text's two compressed
sizes, relative to its bytes, and its compressed size without a dictionary become a calibrated probability of label 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, fit_logistic, hash_share, logistic
from .compression import dictionaries, excerpts, sizes

#: Excerpts of 1 KiB per label in the dictionaries, and labelled rows that the curve is fitted on.
PER_LABEL = 96
FIT_ROWS = 8000


def _signals(found: DataFrame) -> DataFrame:
    """Compressed sizes to: normalised difference, self-compression, log length (all 0 for an empty text)."""
    n = F.greatest(F.col("n_bytes"), F.lit(1))
    good, bad, alone = (F.get("sizes", F.lit(i)) for i in range(3))
    return found.withColumns(
        {
            "difference": F.when(F.col("n_bytes") > 0, 10.0 * (bad - good) / n).otherwise(0.0),
            "own_ratio": F.when(F.col("n_bytes") > 0, 10.0 * (alone / n - 0.4)).otherwise(0.0),
            "best_ratio": F.when(F.col("n_bytes") > 0, 10.0 * (F.least(good, bad) / n - 0.4)).otherwise(0.0),
            "length": F.log1p(F.col("n_bytes").cast("double")) / 4.0,
        }
    )


SIGNALS = ("difference", "own_ratio", "best_ratio", "length")


def _basis() -> list:
    x = [F.col(k) for k in SIGNALS]
    return [*x, *[a * b for i, a in enumerate(x) for b in x[i:]]]


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: label 1 likelier) and the signals.

    ``labels`` (doc_id, quality) holds the rows to learn from; null labels are ignored. With no rows of one label the
    score is the share of label 1 among them (0.5 without any). Null texts count as empty and get the curve's value at
    zero signals; repeated rows are scored alike; other columns are ignored. Fitted on bounded samples (PER_LABEL,
    FIT_ROWS), every document's whole text is scored.
    """
    documents = documents.select("doc_id", "text")
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")).dropDuplicates(["doc_id"])
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if len(counts) < 2:
        return documents.select("doc_id", F.lit(share).alias("score"))
    # dictionaries: a bounded number of labelled rows, few enough to be broadcast, and at most half of them: the curve is
    # fitted on others, as a text that lies in a dictionary itself compresses better than any new one
    share_of = {k: min(0.5, 6 * PER_LABEL / n) for k, n in counts.items()}
    in_dictionary = ((F.col("quality") == 1) & hash_share("doc_id", 11, share_of[1])) | ((F.col("quality") == 0) & hash_share("doc_id", 11, share_of[0]))
    wanted = known.filter(in_dictionary)
    found = excerpts(documents.join(F.broadcast(wanted), "doc_id"), "quality", PER_LABEL, {k: 6 * PER_LABEL for k in counts})
    model = dictionaries({str(k): v for k, v in found.items()})
    scored = cut(_signals(sizes(documents, [model.get("1", b""), model.get("0", b""), b""])), "quality-signals")
    rest = known.filter(~in_dictionary)
    if rest.select("quality").distinct().count() < 2:  # too few rows to part
        rest = known
    sample = bounded_sample(rest, 12, FIT_ROWS)
    rows = scored.join(F.broadcast(sample), "doc_id").select("quality", *[x.alias(f"x{i}") for i, x in enumerate(_basis())]).toPandas()
    data = rows.to_numpy(float)
    if not len(data) or len(np.unique(data[:, 0])) < 2:
        return scored.withColumn("score", F.lit(share))
    beta = fit_logistic(data[:, 1:], data[:, 0], ridge=0.1)
    return scored.withColumn("score", logistic(_basis(), beta))
