"""Operators 8 and 9 against plain compression, text by text, and the EM of operator 2 against a plain one."""

import math
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from webcorpus.llm import compression, language_id, quality_classifier
from webcorpus.llm.common import hash_share

SCHEMA = "doc_id long, text string, lang string, source string"


def words(rng, letters, n=120):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    own = {"en": words(rng, "abcdefghi"), "de": words(rng, "klmnopqü"), "fr": words(rng, "rstuvwxé")}
    out = [(i, " ".join(rng.choice(own[k]) for _ in range(rng.randrange(1, 260))), k, "s") for i, k in enumerate(["en", "en", "de", "fr"] * 60)]
    out += [(1000 + i, out[8][1], "en", "s") for i in range(300)]  # one text holds more than half of its language
    return out + [(2000, None, "en", "s"), (2001, "", "de", "s"), (2002, "42 !", None, "s"), (2003, out[2][1].upper(), None, "s")]


def plain_size(text, content, step):
    made = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
    raw = text.encode()
    return sum(len(made.compress(raw[i : i + step])) for i in range(0, max(1, len(raw)), step))


def test_excerpts_are_those_of_the_least_hashes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).filter("lang IS NOT NULL")
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    for per in (5, 40, 1000):
        found = compression.excerpts(df, "lang", per, {"en": 420, "de": 61, "fr": 60})
        for lang in ("en", "de", "fr"):
            texts = sorted({t for _, t, k, _ in rows if k == lang and t}, key=hashes.get)[:per]
            assert len(found[lang]) == len(texts)
            assert all(x in t.encode() and len(x) == min(len(t.encode()), compression.EXCERPT_BYTES) for x, t in zip(found[lang], texts, strict=True))
    assert compression.excerpts(df.limit(0), "lang", 5, {}) == {}


def test_language_is_the_smallest_compressed_size(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for i, text, _, _ in rows[:60] + rows[-4:]:
        r = got[i]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        low = text.lower()
        sizes = sorted((plain_size(low, d, language_id.CHUNK_BYTES) + cost, k) for k, (d, cost) in model.items())
        margin = (sizes[1][0] - sizes[0][0]) / len(low.encode())
        assert r.lang_pred == sizes[0][1] and abs(r.margin - margin) < 1e-9 and r.rejected == (r.margin < 0.0005)
        assert abs(r.score - (1 / 3 + 2 / 3 * (1 - math.exp(-60 * margin)))) < 1e-9
    assert sum(got[i].lang_pred == k for i, t, k, _ in rows[:240]) > 235


def test_quality_score_is_the_calibrated_size_difference(spark, rows):
    """Good texts are written in two of the vocabularies, bad ones in the third; held-out texts follow their labels."""
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(k != "fr")) for i, t, k, _ in rows[:200]], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_classifier.score(docs, labels).collect()}
    half = docs.join(labels, "doc_id").filter(hash_share("doc_id", 11, 0.5))
    found = compression.excerpts(half, "quality", quality_classifier.PER_LABEL, {0: 10, 1: 10})
    good, bad = (compression.dictionaries({str(k): v for k, v in found.items()})[str(k)] for k in (1, 0))
    for i, text, _, _ in rows[:40]:
        n = len(text.encode())
        assert abs(out[i].difference - 10 * (plain_size(text, bad, n) - plain_size(text, good, n)) / n) < 1e-9
        assert abs(out[i].own_ratio - 10 * (plain_size(text, b"", n) / n - 0.4)) < 1e-9
    held = [(i, k) for i, t, k, _ in rows[200:240] if len(t) > 60]
    assert sum((out[i].score >= 0.7) == (k != "fr") for i, k in held) >= 0.95 * len(held)
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
