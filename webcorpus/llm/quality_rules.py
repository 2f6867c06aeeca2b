"""Operator 2: quality rules as weak supervision (native DataFrame operations only).

Every rule votes good (+1), bad (-1) or abstains (0) on a document. Expectation-maximisation estimates each rule's
accuracy and the share of good documents without labels; the posterior probability of "good" then decides, instead of
demanding that all rules pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, words

#: Vote of each rule, from the features of ``features``; NULL never occurs as empty texts have features too.
#: Three rules also vote good; the others find one kind of defect and abstain where it is absent.
RULES = {
    "length": "CASE WHEN n_words < 20 THEN -1 WHEN n_words >= 50 THEN 1 ELSE 0 END",
    "word_length": "CASE WHEN n_words = 0 OR word_chars < 2 * n_words OR word_chars > 14 * n_words THEN -1 WHEN word_chars BETWEEN 3 * n_words AND 11 * n_words THEN 1 ELSE 0 END",
    "variety": "CASE WHEN 8 * n_distinct < n_words THEN -1 WHEN 3 * n_distinct >= n_words THEN 1 ELSE 0 END",
    "symbols": "CASE WHEN 10 * n_symbols > n_words THEN -1 ELSE 0 END",
    "symbol_density": "CASE WHEN 40 * n_symbols > word_chars THEN -1 ELSE 0 END",
    "duplicate_lines": "CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN -1 ELSE 0 END",
    "repetition": "CASE WHEN 10 * n_repeat_words > 3 * n_words THEN -1 ELSE 0 END",
    "capitals": "CASE WHEN 2 * n_capitals > word_chars THEN -1 ELSE 0 END",
    "exclamations": "CASE WHEN 5 * n_exclamations > n_words THEN -1 ELSE 0 END",
}


def _repeat_words(w: Column) -> Column:
    """Words within 3-word windows that occur at least twice in the array ``w`` (windows held as 64-bit hashes)."""
    n = F.size(w)

    def counted(grams: Column) -> Column:
        def covered(s: Column) -> Column:
            same = lambda k: F.coalesce(F.get(s, k)["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False))
            places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), same), lambda k: F.get(s, k)["i"]))
            return let(places, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(3).cast("long"), lambda acc, k: acc + F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1))))

        paired = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(paired, covered))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(windows, counted))


def features(documents: DataFrame) -> DataFrame:
    """doc_id and counts of every whole text (null text: as empty, all counts 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("a"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
            (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
            (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_exclamations"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        )

    f = documents.select("doc_id", let(words(F.col("text")), counts).alias("f")).select("doc_id", "f.*")
    return f.withColumns({"n_lines": F.col("lines.a"), "n_dup_lines": F.col("lines.a") - F.col("lines.d")}).drop("lines")


#: What is believed before any data: the share of good documents, and how often a rule votes bad / good on good and on
#: bad documents. It weighs as much as STRENGTH times the documents at hand, so rules keep their meaning at every size.
PRIOR = {"pi": 0.9, "bad_on_good": 0.01, "bad_on_bad": 0.3, "good_on_good": 0.9, "good_on_bad": 0.7}
STRENGTH = 0.1
RATES = ("bad_on_good", "bad_on_bad", "good_on_good", "good_on_bad")


def _log_odds(v: str, rate) -> str:
    """SQL: what a vote adds to the log odds of good; an abstention adds nothing."""
    return f"CASE {v} WHEN 1 THEN ln({rate('good_on_good')} / {rate('good_on_bad')}) WHEN -1 THEN ln({rate('bad_on_good')} / {rate('bad_on_bad')}) ELSE 0D END"


def _fold(m: int, rounds: int) -> str:
    """SQL: EM over ``patterns`` (array of struct(v array<int>, n)), as a fold of pi and the RATES over the rounds.

    E-step: posterior p of each pattern from the prior log odds and the votes' log odds. M-step: the share of good
    documents, and how often each rule votes either way on each class, as expected shares.
    """
    total = "aggregate(q, 0.001D, (x, r) -> x + r.n)"
    votes = "aggregate(sequence(0, %d), 0D, (x, j) -> x + %s)" % (m - 1, _log_odds("r.v[j]", lambda k: f"s.{k}[j]"))
    posterior = f"transform(patterns, r -> named_struct('v', r.v, 'n', r.n, 'p', 1D / (1D + exp(-(ln(s.pi / (1D - s.pi)) + {votes})))))"

    def rate(k: str) -> str:
        vote, weight = (1 if k.startswith("good") else -1), ("r.p" if k.endswith("good") else "(1D - r.p)")
        hits = f"aggregate(q, 0D, (x, r) -> x + IF(r.v[j] = {vote}, r.n * {weight}, 0D))"
        of = f"aggregate(q, 0D, (x, r) -> x + r.n * {weight})"
        return f"'{k}', transform(sequence(0, {m - 1}), j -> ({PRIOR[k] * STRENGTH}D * {total} + {hits}) / ({STRENGTH}D * {total} + {of}))"

    share = f"({PRIOR['pi'] * STRENGTH}D * {total} + aggregate(q, 0D, (x, r) -> x + r.n * r.p)) / ({1 + STRENGTH}D * {total})"
    right = "aggregate(q, 0.5D, (x, r) -> x + CASE r.v[j] WHEN 1 THEN r.n * r.p WHEN -1 THEN r.n * (1D - r.p) ELSE 0D END)"
    accuracy = f"'accuracy', transform(sequence(0, {m - 1}), j -> {right} / aggregate(q, 1D, (x, r) -> x + r.n * abs(r.v[j])))"
    step = f"transform(array({posterior}), q -> named_struct('pi', {share}, {', '.join(map(rate, RATES))}, {accuracy}))[0]"
    begin = ", ".join(f"'{k}', array_repeat({PRIOR[k]}D, {m})" for k in RATES)
    start = f"named_struct('pi', {PRIOR['pi']}D, {begin}, 'accuracy', array_repeat(0.5D, {m}))"
    return f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step})"


def label_model(votes: DataFrame, m: int, rounds: int = 25) -> DataFrame:
    """One row: pi (share of good documents), the RATES and the accuracy of each rule's votes, by EM.

    Documents are first counted per vote pattern (column votes); there are at most 3^m patterns whatever the input, so
    the fold over them is one small row. No documents: the prior.
    """
    patterns = votes.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    packed = patterns.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n").alias("n")))).alias("patterns"))
    return packed.select(F.expr(_fold(m, rounds)).alias("model")).select("model.*")


def score(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: its counts, votes, base_failed, quality (posterior) and kept.

    Null and empty texts have zero counts and fail the base rules; repeated rows are scored alike; other columns are
    ignored; an empty table gives no rows.
    """
    names = list(RULES)
    voted = features(documents).withColumn("votes", F.array(*[F.expr(RULES[k]).cast("int") for k in names]))
    voted = cut(voted, "quality-votes")
    fitted = label_model(voted, len(names)).first()  # one row of 5 * len(RULES) + 1 numbers
    odds = F.lit(math.log(fitted["pi"] / (1 - fitted["pi"])))
    for j in range(len(names)):
        odds = odds + F.expr(_log_odds(f"votes[{j}]", lambda k, j=j: f"{fitted[k][j]!r}D"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = voted.withColumn("quality", 1.0 / (1.0 + F.exp(-odds))).withColumn("base_failed", base_failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
