"""Operator 6: toxicity by a lexicon that tolerates misspellings, with scores from the words around each hit.

Words and stems that mark toxic documents are learned from labels. A Levenshtein automaton intersected with the
lexicon's trie finds them, misspelled ones included; a window around each hit tells quotation and report (less weight)
from address and piled-up abuse (more weight). A logistic curve over the weighted hits gives the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .automaton import LEAST_LENGTH, LexiconAutomaton
from .common import bounded_sample, cut, fit_logistic, hash_share, logistic, slices, split_words, text_of, words

#: Labelled rows that the lexicon is learned from (each label), and that the curve is fitted on.
LEXICON_ROWS = {1: 4000, 0: 8000}
FIT_ROWS = 20000
#: Share of false ones among the rare terms that are learned.
FALSE_SHARE = 0.05
#: Characters taken off both ends of a token.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…¡¿"
#: Words on either side of a hit that are looked at; signs of quotation or report, and of address.
WINDOW = 6
OPENING, CLOSING = "\"«“„", "\"»”“"
REPORT = frozenset("said says called calls quote quoted quotes wrote written word term insult insults slur phrase".split())
ADDRESS = frozenset("you your you're youre u ur yourself".split())
STEM_LENGTHS = (4, 5, 6, 7)


def tokens(text: Column) -> Column:
    """Words of the lower-cased text without punctuation at their ends."""
    return F.transform(words(F.lower(text)), lambda w: F.btrim(w, F.lit(EDGES)))


def learn_lexicon(documents: DataFrame, known: DataFrame) -> list[tuple[str, bool, float]]:
    """(term, is_stem, weight) found in toxic but hardly in other documents; ``known`` has doc_id, toxic (0 or 1).

    A term needs 5 toxic documents, at most half as many others, and a rate 100 times theirs; or, if it is too rare to show such a
    rate, no other document and evidence that chance does not explain (``rare_terms``). A stem (the
    first 4 to 7 characters of longer words) needs 4 % of the toxic documents, 15 times the others' rate, and four different words, none with most of its
    hits. The weight (up to 1) grows with the logarithm of that ratio; rare terms have the weight of a term at the limit.
    Terms that a shorter stem covers are left out. A stem is
    matched without errors, so the words seen under it in toxic documents follow as terms of its weight, unless others
    hold more than half as many; they carry its misspellings.
    """
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return []
    share = {k: LEXICON_ROWS[k] / counts[k] for k in (0, 1)}
    sample = known.filter(((F.col("toxic") == 1) & hash_share("doc_id", 21, share[1])) | ((F.col("toxic") == 0) & hash_share("doc_id", 21, share[0])))
    rows = documents.join(F.broadcast(sample), "doc_id").select("toxic", tokens(F.col("text")).alias("t"))
    # one of each group of copies, near ones included: documents that agree in the least hash of their 3-word windows
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size("t") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("t", i), F.get("t", i + 1), F.get("t", i + 2)))
    rows = rows.select("toxic", F.array_distinct("t").alias("t"), F.array_min(windows).alias("h"))
    rows = cut(rows.dropDuplicates(["h", "toxic"]), "toxic-sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = n.get(1, 0), n.get(0, 0)
    least = 5
    vocabulary = rows.select("toxic", F.explode("t").alias("term")).filter("length(term) BETWEEN 3 AND 40")
    vocabulary = vocabulary.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).filter("t > 0 OR c > 0")
    vocabulary = cut(vocabulary, "toxic-vocabulary")
    ratio = ((F.col("t") + 0.25) / (n_toxic + 0.5)) / ((F.col("c") + 0.25) / (n_other + 0.5))
    small = min(1.0, n_other / 400)  # few other documents cannot show a high ratio

    def telling(times: int) -> Column:
        return (F.col("t") >= least) & (2 * F.col("c") <= F.col("t")) & (ratio >= times * small)

    weight = F.least(F.lit(1.0), F.log(ratio) / float(np.log(500 * small + 1))).alias("weight")
    at_limit = min(1.0, float(np.log(100 * small) / np.log(500 * small + 1)))
    often = max(5, int(0.04 * n_toxic))
    single = vocabulary.filter(telling(100)).select("term", F.lit(False).alias("stem"), weight, (F.col("t") >= often).alias("often"))
    rare = rare_terms(rows, vocabulary, least).join(single, "term", "left_anti")
    single = single.union(rare.select("term", F.lit(False), F.lit(max(0.1, at_limit)), F.lit(False)))
    prefixes = F.filter(F.array(*[F.struct(F.substring("term", 1, k).alias("p"), (F.length("term") > k).alias("ok")) for k in STEM_LENGTHS]), lambda x: x["ok"])
    stems = vocabulary.select(F.explode(F.transform(prefixes, lambda x: x["p"])).alias("term"), "t", "c").groupBy("term")
    stems = stems.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.max("t").alias("most"), F.sum((F.col("t") > 0).cast("int")).alias("n"))
    stems = stems.filter(telling(15) & (F.col("t") >= often) & (F.col("n") >= 4) & (2 * F.col("most") <= F.col("t"))).select("term", F.lit(True).alias("stem"), weight, F.lit(True).alias("often"))
    found = sorted(((r["term"], r["stem"], round(r["weight"], 3), r["often"]) for r in single.union(stems).collect()), key=lambda x: (len(x[0]), not x[1], x[0]))
    kept: list[tuple[str, bool, float]] = []
    for term, stem, w, many in found:
        # a longer form is left out if a stem covers it and it tells no more, or is too rare to say so
        if not any(s and term.startswith(x) and (w <= v + 0.1 or not many) for x, s, v in kept):
            kept.append((term, stem, w))
    under = {x: v for x, s, v in reversed(kept) if s}
    if not under:
        return kept
    known_terms = {x for x, *_ in kept}
    full = vocabulary.filter("t > 0 AND 2 * c <= t").filter(F.length("term") >= LEAST_LENGTH).filter(F.exists(prefixes, lambda x: x["p"].isin(list(under))))
    for term in sorted(r["term"] for r in full.collect()):  # words of the sample
        if term not in known_terms:
            kept.append((term, False, next(under[term[:k]] for k in STEM_LENGTHS if term[:k] in under)))
    return kept


def rare_terms(rows: DataFrame, vocabulary: DataFrame, least: int) -> DataFrame:
    """Terms of ``vocabulary`` (term, t, c) that only toxic documents have, ``least`` of them or more, beyond chance.

    A document's chance to be toxic is taken from its other words (the mean share of toxic documents among those that
    have them), so words of a language or subject that toxic documents are often written in do not count as telling.
    The product over a term's documents is the chance that all of them are toxic; of all terms with as many documents, those are kept
    whose expected number of false ones is at most FALSE_SHARE of theirs (Benjamini-Hochberg).
    """
    share = vocabulary.select("term", ((F.col("t") + 0.5) / (F.col("t") + F.col("c") + 1.0)).alias("p"), (F.col("t") + F.col("c")).alias("n"))
    words_ = rows.select("h", "toxic", F.explode("t").alias("term")).join(share.filter("n >= 20"), "term")
    chance = words_.groupBy("h", "toxic").agg(F.avg("p").alias("p"))
    asked = vocabulary.filter((F.col("t") + F.col("c") >= least))
    alone = asked.filter("c = 0").select("term")
    found = rows.filter("toxic = 1").select("h", "toxic", F.explode("t").alias("term")).join(alone, "term").join(chance, ["h", "toxic"], "left")
    found = found.groupBy("term").agg(F.sum(F.log(F.least(F.coalesce("p", F.lit(1.0)), F.lit(1.0)))).alias("log_p"))
    tested = asked.count()
    order = Window.orderBy("log_p", "term")  # terms of the sample without other documents
    ranked = found.withColumn("r", F.row_number().over(order))
    last = ranked.filter(F.col("log_p") <= F.log(F.lit(FALSE_SHARE) * F.col("r") / F.lit(float(max(1, tested))))).agg(F.max("r")).first()[0] or 0
    return ranked.filter(F.col("r") <= last).select("term")


def hits(documents: DataFrame, lexicon: list[tuple[str, bool, float]]) -> DataFrame:
    """One row per document: doc_id, n_tokens and ``found``; map-only.

    found: array of (place, token, term, distance, weight, quoted), place counting the text's words from 0, token the word
    as it is written there.
    """
    automaton = LexiconAutomaton([x[:2] for x in lexicon])

    def weigh(at: int, first: int, last: int, raw: list[str], token: list[str], hit: set[int]) -> tuple[float, bool]:
        before, after = range(max(first, at - WINDOW), at), range(at + 1, min(last, at + WINDOW + 1))
        opened = any(raw[i][:1] in OPENING for i in [*before, at] if raw[i]) and any(raw[i].rstrip(".,;:!?")[-1:] in CLOSING for i in [at, *after] if raw[i].rstrip(".,;:!?"))
        near = {token[i] for i in before} | {token[i] for i in after}
        if opened or near & REPORT:
            return 0.3, True
        return 1.0 + 0.5 * bool(near & ADDRESS) + 0.25 * sum(i in hit for i in [*before, *after]), False

    def run(batches):
        for batch in slices(batches, "text"):
            offsets, raw = split_words(pc.utf8_lower(text_of(batch)))
            encoded = pc.utf8_trim(raw, characters=EDGES).dictionary_encode()
            codes = automaton.codes(encoded.dictionary.to_pylist())
            index = encoded.indices.to_numpy(zero_copy_only=False)
            places = np.flatnonzero(codes[index]) if len(index) else np.array([], np.int64)
            rows = np.searchsorted(offsets, places, "right") - 1
            n = batch.num_rows
            found = [[] for _ in range(n)]
            for row in np.unique(rows).tolist():
                first, last = int(offsets[row]), int(offsets[row + 1])
                own = places[rows == row] if len(places) < 1000 else places[np.searchsorted(rows, row) : np.searchsorted(rows, row, "right")]
                where, lo = set(own.tolist()), max(first, int(own[0]) - WINDOW)
                hi = min(last, int(own[-1]) + WINDOW + 1)
                raws, toks = raw.slice(lo, hi - lo).to_pylist(), encoded.dictionary.take(encoded.indices.slice(lo, hi - lo)).to_pylist()
                moved = {x - lo for x in where}
                for place in own.tolist():
                    code = int(codes[index[place]]) - 1
                    weight, quoted = weigh(place - lo, 0, hi - lo, raws, toks, moved)
                    found[row].append({"place": place - first, "token": toks[place - lo], "term": lexicon[code // 3][0], "distance": code % 3, "weight": weight * lexicon[code // 3][2], "quoted": quoted})
            kind = pa.struct([("place", pa.int64()), ("token", pa.string()), ("term", pa.string()), ("distance", pa.int32()), ("weight", pa.float64()), ("quoted", pa.bool_())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(found, pa.list_(kind))], ["doc_id", "n_tokens", "found"])

    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, n_tokens long, found array<struct<place: long, token: string, term: string, distance: int, weight: double, quoted: boolean>>"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _sum(which) -> Column:
    return F.aggregate(F.filter("found", which), F.lit(0.0), lambda acc, x: acc + x["weight"])


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: label 1 likelier), n_tokens and its hits.

    ``labels`` (doc_id, toxic) holds the rows to learn from; rows with a null id or label are ignored. With no rows of
    one label the score is the share of label 1 (0 without any). Null and empty texts have no hits and get the curve's
    value there; repeated rows are scored alike; other columns are ignored. A misspelling counts as its term does, unless
    that very word is used in the sample's label-0 documents at more than a twentieth of its rate in those of label 1;
    a word not seen in two toxic ones counts less the more words of others are near the same term.
    """
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    known = cut(known, "toxic-labels")
    lexicon = learn_lexicon(documents.select("doc_id", "text"), known)
    found = cut(hits(documents, lexicon), "toxic-hits")
    sample = bounded_sample(known, 22, FIT_ROWS)
    # words near a term that other documents use (unquoted) are their own words; other misspellings of the term still count
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    near = F.array_distinct(F.transform(F.filter("found", lambda x: (x["distance"] > 0) & ~x["quoted"]), lambda x: F.struct(x["token"], F.concat_ws("/", x["term"], x["distance"]).alias("key"))))
    seen = found.join(F.broadcast(sample), "doc_id").select("toxic", F.explode(near).alias("x"))
    seen = seen.groupBy("x.key", "x.token").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    seen = seen.withColumn("own", F.col("c") * 20 * n.get(1, 0) > F.col("t") * n.get(0, 0)).toPandas()  # near-misses of the sample's rows
    own, meant = seen[seen.own].token.tolist(), seen[~seen.own & (seen.t > 1)].token.tolist()
    # a word seen in at most one document counts by the share of misspellings among the words seen as near to that term
    trust = {k: float((2 + (~x).sum()) / (2 + len(x))) for k, x in seen.groupby("key").own if x.any()}
    shares = F.create_map(*[F.lit(x) for kv in (trust or {"": 1.0}).items() for x in kv])
    new = lambda x: F.coalesce(F.element_at(shares, F.concat_ws("/", x["term"], x["distance"])), F.lit(1.0))
    right = lambda x: F.when((x["distance"] == 0) | x["token"].isin(meant), 1.0).when(x["token"].isin(own), 0.0).otherwise(new(x))
    found = found.withColumn("found", F.transform("found", lambda x: x.withField("weight", x["weight"] * right(x))))
    found = found.withColumns(
        {
            "direct": _sum(lambda x: ~x["quoted"]),
            "quoted": _sum(lambda x: x["quoted"]),
        }
    )
    signals = [F.log1p("direct"), F.log1p("quoted")]
    rows = found.join(F.broadcast(sample), "doc_id").groupBy("toxic", *[F.round(x, 6).alias(f"x{i}") for i, x in enumerate(signals)]).agg(F.count("*").alias("n"))
    data = rows.toPandas().to_numpy(float)  # at most FIT_ROWS rows of 4 numbers
    if not len(data):
        return found.withColumn("score", F.lit(0.0))
    if len(np.unique(data[:, 0])) < 2:
        return found.withColumn("score", F.lit(float(data[0, 0])))
    beta = fit_logistic(data[:, 1:3], data[:, 0], data[:, 3], ridge=0.01)
    return found.withColumn("score", logistic(signals, beta))
