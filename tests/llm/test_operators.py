"""The operators against brute force on small tables, with nulls, empty texts, ties, repeated rows and empty tables."""

import io
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from webcorpus.llm import language_id, mixing, ngram_join, one_bit_search, packing, quality_classifier, quality_rules, token_files, token_ids, toxicity, url_filters
from webcorpus.llm.automaton import LexiconAutomaton, allowed
from webcorpus.llm.queries import tokenizer_json

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, size string"
LONG = " ".join(f"w{i % 997}" for i in range(20000))
ODD = [
    (1, None, None, None, "x"), (2, "", "en", "a", "x"), (3, " \n\t ", "en", "a", "x"), (4, "one", "fr", "b", "x"),
    (5, "one two three four five\none two three four five\nsix", "en", "b", "x"), (6, LONG, "en", "a", "x"), (7, LONG, "en", None, "x"),
    (8, "É€😀 #$% <b> & | a\x0bb", "de", "c", "x"), (8, "É€😀 #$% <b> & | a\x0bb", "de", "c", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_counts_match_brute_force(odd, empty):
    got = {r.doc_id: r for r in quality_rules.score(odd).collect()}
    for doc_id, text, *_ in ODD:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.score(empty).count() == 0


def test_mix_meets_targets_and_agrees_with_sizes(spark, odd, empty):
    rows = [(i, "w " * (i % 7 + 1), "en", f"s{i % 4}", "x") for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = mixing.mixed_sizes(docs).toPandas()
    per = sizes.assign(taken=sizes["size"] * sizes.n_copies).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per.taken / per.target - 1) < 0.1).all() and sizes.n_copies.max() <= 3
    assert abs(per.target.sum() - sizes["size"].sum()) < 1e-6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sizes.n_copies.sum()
    assert mixing.mixed_sizes(odd).count() == len(ODD) and mixing.mix(empty).count() == 0


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), (None, 100)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["b"] == 30 and got[None] == 300 and abs(got["a"] - 780) < 1e-9


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, left = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, left[j + 1] + 1, left[j] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    entries = [("idiot", False), ("worthless", False), ("scum", False), ("stup", True)]
    a = LexiconAutomaton(entries)
    rng = np.random.default_rng(1)
    tokens = ["", "idiot", "idoit", "worthles", "wrthlss", "scumm", "stupendous", "stu"]
    for term, _ in entries:
        for _ in range(150):
            t = list(term)
            for _ in range(rng.integers(0, 4)):
                k = int(rng.integers(0, len(t) + 1))
                t[k : k + int(rng.integers(0, 2))] = rng.choice(list("idotwrhlescumxé"), int(rng.integers(0, 2))).tolist()
            tokens.append("".join(t))
    for token, code in zip(tokens, a.codes(tokens), strict=True):
        near = [_distance(token, t) for t, s in entries if not s and _distance(token, t) <= allowed(t, s)]
        stem = token.startswith("stup")
        assert (code > 0) == (bool(near) or stem), token
        if code and not stem:
            assert (code - 1) % 3 == min(near)


def test_toxicity_learns_terms_and_handles_odd_rows(spark, odd, empty):
    rng = np.random.default_rng(2)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "l", "sten")]
    rows, labels = [], []
    for i in range(300):
        w = rng.choice(vocabulary, 60).tolist()
        if i % 3 == 0:
            w[int(rng.integers(60))] = "moronic" if i < 270 else "morronic"
        rows.append((i, " ".join(w), "en", "a", "x"))
        labels.append((i, int(i % 3 == 0)))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, known.filter("doc_id < 240")).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(240, 300) if i < 270 or i % 3)
    none = known.filter("doc_id < 0")
    assert toxicity.score(odd, none).filter("score = 0").count() == len(ODD)
    assert toxicity.score(empty, known).count() == 0


def test_clean_word_near_a_term_leaves_other_misspellings(spark):
    """Clean documents use 'oron', one edit from the term 'moron'; 'm0ron' and 'morron' are still misspellings of it."""
    rng = np.random.default_rng(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "l", "sten")]
    rows, labels = [], []
    for i in range(360):
        w = rng.choice(vocabulary, 60).tolist()
        if i >= 300:
            w[int(rng.integers(60))] = ("m0ron", "morron", "oron")[i % 3]
        elif i % 3 == 0:
            w[int(rng.integers(60))] = "moron"
        elif i % 3 == 1:
            w[int(rng.integers(60))] = "oron"
        rows.append((i, " ".join(w), "en", "a", "x"))
        labels.append((i, int(i % 3 == 0)))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, known.filter("doc_id < 300")).collect()}
    assert all((got[i] >= 0.5) == (i % 3 < 2) for i in range(300, 360))
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(300))


def test_misspelled_starts_of_stems_are_found(spark):
    """The stem 'grom' covers five words; errors inside its four letters are still found."""
    rng = np.random.default_rng(10)
    vocabulary = [f"{a}{b}{c}" for a in "bdfk" for b in "aeiou" for c in ("n", "r", "l", "sten")]
    full, wrong = ["gromaduk", "gromileta", "gromosser", "gromybank", "gromefield"], ["gorm", "gr0m", "grm", "grrom"]
    rows, labels = [], []
    for i in range(330):
        w = rng.choice(vocabulary, 60).tolist()
        if i % 3 == 0:
            term = full[i // 3 % 5]
            w[int(rng.integers(60))] = term if i < 270 else wrong[i // 3 % 4] + term[4:]
        rows.append((i, " ".join(w), "en", "a", "x"))
        labels.append((i, int(i % 3 == 0)))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    known = known.filter("doc_id < 270")
    assert ("grom", True) in [x[:2] for x in toxicity.learn_lexicon(docs, known)]
    got = {r.doc_id: r.score for r in toxicity.score(docs, known).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(330))


def test_classifiers_handle_odd_rows(spark, odd, empty):
    model = language_id.fit(odd)
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and got[6].lang_pred == "en"
    assert language_id.predict(odd, {}).filter("lang_pred = 'und'").count() == len(ODD)
    assert language_id.predict(empty, model).count() == 0
    labels = spark.createDataFrame([(6, 1), (4, 0), (5, 0), (7, 1), (None, 1)], "doc_id long, quality int")
    scores = quality_classifier.score(odd, labels).select("score").toPandas().score
    assert len(scores) == len(ODD) and scores.between(0, 1).all()
    assert quality_classifier.score(empty, labels).count() == 0


def test_language_margin_does_not_shrink_with_length(spark):
    """A clear text stays clear when it is long or repeats itself."""
    rng = np.random.default_rng(8)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(150)] for lang, letters in (("en", "abcdeghilm"), ("de", "nopqrstuvw"))}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n).tolist())
    model = language_id.fit(spark.createDataFrame([(i, text(lang, 150), lang, "a", "x") for i, lang in enumerate(["en", "de"] * 60)], SCHEMA))
    rows = []
    for i, lang in enumerate(("en", "de")):
        paragraph = text(lang, 300)
        rows += [(10 * i, paragraph, lang, "a", "x"), (10 * i + 1, f"{paragraph} " * 400, lang, "a", "x"), (10 * i + 2, text(lang, 60000), lang, "a", "x")]
        rows += [(10 * i + 3, (text(lang, 8) + " ") * 8000, lang, "a", "x")]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected for i, _, lang, *_ in rows)
    for i in (0, 10):
        assert min(got[i + 1].margin, got[i + 2].margin) > 0.7 * got[i].margin


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer

    content = tokenizer_json()
    texts = ["", " a  b\n", "<|startoftext|> X <|ENDOFTEXT|>h", "don't STOP's É́ H̱  x\x85y \x1cz", "İstanbul ΣΑΣ ﬁ ½ 12,345!!", LONG]
    offsets, ids = token_ids.Encoder(content).ids(pa.array(texts))
    own = Tokenizer.from_str(content)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == own.encode(t, add_special_tokens=False).ids


def test_plan_equals_best_fit_decreasing_one_by_one():
    rng = np.random.default_rng(3)
    for capacity in (7, 20, 64):
        lengths = np.sort(rng.integers(1, capacity + 1, 400))[::-1]
        rooms = []
        for n in lengths.tolist():
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms[rooms.index(min(fits))] -= n
            else:
                rooms.append(capacity - n)
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        used = {}
        runs = packing.plan(counts, capacity)
        for length, first, sequence, each, offset in runs.tolist():
            later = [r[1] for r in runs.tolist() if r[0] == length and r[1] > first]
            for k in range((min(later) if later else counts[length]) - first):
                used.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
        assert sorted(capacity - sum(n for _, n in x) for x in used.values()) == sorted(rooms)
        for x in used.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:], strict=False)) and sorted(x)[0][0] == 0


def test_packed_pieces_cover_odd_rows(odd, empty):
    got = packing.pack(odd, tokenizer_json()).toPandas()
    assert got.length.max() <= packing.CAPACITY and (got.start == got.piece * packing.CAPACITY).all()
    assert got[got.doc_id == 1].length.tolist() == [1] and (got.ids.map(len) == 4 * got.length).all()
    assert len(got[got.doc_id == 8]) == 2
    assert packing.pack(empty, tokenizer_json()).count() == 0


def test_token_files_round_trip_and_partial_reads(odd, empty):
    got = token_files.write_and_read(odd, tokenizer_json()).toPandas().sort_values(["start"])
    assert got.doc_id.tolist() == sorted(i for i, *_ in ODD) and got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]]
    assert (got.ids.map(len) == 4 * got.n_tokens).all()
    assert token_files.write_and_read(empty, tokenizer_json()).count() == 0
    out = io.BytesIO()
    writer = token_files.Writer(out, frame_ids=10)
    writer.add(np.arange(20), np.arange(0, 105, 5), np.arange(100, dtype=np.uint32))
    writer.close()
    reader = token_files.Reader(io.BytesIO(out.getvalue()))
    assert reader.documents(7)[0].tolist() == list(range(35, 40)) and reader.frames_read == 1 and len(reader.frames) == 10
    damaged = bytearray(out.getvalue())
    damaged[12] ^= 1
    with pytest.raises(Exception):
        token_files.Reader(io.BytesIO(bytes(damaged))).frame(0)


def _brute_components(rows, n, percent):
    fold = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(fold))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("blocks", [(1000, 32, 2000), (3, 8, 30)])
def test_ngram_join_equals_all_pairs(spark, empty, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCUMENTS", blocks[0])
    monkeypatch.setattr(ngram_join, "PAIRED", blocks[1])
    monkeypatch.setattr(ngram_join, "PRODUCT_DOCUMENTS", blocks[2])
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 500, 60).tolist() for _ in range(4)]
    rows = list({r[0]: r for r in ODD}.values())
    for i in range(100, 180):
        w = list(bases[i % 4])
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(60))] = int(rng.integers(0, 500))
        rows.append((i, " ".join(f"T{x}" for x in w), "en", "a", "x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _brute_components(rows, 4, 85)
    assert ngram_join.join(empty).count() == 0


def test_search_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 16))
    x[300:600] = x[0]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = one_bit_search.search(df, df.filter("vec_id % 20 = 0"), 20).toPandas()
    hit = 0
    for q in range(0, 900, 20):
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(900), -np.round(scores, 9))) if i != q][:20]
        own = got[got.query_id == q].sort_values("rank")
        assert len(own) == 20 and np.allclose(own.score, scores[own.vec_id])
        hit += len(set(own.vec_id) & set(order))
    assert hit / (45 * 20) >= 0.9 and not set(got.query_id) & {900, 901, 902, 903}
    assert one_bit_search.search(df.filter("vec_id < 0"), df, 20).count() == 0


def test_search_takes_the_length_from_the_searched_table(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((60, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    mixed = [(100 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((6, 16)))] + [(i, x[i].tolist()) for i in range(3)]
    got = one_bit_search.search(vectors, spark.createDataFrame(mixed, "vec_id long, embedding array<double>"), 5).toPandas()
    assert set(got.query_id) == {0, 1, 2} and np.allclose(got.score, (x[got.query_id] * x[got.vec_id]).sum(axis=1))


def test_url_intervals_and_odd_captures(spark):
    entries = spark.createDataFrame(
        [("m", "Bad.com", "add", 10), ("m", "bad.com", "add", 12), ("m", "bad.com", "remove", 20), ("m", "bad.com", "add", 30), ("a", "ok.org/x", "add", 5), ("a", None, "add", 1), ("a", "z.org", "what", 1)],
        "list string, pattern string, action string, at int",
    )
    captures = [(1, "https://www.bad.com/p", 10), (2, "https://www.bad.com/p", 20), (3, "http://bad.com", 31), (4, "http://ok.org/x/y?q", 6), (5, "http://ok.org/xy", 6), (6, None, 6), (7, "nonsense", 6), (8, "http://bad.com/", None), (9, "http://notbad.com/", 15)]
    got = {r.capture_id: (r.blocked, r.list, r.since) for r in url_filters.evaluate(spark.createDataFrame(captures, "capture_id int, url string, fetched int"), entries).collect()}
    assert got[1] == (True, "m", 10) and got[3] == (True, "m", 30) and got[4] == (True, "a", 5)
    assert all(got[i] == (False, None, None) for i in (2, 5, 6, 7, 8, 9))


def test_checksum_of_ids_is_crc32():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
