"""corpus_pipeline: every stage against a plain version on a small corpus with odd rows, and run() as a whole."""

import itertools
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from webcorpus.llm import language_id, mixing, toxicity
from webcorpus.llm.queries import tokenizer_json

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in that it was for on with as his they at be this from have or by one had not but what all were when we there can an your which their said if will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ihre unter ihr wenn was ich können wir schon hier alle diese vom gegen sehr uns ohne jetzt".split()


def text(rng, words, n):
    return " ".join(words[int(len(words) * rng.random() ** 1.5)] for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(260):
        lang = "en" if i % 3 else "de"
        t = text(rng, EN if lang == "en" else DE, rng.randrange(60, 160))
        if i % 6 == 1:
            t = t.replace(" the ", " blitherhead ", 1) + " you blitherhead"
        out.append((i, t, lang, f"s{i % 4}", len(t)))
    base = [w for w in out[2][1].split()]
    for k in range(6):  # near copies, a chain of them, exact copies
        words = list(base)
        words[5 * k] = f"other{k}"
        out.append((300 + k, " ".join(words), "en", "s1", 0))
    out += [(310, out[4][1], "en", "s2", 0), (311, out[4][1].upper(), "en", "s2", 0), (7, out[7][1], out[7][2], "s3", 0)]
    out += [(400, None, None, None, None), (401, "", "en", "s0", 0), (None, "the of and to in that", "en", None, 0), (402, "12 34 56", "en", "s0", 0)]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, rows):
    d = tempfile.mkdtemp(prefix="wc-pipeline-", dir="/tmp")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 1, int("blitherhead" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] < 260]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_toxic_documents_go(spark, rows, sf_dir):
    docs = P.load(spark, sf_dir, "documents")
    kept = plain(P.toxicity_stage(spark, docs, sf_dir))
    assert kept == sorted((r for r in rows if "blitherhead" not in (r[1] or "")), key=str)
    folds = {r.doc_id for r in P.load(spark, sf_dir, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    known = spark.createDataFrame([(i, int("blitherhead" in (t or ""))) for i, t, *_ in rows if i in folds], "doc_id long, toxic int")
    scored = toxicity.score(docs, known)
    assert {r.doc_id for r in scored.filter("score >= 0.5").collect()} == {r[0] for r in rows if "blitherhead" in (r[1] or "")}


def test_documents_without_a_clear_language_go(spark, rows, sf_dir):
    docs = P.load(spark, sf_dir, "documents")
    kept = plain(P.language_stage(spark, docs, sf_dir))
    model = language_id.fit(docs.filter(f"{P.remainder('doc_id', 4)} != 2"))
    gone = {r.doc_id for r in language_id.predict(docs, model).filter("rejected").collect()}
    assert kept == sorted((r for r in rows if r[0] is None or r[0] not in gone), key=str)
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect() if r.doc_id is not None and r.doc_id < 260}
    assert sum(found[r[0]] == r[2] for r in rows if r[0] in found) > 0.97 * len(found)
    assert not gone & {r[0] for r in rows if r[0] is not None and r[0] < 260 and len(r[1]) > 200}  # clean documents stay


def shingles(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_one_document_of_each_group_stays(spark, rows, sf_dir):
    kept = plain(P.near_duplicate_stage(spark, P.load(spark, sf_dir, "documents"), sf_dir))
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    assert kept == sorted((r for r in rows if r[0] is None or root(r[0]) == r[0]), key=str)
    assert len({root(i) for i in sets}) < len(sets) - 6


def test_documents_as_often_as_the_mix_takes_them(spark, rows, sf_dir):
    docs = P.load(spark, sf_dir, "documents")
    got = Counter(plain(P.mixing_stage(spark, docs, sf_dir)))
    copies = Counter()
    for r in mixing.mixed_sizes(docs).collect():
        copies[r.doc_id] += r.n_copies
    by_id = defaultdict(int)
    for r, n in got.items():
        by_id[r[0]] += n
    assert {i: n for i, n in by_id.items()} == {i: n for i, n in copies.items() if n}
    assert set(got) <= set(rows) and max(got.values()) <= 3 * 2


def check_packing(packed, docs):
    """Pieces carry the ids of the documents, and sequences are filled without gaps."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json())
    want = Counter()
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            want[i, k // 2048, k, len(piece), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_packing_stage(spark, rows, sf_dir):
    packed = P.packing_stage(spark, P.load(spark, sf_dir, "documents"), sf_dir).collect()
    n = check_packing(packed, [(r[0], r[1]) for r in rows])
    assert n <= -(-sum(r.length for r in packed) // 2048) + 1


def test_run_is_its_stages(spark, rows, sf_dir):
    docs = P.load(spark, sf_dir, "documents")
    for _, stage in P.STAGES[:-1]:
        before = docs.columns
        docs = P.cut(stage(spark, docs, sf_dir), "by-hand")
        assert docs.columns == before
    packed = P.run(spark, sf_dir).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_empty_tables_pass_all_stages(spark, sf_dir):
    d = tempfile.mkdtemp(prefix="wc-pipeline-", dir="/tmp")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    P.load(spark, sf_dir, "labels").write.parquet(f"{d}/labels.parquet")
    assert P.run(spark, d).count() == 0
