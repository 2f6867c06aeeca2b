"""Rare terms, confounded vocabularies and large lexicons."""

import numpy as np
import pytest

from webcorpus.llm import toxicity
from webcorpus.llm.automaton import LexiconAutomaton, allowed

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"


def invented(rng, n, letters="abcdefghijklmnoprstuvw", lo=6, hi=12):
    return ["".join(rng.choice(list(letters), rng.integers(lo, hi))) for _ in range(n)]


def test_sixty_rare_terms_are_learned(spark):
    """Each term in 1.7 % of the toxic documents and in no other one; they are told from ordinary words that are as rare."""
    rng = np.random.default_rng(3)
    common, rare, insults = invented(rng, 300), invented(rng, 4000), invented(rng, 60, lo=7, hi=11)
    rows, labels, used = [], [], {}
    for i in range(1400):
        w = [*rng.choice(common, 60), *rng.choice(rare, 8)]
        if i % 3 == 0:
            used[i] = insults[(i // 3) % 60]
            w[int(rng.integers(68))] = used[i]
        rows.append((i, " ".join(map(str, w))))
        labels.append((i, int(i % 3 == 0)))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS).filter("doc_id < 1000")
    lexicon = [x for x, stem, _ in toxicity.learn_lexicon(docs, known) if not stem]
    assert len(set(lexicon) & set(insults)) >= 57 and len(set(lexicon) - set(insults)) <= 6
    got = {r.doc_id: r.score for r in toxicity.score(docs, known).collect()}
    held = range(1000, 1400)
    assert sum(got[i] >= 0.5 for i in held if i % 3 == 0) >= 0.93 * sum(i % 3 == 0 for i in held)
    assert sum(got[i] >= 0.5 for i in held if i % 3) <= 0.03 * sum(i % 3 > 0 for i in held)


def test_words_of_a_language_that_toxic_documents_are_written_in(spark):
    """All toxic documents are in one of two languages; its rare ordinary words do not become terms."""
    rng = np.random.default_rng(4)
    first, second = (invented(rng, 300, letters) for letters in ("abcdefghijkl", "mnopqrstuvwx"))
    rare = {0: invented(rng, 1500, "abcdefghijkl"), 1: invented(rng, 1500, "mnopqrstuvwx")}
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        lang = 0 if toxic else i % 2
        w = [*rng.choice(first if lang == 0 else second, 50), *rng.choice(rare[lang], 8)]
        if toxic:
            w[3] = "zyxwvuzy"
        rows.append((i, " ".join(map(str, w))))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    words = {x for x, *_ in toxicity.learn_lexicon(docs, known)}
    assert "zyxwvuzy" in words and len(words) <= 4


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, left = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, left[j + 1] + 1, left[j] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("n", [1, 30, 1000])
def test_large_lexicons_in_several_tables(n):
    rng = np.random.default_rng(n)
    entries = [(w, False) for w in dict.fromkeys(invented(rng, n, lo=4, hi=12))] + [("qzq", True)]
    a = LexiconAutomaton(entries)
    assert n < 1000 or len(a.tables) > 5
    tokens = ["", "qzqx", "qz", *(w for w, _ in entries[:50])]
    for w, _ in entries[:: max(1, len(entries) // 60)]:
        for _ in range(4):
            t = list(w)
            for _ in range(rng.integers(1, 4)):
                k = int(rng.integers(0, len(t) + 1))
                t[k : k + int(rng.integers(0, 2))] = rng.choice(list("abcdefx"), int(rng.integers(0, 2))).tolist()
            tokens.append("".join(t))
    for token, code in zip(tokens, a.codes(tokens).tolist(), strict=True):
        near = [(0, i) for i, (w, s) in enumerate(entries) if s and token.startswith(w)]
        near += [(d, i) for i, (w, s) in enumerate(entries) if not s and abs(len(w) - len(token)) <= 2 and (d := distance(token, w)) <= allowed(w, s)]
        assert code == (1 + 3 * min(near)[1] + min(near)[0] if near else 0), token
