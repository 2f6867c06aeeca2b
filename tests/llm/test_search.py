"""Vector and lexical searches (operators 11 to 13) against brute force, with odd rows and small blocks."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from webcorpus.llm import cover_tree, hard_negatives, ranked_search
from webcorpus.llm.vectors import binary_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
VECTORS = "vec_id long, embedding array<double>, label int, size string, x string, row int"


def clusters(n: int, dim: int, seed: int) -> np.ndarray:
    """Random directions, groups of near copies of several widths, a chain, and exact and scaled copies."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(n):
        if i % 3 == 0:
            x[i] = x[i % 9] + rng.standard_normal(dim) * (0.05, 0.25, 0.33)[(i // 9) % 3]
    for i in range(1, 20):
        x[i * 3 + 1] = x[(i - 1) * 3 + 1] + rng.standard_normal(dim) * 0.4
    x[n - 10 :] = x[0] * np.array([1, 1, 1, 2, 0.5, 1e-9, 1e150, 3, 1, 1])[:, None]
    return x


def linked(ids, x, ok):
    """Links and components of every row by all pairs."""
    with np.errstate(all="ignore"):
        u = x / np.abs(x).max(axis=1, keepdims=True)
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        near = u @ u.T >= 0.9
    near &= ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    top = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.array([min([top[i], *top[near[i]]], key=lambda j: (ids[j] is None, ids[j])) for i in range(len(ids))])
        if (new == top).all():
            break
        top = new
    return near.sum(axis=1), [ids[t] for t in top]


@pytest.mark.parametrize("block", [8192, 40])
def test_cover_tree_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK_ROWS", block)
    x = clusters(300, 12, 3)
    ids = [1000 - i for i in range(300)]
    ids[5] = ids[6] = 40  # rows that share an id
    rows = [(i, v.tolist(), 0, "a", "b", 1) for i, v in zip(ids, x, strict=True)]
    odd = [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [1.0, None]), (2004, [float("inf")] * 12), (2005, []), (None, x[0].tolist()), (2006, [3.0]), (2007, [7.0] + [0.0] * 11)]
    rows += [(i, v, 0, "a", "b", 1) for i, v in odd]
    ids += [i for i, _ in odd]
    x = np.vstack([x, *[(v + [0.0] * (12 - len(v)) if v and None not in v else [0.0] * 12) for _, v in odd]])
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1) & np.array([i is not None for i in ids])
    x[~ok] = 1.0
    n, component = linked(ids, x, ok)
    want = sorted((str(i), int(a), str(c), i is not None and i == c) for i, a, c in zip(ids, n, component, strict=True))
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got.collect()) == want
    assert n.max() > 40 and cover_tree.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_tree_covers_and_traversal_counts():
    x = cover_tree.units(clusters(400, 8, 1))
    w = np.arange(1.0, 401.0)
    levels = cover_tree.build(x, w)
    for upper, lower in zip(levels, levels[1:], strict=False):
        assert (upper.node == upper.node[lower.centre][lower.node]).all() and set(upper.centre) <= set(lower.centre)
    for level in levels:
        away = cover_tree.chord(np.einsum("ij,ij->i", x, x[level.centre[level.node]]))
        assert (away <= level.radius[level.node] + 1e-7).all() and (level.size.sum(), level.weight.sum()) == (400, w.sum())
    near = x[:250] @ x[250:].T >= 0.9
    a, b = cover_tree.build(x[:250], w[:250]), cover_tree.build(x[250:], w[250:])
    count_a, count_b, top = cover_tree.traverse(x[:250], a, x[250:], b, 0.9, most=5000)
    assert (count_a == near @ w[250:]).all() and (count_b == near.T @ w[:250]).all()
    i, j = np.nonzero(near)
    assert (top[i] == top[j + 250]).all() and len(np.unique(top)) == len(np.unique(cover_tree.roots(400, i, j + 250)))


def mined(rows, anchors):
    """Brute force over (vec_id, whole components, label)."""
    out = []
    for a, x, label in rows:
        if not anchors(a):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y, strict=True)), b, m) for b, y, m in rows if b != a))
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            inside = [t for t in scored if t[2] != label and 30 * -s <= 100 * -t[0] <= 90 * -s]
            out += [(a, p, r, t[1], -s, -t[0]) for r, t in enumerate(inside[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 2048), (60, 7)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", blocks[1])
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 20)) * np.geomspace(1, 0.05, 20)
    x[100:140] = x[0] * rng.uniform(0.2, 1.5, (40, 1))  # one direction, many ties of windows
    x[140:150], x[150] = x[7], 0.0
    x[160] = -np.abs(x[160])
    data = [(i, v.tolist(), int(rng.integers(4)) if i % 50 else 9 if i == 50 else i % 4) for i, v in enumerate(x.round(3))]
    whole = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in data]
    odd = [(500, None, 1), (510, [1.0] * 20, None), (520, [float("nan")] * 20, 1), (530, [None] * 20, 1), (None, [1.0] * 20, 1), (540, [], 1), (550, [2.0, 1.0], 2)]
    whole += [(540, [0] * 20, 1), (550, [512, 256] + [0] * 18, 2)]
    rows = [(*r, "a", "b", 1) for r in data + odd] + [(*data[3], "a", "b", 1)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), "vec_id % 10 = 0").collect()
    want = mined(whole, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in got) == want and len(want) > 500
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, "vec_id % 10 = 0").count() == 0


def test_hard_negatives_send_a_round_of_anchors_at_a_time(spark, monkeypatch):
    """However many blocks of rows there are, no table is broadcast and each anchor goes to the executors once."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 60)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 12)).round(3)
    data = [(i, v.tolist(), int(rng.integers(3))) for i, v in enumerate(x)]
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or send(value))
    frame = spark.createDataFrame([(*r, "a", "b", 1) for r in data], VECTORS).repartition(3)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "256k")
    try:
        got = hard_negatives.mine(frame, "vec_id % 10 = 0").collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(tuple(r) for r in got) == mined([(i, [math.floor(256 * c) for c in v], label) for i, v, label in data], lambda i: i % 10 == 0)
    anchors = [v[0].tolist() for v in sent if len(v) == 3]
    assert sorted(sum(anchors, [])) == list(range(0, 1500, 10)) and len(anchors) == 3
    assert all(len(v[0]) <= 5 * 100 for v in sent)


def test_blocks_of_a_task():
    part = lambda a, n: pa.RecordBatch.from_arrays([pa.array(range(a, a + n), pa.int64()), pa.array([1] * n, pa.int64()), binary_rows(np.arange(a, a + n)[:, None] * np.array([1, 10]))], ["vec_id", "label", "x"])
    found = list(hard_negatives.blocks(iter([part(0, 3), part(3, 0), part(3, 9), part(12, 1)]), 4, 2, np.array([1, 0])))
    assert [len(b.ids) for b in found] == [4, 4, 4, 1] and np.concatenate([b.ids for b in found]).tolist() == list(range(13))
    assert (np.vstack([b.x for b in found]) == np.arange(13)[:, None] * np.array([10, 1])).all() and not list(hard_negatives.blocks(iter([]), 4, 2, np.array([0, 1])))


def test_pairs_reaching_threshold():
    rng = np.random.default_rng(2)
    x, q = (np.rint(rng.standard_normal((n, 30)) * np.geomspace(100, 1, 30)) for n in (500, 40))
    rest, q_rest = hard_negatives.suffix_norms(x), hard_negatives.suffix_norms(q)
    full = x @ q.T
    for share in (0.1, 0.5, 0.8, None):
        t = np.full(40, -np.inf) if share is None else share * q_rest[:, 0] * rest[:, 0].max()
        i, j, s = hard_negatives.pairs_reaching(x, rest, q, q_rest, t)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*[v.tolist() for v in np.nonzero(full >= t)], strict=True)) and (s == full[i, j]).all()


def ranked(documents, items, best):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs = [(d, TERM.findall(lower(t))) for d, t in documents]
    docs = [(d, Counter(t), len(t)) for d, t in docs if t]
    n_docs, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for i, terms in wanted.items():
        scored = []
        for k, (d, tf, n) in enumerate(docs):
            m = 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms & tf.keys())
            scored.append((-s, d is None, d or 0, k))
        out += [(i, r, None if x[1] else x[2], -x[0]) for r, x in enumerate([x for x in sorted(scored) if x[0] < 0][:best], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(16384, 256), (50, 3)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", sizes[0])
    monkeypatch.setattr(ranked_search, "BUNDLE_ITEMS", sizes[1])
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["Émile", "Ünder", "don", "日本語", "A", "I"]
    pick = lambda n: " ".join(vocabulary[int(len(vocabulary) * rng.random() ** 3)] for _ in range(n))
    docs = [(i, pick(int(rng.integers(1, 60)))) for i in range(500)]
    docs += [(900, None), (901, ""), (902, "?! _ {}\x00\x7f"), (3, "W1 w1, W1-w2"), (3, "W1 w1, W1-w2"), (None, "w5 w6 w7"), (903, pick(30000)), (904, "ÉMILE émile É"), (905, "x" * 300000 + " w9")]
    items = [(i, pick(12)) for i in range(8)] + [(8, None), (9, "nowhere"), (10, "w1 w1 W1"), (0, "w250 Émile"), (11, "?"), (12, "日本語 ünder Ünder I")]
    schema = "doc_id long, text string, size long, n long, row long, shard int"
    frame = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], schema).repartition(3)
    asked = spark.createDataFrame([(*i, "z", 7) for i in items], "item_id long, text string, term string, bundle int")
    got = ranked_search.rank(frame, asked, best=20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, 20)
    assert ranked_search.rank(frame.limit(0), asked).count() == 0 and ranked_search.rank(frame, asked.limit(0)).count() == 0
