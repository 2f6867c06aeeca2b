import random

from pyspark.sql import functions as F

from webcorpus.operators.windows import first_wins, number_rows, running_sums, top_k_per_group


def _rows(n=3000, seed=5):
    rng = random.Random(seed)
    # one hot key holding about a third of the rows
    return [(i, "hot" if rng.random() < 0.34 else f"k{rng.randint(0, 40)}", rng.randint(0, 9)) for i in range(n)]


def test_running_sums_match_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "seq long, key string, v int")
    got = running_sums(df, ["key"], ["seq"], {"cum_v": F.col("v").cast("bigint")}, count_col="n", partitions=13).collect()
    acc, cnt, exp = {}, {}, {}
    for seq, key, v in sorted(rows):
        acc[key] = acc.get(key, 0) + v
        cnt[key] = cnt.get(key, 0) + 1
        exp[seq] = (acc[key], cnt[key])
    assert {r.seq: (r.cum_v, r.n) for r in got} == exp


def test_top_k_and_first_wins(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "seq long, key string, v int")
    got = top_k_per_group(df, ["key"], ["seq"], 5, buckets=8, rank_col="r").collect()
    exp = {}
    for seq, key, _ in sorted(rows):
        exp.setdefault(key, [])
        if len(exp[key]) < 5:
            exp[key].append(seq)
    g = {}
    for r in got:
        g.setdefault(r.key, []).append((r.r, r.seq))
    assert {k: [s for _, s in sorted(v)] for k, v in g.items()} == exp
    glob = [r.seq for r in top_k_per_group(df, [], ["seq"], 7, buckets=8).orderBy("seq").collect()]
    assert glob == list(range(7))
    fw = {r.seq for r in first_wins(df, ["key"], F.col("seq")).where("is_first").collect()}
    assert fw == {min(s for s, k, _ in rows if k == key) for key in {k for _, k, _ in rows}}


def test_number_rows(spark):
    rows = _rows(2000) + [(None, "x", 1)]
    df = spark.createDataFrame(rows, "seq long, key string, v int")
    got = number_rows(df, ["key", "seq"], "n", partitions=7).orderBy("n").collect()
    assert [r.n for r in got] == list(range(2001))
    assert [(r.key, r.seq) for r in got] == sorted(((k, s) for s, k, _ in rows), key=lambda x: (x[0], x[1] is not None, x[1]))
    assert number_rows(df.limit(0), ["seq"], "n").count() == 0


def test_running_sums_with_bursts_and_sparse_values(spark):
    """Buckets follow rows, not values: one burst at one time, and numbers that lie far apart."""
    rows = [(7, i, "hot", 1) for i in range(500)] + [(i * 10**12, 1000 + i, "sparse", 2) for i in range(300)] + [(3, 5000, "hot", 5)]
    df = spark.createDataFrame(rows, "ts long, seq long, key string, v int")
    plan = running_sums(df, ["key"], ["ts", "seq"], {"s": F.col("v").cast("bigint")}, partitions=10)
    got = {(r.key, r.ts, r.seq): r.s for r in plan.collect()}
    want, at = {}, {}
    for ts, seq, key, v in sorted(rows):
        at[key] = at.get(key, 0) + v
        want[key, ts, seq] = at[key]
    assert got == want
