"""URL filters: addresses, dots at a host's end, a list too long to be looked up row by row, empty tables."""

import random

from webcorpus.llm import url_filters

CAPTURES, ENTRIES = "capture_id long, url string, fetched int, pattern string, list string", "list string, pattern string, action string, at int"


def test_addresses_match_themselves_only(spark):
    urls = ["http://[::1]/a", "http://10.1.2.3/x", "https://a.com./p", "https://u:p@B.a.com:8080/p/q?r", "https://xa.com/", None, "mailto:x@a.com", "http://[::1]:80/"]
    captures = spark.createDataFrame([(i, u, 5, "p", "l") for i, u in enumerate(urls)], CAPTURES)
    entries = spark.createDataFrame([("m", p, "add", 1) for p in ("2.3", "[::1]", "a.com", ":1]", "3")] + [("n", "10.1.2.3", "add", 9), (None, "a.com", "add", 1)], ENTRIES)
    got = {r.capture_id: r.pattern for r in url_filters.evaluate(captures, entries).collect()}
    assert got == {0: "[::1]", 1: None, 2: "a.com", 3: "a.com", 4: None, 5: None, 6: None, 7: "[::1]"}
    later = {r.capture_id: r.pattern for r in url_filters.evaluate(captures.withColumn("fetched", captures.fetched + 5), entries).collect()}
    assert later[1] == "10.1.2.3"


def test_many_entries_equal_brute_force(spark):
    rng = random.Random(2)
    hosts = [f"{rng.choice(['www', 'm', 'x'])}.h{i}.{rng.choice(['com', 'org'])}" for i in range(300)]
    entries = [(rng.choice("ab"), rng.choice([h, h.split(".", 1)[1], h + "/p"]), rng.choice(["add", "add", "remove"]), rng.randrange(20)) for h in hosts for _ in range(4)]
    captures = [(i, f"https://{rng.choice(hosts)}/{rng.choice('pq')}/{i}", rng.randrange(25), "x", "y") for i in range(800)]
    state: dict = {}
    for lst, p, _, at in entries:
        state.setdefault((lst, p), {}).setdefault(at, set())
    for lst, p, action, at in entries:
        state[lst, p][at].add(action)
    want = {}
    for i, url, day, *_ in captures:
        host, step = url.split("/")[2:4]
        on = []
        for (lst, p), turns in state.items():
            if not (p == host or host.endswith("." + p) or p == f"{host}/{step}"):
                continue
            since = None
            for at in sorted(turns):
                if at <= day:
                    since = None if "remove" in turns[at] else since if since is not None else at
            if since is not None:
                on.append((lst, p, since))
        want[i] = (len(on), *(min(on) if on else (None, None, None)))
    found = url_filters.evaluate(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES))
    assert {r.capture_id: (r.n_active, r.list, r.pattern, r.since) for r in found.collect()} == want


def test_empty_tables(spark):
    captures, entries = spark.createDataFrame([], CAPTURES), spark.createDataFrame([], ENTRIES)
    one = spark.createDataFrame([(1, "https://a.com/", 1, "p", "l")], CAPTURES)
    assert url_filters.evaluate(captures, entries).count() == 0
    assert [(r.blocked, r.n_active) for r in url_filters.evaluate(one, entries).collect()] == [(False, 0)]
