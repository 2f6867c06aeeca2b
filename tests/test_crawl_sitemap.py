import random
import tempfile
from collections import deque
from urllib.parse import urljoin, urlsplit

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from webcorpus.operators import exclusion as EX
from webcorpus.operators import frontier as FR
from webcorpus.operators import sitemap as SM
from webcorpus.operators.html import parse_html
from webcorpus.sources.fixtures import fx_pages, fx_web

SF = "/root/testdata/sf0.001"


def _key(u):
    s = urlsplit(u)
    return f"{s.scheme}://{s.netloc}{s.path}"


def _brute_bfs(pages, seeds, max_pages):
    """The reference's FIFO crawl on an in-memory corpus of (page_id, url, html[, status, type]) (scope 'any', fragments
    dropped): the visits in order, as (url, outcome)."""
    by_key = {}
    for pid, url, html, *answer in sorted(pages, key=lambda p: p[0]):
        by_key.setdefault(_key(url), (url, html, *(answer or (200, "text/html"))))
    to_visit, visited, out = deque(seeds), set(), []
    while to_visit and (max_pages is None or len(visited) < max_pages):
        cur = to_visit.popleft()
        if cur in visited:
            continue
        visited.add(cur)
        base, html, status, kind = by_key.get(_key(cur), (None, None, None, None))
        if status is None or "text/html" not in (kind or ""):
            out.append((cur, "failed" if status is None else "not_html"))
            continue
        out.append((cur, "page"))
        for n in parse_html(html) or []:
            href = (n["attrs"] or {}).get("href") if n["tag"] == "a" else None
            if not href or href.startswith("#") or href.startswith("javascript:"):
                continue
            u = urljoin(base, href)
            if urlsplit(u).query:
                s = urlsplit(u)
                u = f"{s.scheme}://{s.netloc}{s.path}"
            u = u.split("#", 1)[0]
            if u not in visited and u not in to_visit:
                to_visit.append(u)
    return out


@pytest.mark.parametrize("budget", [3, 7, 40])
def test_crawl_matches_fifo_bfs(spark, budget):
    pages_df = fx_pages(spark, SF)
    rows = [(r.page_id, r.url, r.html) for r in pages_df.collect()]
    start = sorted(rows)[0][1]
    expected = [u for u, how in _brute_bfs(rows, [start], budget) if how == "page"]
    got = FR.crawl(pages_df, start, max_pages=budget, scope="any").orderBy("depth", "order").collect()
    assert [r.url for r in got] == expected


@pytest.mark.parametrize("budget", [1, 2, 60, 333, None])
def test_crawl_with_seeds_and_outcomes(spark, budget):
    """Several seeds, errors, other types and missing answers; the budget ends inside levels."""
    pages_df = fx_web(spark, SF)
    rows = [(r.page_id, r.url, r.html, r.status_code, r.content_type) for r in pages_df.collect()]
    by_id = {r[0]: r[1] for r in rows}
    seeds = [by_id[4], by_id[1], "https://nowhere.example/x", by_id[4], by_id[9]]
    got = FR.crawl(pages_df, seeds, max_pages=budget, scope="any", keep_failed=True).orderBy("order").collect()
    assert [(r.url, r.outcome) for r in got] == _brute_bfs(rows, seeds, budget)
    assert [r.order for r in got] == list(range(len(got)))
    assert all((r.title is None) == (r.outcome != "page") for r in got)


def test_crawl_of_random_graphs_in_rounds_of_any_size(spark, monkeypatch):
    rng = random.Random(3)
    for n, degree, hops, place in ((60, 2, 8, 16), (60, 3, 3, 4), (40, 1, 8, 2), (30, 0, 2, 5)):  # the last is a long chain
        monkeypatch.setattr(FR, "MAX_HOPS", hops)
        monkeypatch.setattr(FR, "MAX_PLACE", place)
        links = {i: [rng.randrange(n) for _ in range(degree)] + [i + 1] * (degree == 0 or rng.random() < 0.7) for i in range(n)}
        rows = [(i, f"https://h{i % 3}.org/{i}", "".join(f'<a href="https://h{j % 3}.org/{j}">x</a>' for j in rng.sample(t, len(t))),
                 None if i % 11 == 7 else 200, "text/html" if i % 9 else "image/png") for i, t in links.items()]
        df = spark.createDataFrame(rows, "page_id long, url string, html string, status_code int, content_type string")
        for budget in (None, n // 2):
            got = FR.crawl(df, rows[1][1], max_pages=budget, scope="any", keep_failed=True).orderBy("order").collect()
            assert [(r.url, r.outcome) for r in got] == _brute_bfs(rows, [rows[1][1]], budget)


def test_crawl_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert FR.crawl(empty, []).count() == 0
    assert [r.outcome for r in FR.crawl(empty, "https://a.com/", keep_failed=True).collect()] == ["failed"]


SITEMAP = """<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
<url><loc>https://a.com/1</loc><lastmod>2024-01-02</lastmod><priority>0.5</priority></url>
<url><loc> </loc></url><url><loc>https://a.com/2</loc><changefreq>daily</changefreq></url></urlset>"""
PREFIXED = """<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"><sm:url><sm:loc>https://b.com/x</sm:loc></sm:url></sm:urlset>"""
INDEX = """<sitemapindex><sitemap><loc>https://a.com/s1.xml</loc></sitemap><sitemap><loc>https://a.com/s2.xml</loc></sitemap>
<sitemap><loc>https://a.com/index.xml</loc></sitemap></sitemapindex>"""
S2 = """<urlset><url><loc>https://a.com/3</loc></url><url><loc>https://a.com/4</loc></url></urlset>"""


def test_read_sitemaps_variants(spark):
    df = spark.createDataFrame([("s1", SITEMAP), ("p", PREFIXED), ("bad", "<urlset><url><loc>x</loc>"), ("i", INDEX)],
                               "sitemap_url string, xml string")
    rows = {(r.sitemap_url, r.url): r for r in SM.read_sitemaps(df).collect()}
    assert set(rows) == {("s1", "https://a.com/1"), ("s1", "https://a.com/2"), ("p", "https://b.com/x")}
    r = rows[("s1", "https://a.com/1")]
    assert r.lastmod == "2024-01-02" and r.priority == "0.5" and r.priority_d == 0.5 and r.title == r.url
    assert rows[("s1", "https://a.com/2")].changefreq == "daily" and r.status_code == 200
    kids = [(r.child, r.pos) for r in SM.index_children(df).orderBy("pos").collect()]
    assert kids == [("https://a.com/s1.xml", 0), ("https://a.com/s2.xml", 1), ("https://a.com/index.xml", 2)]


@pytest.mark.parametrize("cap,expected", [(10, ["https://a.com/1", "https://a.com/2", "https://a.com/3", "https://a.com/4"]),
                                          (3, ["https://a.com/1", "https://a.com/2", "https://a.com/3"])])
def test_expand_index_cycle_and_cap(spark, cap, expected):
    sm = spark.createDataFrame([("https://a.com/index.xml", INDEX), ("https://a.com/s1.xml", SITEMAP),
                                ("https://a.com/s2.xml", S2)], "sitemap_url string, xml string")
    roots = spark.createDataFrame([("https://a.com/index.xml",)], "root string")
    got = SM.expand_sitemaps(sm, roots, max_pages=cap).orderBy("order").collect()
    assert [r.url for r in got] == expected


def test_exclude_urls(spark):
    df = spark.createDataFrame([("https://a.com/tag/x",), ("https://a.com/p",), (None,)], "url string")
    assert [r.url for r in FR.exclude_urls(df, [r"/tag/"]).collect()] == ["https://a.com/p", None]


def test_fixture_pages_counts():
    n = pq.read_metadata(f"{SF}/pages.parquet").num_rows
    assert n == 50
    _ = F


def test_scope_rules(spark):
    df = spark.createDataFrame([("https://a.com/x",), ("https://a.com.evil.org/y",), ("http://a.com/z",), ("https://b.org/q",)], "target string")
    seeds = spark.createDataFrame([("https://a.com/start",), ("https://b.org/",)], "url string")
    got = {s: sorted(r.target for r in FR.in_scope(df, seeds, s).collect()) for s in ("origin", "prefix", "any")}
    assert got["origin"] == ["https://a.com/x", "https://b.org/q"]
    # the reference's prefix quirk (Q4)
    assert got["prefix"] == ["https://a.com.evil.org/y", "https://a.com/x", "https://b.org/q"]
    assert len(got["any"]) == 4


def test_exclude_by_a_large_table(spark, monkeypatch):
    rng = random.Random(1)
    urls = [f"https://h{rng.randrange(40)}.example/{rng.choice(['tag', 'a', 'p'])}/{rng.randrange(500)}?q={rng.randrange(9)}" for _ in range(400)] + [None, ""]
    patterns = [rf"h{rng.randrange(60)}\.example/(tag|p)/{rng.randrange(2000)}\b" for _ in range(9990)]
    patterns += [r"/\d{3}\?q=[0-2]$", "(?i)TAG/1", r"(?:a/)+49", "q=8|q=7/x", r"x*y?", None][:4] + [None]
    import re
    found = [re.compile(p) for p in patterns if p is not None]
    want = sorted(str(u) for u in urls if u is None or not any(p.search(u) for p in found))
    df = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, n int")
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    assert sorted(str(r.url) for r in FR.exclude_urls(df, table).collect()) == want and 100 < len(want) < 400
    monkeypatch.setattr(EX, "PATTERN_BYTES", 100_000)  # more patterns than one automaton takes
    monkeypatch.setattr(EX, "URL_GROUPS", 4)
    assert sorted(str(r.url) for r in FR.exclude_urls(df, table).collect()) == want
    assert FR.exclude_urls(df, table.limit(0)).count() == len(urls)


def test_required_literals():
    cases = {r"/tag/": "/tag/", r"a(?:bcd)+e": "bcd", r"(ab|cd)efg?": "ef", r"(?i)abc": "", r"[0-9]{5}": "", r"^https://x\.org$": "https://x.org", r"ab*cde": "cde"}
    assert {p: EX.required_literal(p) for p in cases} == cases


def test_sitemap_files_are_split(spark):
    d = tempfile.mkdtemp(prefix="wc-sitemaps-", dir="/tmp")
    big = "<urlset>" + "".join(f"<url><loc>https://a.com/{i}</loc><lastmod>2024-01-02</lastmod></url>\n" for i in range(60000)) + "</urlset>"
    for name, text in (("big.xml", big), ("prefixed.xml", PREFIXED), ("small.xml", SITEMAP)):
        with open(f"{d}/{name}", "w") as f:
            f.write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = SM.read_sitemap_files(spark, d)
        by_file = {r.f: (r.n, r.parts) for r in rows.withColumn("part", F.spark_partition_id()).groupBy(
            F.regexp_extract("sitemap_url", "([^/]*)$", 1).alias("f")).agg(F.countDistinct("url").alias("n"), F.countDistinct("part").alias("parts")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert by_file["big.xml"][0] == 60000 and by_file["big.xml"][1] > 2
    assert by_file["prefixed.xml"][0] == 1 and by_file["small.xml"][0] == 2
    whole = spark.createDataFrame([("s", SITEMAP), ("p", PREFIXED)], "sitemap_url string, xml string")
    columns = ["url", "title", "status_code", "lastmod", "priority", "changefreq", "priority_d"]
    want = sorted(map(str, SM.read_sitemaps(whole).select(columns).collect()))
    assert sorted(map(str, rows.where("sitemap_url NOT LIKE '%big.xml'").select(columns).collect())) == want


def test_crawl_origin_scope_and_failed_visits(spark):
    pages_df = fx_pages(spark, SF)
    start = sorted((r.page_id, r.url) for r in pages_df.select("page_id", "url").collect())[0][1]
    ok = FR.crawl(pages_df, start, max_pages=50, scope="origin").collect()
    allv = FR.crawl(pages_df, start, max_pages=50, scope="origin", keep_failed=True).collect()
    assert [r.url for r in ok] == [start]  # same-origin nav links are not in the corpus
    assert len(allv) > 1 and all(r.status_code is None for r in allv if r.url != start)


def test_crawl_walks_long_chains_in_few_rounds(spark, monkeypatch):
    """Two chains that merge, forks after hundreds of pages, a circle at the end, and pages outside: visits and order are the
    FIFO crawl's, and the rounds do not follow the number of levels."""
    n = 420
    links = {i: [i + 1] for i in range(n - 1)} | {n - 1: [100], 250: [300, 251, 10], 320: [321, 400, 5]}
    links |= {1000 + i: [1001 + i] for i in range(60)} | {1060: [200, 1060], 0: [1000, 1]}
    rows = [(i, f"https://h{i % 3}.org/{i}", f'<a href="/out/{i % 7}">o</a>' + "".join(f'<a href="https://h{j % 3}.org/{j}">x</a>' for j in to))
            for i, to in links.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    rounds, plain = [], FR._round
    monkeypatch.setattr(FR, "_round", lambda *a: rounds.append(a[3]) or plain(*a))
    got = FR.crawl(df, rows[0][1], scope="any", keep_failed=True).orderBy("order").collect()
    assert [(r.url, r.outcome) for r in got] == _brute_bfs(rows, [rows[0][1]], None)
    assert len(rounds) < 16
