import datetime as dt

from pyspark.sql import functions as F

from webcorpus.operators import extract as X
from webcorpus.operators import fetchlog as FL
from webcorpus.operators import sitemap as SM
from webcorpus.operators.html import parse_pages
from webcorpus.operators.markdown import render_markdown
from webcorpus.operators.windows import running_sums


def test_running_sums_keep_null_keys_orders_and_measures(spark):
    rows = [("a", 1, 10), ("a", None, 5), (None, 2, 1), (None, 1, None), ("a", 2_000_000, 7)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    out = running_sums(df, ["k"], ["seq"], {"total": F.col("v")}, count_col="n", partitions=3)
    got = {(r.k, r.seq): (r.total, r.n) for r in out.collect()}
    assert got == {("a", None): (5, 1), ("a", 1): (15, 2), ("a", 2_000_000): (22, 3), (None, 1): (0, 1), (None, 2): (1, 2)}


def test_attempts_follow_time_not_arrival(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=m)
    rows = [(1, "u", at(50)), (2, "u", at(40)), (3, "u", at(20)), (4, "u", at(30)), (5, "u", at(0)), (6, None, at(1)), (7, "u", None)]
    got = {r.seq: r.attempt_no for r in FL.attempt_numbers(spark.createDataFrame(rows, "seq long, url string, ts timestamp")).collect()}
    assert got == {7: 1, 5: 2, 3: 3, 4: 4, 2: 5, 1: 6, 6: 1}


def test_throughput_keeps_rows_without_a_site(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, "https://a.com/x", t, 10), (2, None, t, 5), (3, None, t, None)], "seq long, url string, ts timestamp, size_bytes long")
    assert {r.seq: (r.cum_requests, r.cum_bytes) for r in FL.throughput(log).collect()} == {1: (1, 10), 2: (1, 5), 3: (2, 5)}


def test_json_ld_lists_and_objects_are_no_text(spark):
    page = '<html><head><script type="application/ld+json">{"@type":"Article","headline":["x"],"author":%s,"image":%s}</script></head><body><h1>H</h1></body></html>'
    cases = [('[{"name":"A"}]', '["https://x/i.jpg"]'), ('{"@type":"Person"}', '{"@type":"ImageObject"}'), ('{"name":"Ann"}', '{"url":"/i.jpg"}'), ('"Bo"', '"https://x/j.jpg"')]
    df = spark.createDataFrame([(i, "https://a.com/p", page % c) for i, c in enumerate(cases)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in X.extract_metadata(parse_pages(df), with_timestamp=False).collect()}
    assert [rows[i].author for i in range(4)] == ["", "", "Ann", "Bo"]
    assert [rows[i].featured_image for i in range(4)] == ["", "", "https://a.com/i.jpg", "https://x/j.jpg"]
    assert {r.title for r in rows.values()} == {"H"}


def test_prefixed_sitemaps_keep_their_fields(spark):
    xml = ('<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"><sm:url><sm:loc>https://b.com/x</sm:loc>'
           "<sm:lastmod>2024-05-06</sm:lastmod><sm:priority>0.7</sm:priority><sm:changefreq>weekly</sm:changefreq></sm:url></sm:urlset>")
    (r,) = SM.read_sitemaps(spark.createDataFrame([("p", xml)], "sitemap_url string, xml string")).collect()
    assert (r.url, r.lastmod, r.priority, r.changefreq) == ("https://b.com/x", "2024-05-06", "0.7", "weekly")


def test_deep_pages_render():
    deep = render_markdown("<body>" + "<p>a" * 5000 + "</body>", main_content=False)["body"]
    assert deep.split() == ["a"] * 5000
    assert render_markdown("<body>" + "<b>" * 3000 + "x" + "</b>" * 3000 + "</body>")["body"].strip("*\n") == "x"


def test_image_names_never_clash():
    html = "<body>" + "".join(f'<img src="{s}">' for s in ("/x/a.png", "/y/a.png", "/z/a_1.png", "/w/a.png")) + "</body>"
    names = [n for _, n in render_markdown(html, "https://a.com/", image_dir="img")["images"]]
    assert names[:2] == ["a.png", "a_1.png"] and len(set(names)) == 4
