import json
import os
import tempfile

from pyspark.sql import functions as F

from webcorpus.operators import fetchlog as FL
from webcorpus.operators import media as M
from webcorpus.operators import report as R
from webcorpus.sources import io as IO
from webcorpus.sources import sinks as K
from webcorpus.sources.store import read_store


def _tmp():
    return tempfile.mkdtemp(prefix="wc-io-", dir="/tmp")


def test_read_url_lists(spark):
    d = _tmp()
    with open(f"{d}/a.json", "w") as f:
        json.dump(["https://a.com/1", {"url": "https://a.com/2"}, {"x": 1}], f)
    with open(f"{d}/b.txt", "w") as f:
        f.write("https://b.com/1\n\n   https://b.com/2  \n")
    with open(f"{d}/c.jsonl", "w") as f:
        f.write('"https://c.com/1"\n{"url": "https://c.com/2"}\nnot json\n')
    with open(f"{d}/bad.json", "w") as f:
        f.write("[oops")
    assert [r.url for r in IO.read_url_list(spark, f"{d}/a.json").orderBy("seq").collect()] == [
        "https://a.com/1", "https://a.com/2"]
    assert [r.url for r in IO.read_url_list(spark, f"{d}/b.txt").orderBy("seq").collect()] == [
        "https://b.com/1", "https://b.com/2"]
    assert [r.url for r in IO.read_url_list(spark, f"{d}/c.jsonl").orderBy("seq").collect()] == [
        "https://c.com/1", "https://c.com/2"]
    assert IO.read_url_list(spark, f"{d}/bad.json").count() == 0


def test_read_html_markdown_sidecars(spark):
    d = _tmp()
    os.makedirs(f"{d}/html")
    with open(f"{d}/html/p1.html", "wb") as f:
        f.write(b"<title>ok \xff bad</title>")
    with open(f"{d}/html/p2.htm", "w") as f:
        f.write("<p>x</p>")
    with open(f"{d}/html/skip.txt", "w") as f:
        f.write("no")
    with open(f"{d}/html/p1_meta.json", "w") as f:
        json.dump({"url": "https://s.com/a/p1", "title": "P1", "status_code": 200}, f)
    h = {r.stem: r for r in IO.read_html_files(spark, f"{d}/html").collect()}
    assert set(h) == {"p1", "p2"} and "�" in h["p1"].html
    side = IO.read_sidecars(spark, f"{d}/html")
    j = {r.stem: r for r in IO.with_sidecars(IO.read_html_files(spark, f"{d}/html"), side).collect()}
    assert j["p1"].base_url == "https://s.com" and j["p2"].base_url is None
    os.makedirs(f"{d}/site/pages/x")
    with open(f"{d}/site/pages/x/a.md", "w") as f:
        f.write("# A")
    md = IO.read_markdown(spark, f"{d}/site").collect()
    assert [(r.path, r.content) for r in md] == [("pages/x/a.md", "# A")]


def test_sinks_roundtrip(spark):
    d = _tmp()
    rows = spark.createDataFrame([("s1", "b", "line b"), ("s1", "a", "line a"), ("s2", "a", "other")],
                                 "site string, sort_key string, line string")
    K.write_lines(rows, f"{d}/lines", "site", ["sort_key"])
    s1 = [r.value for r in spark.read.text(f"{d}/lines/site=s1").collect()]
    assert s1 == ["line a", "line b"]
    log = spark.createDataFrame([(1, "https://a.com/x", 200)], "seq long, url string, status_code int")
    K.append_log(log, f"{d}/log")
    K.append_log(log, f"{d}/log")
    assert spark.read.json(f"{d}/log").count() == 2
    K.write_urls(log.select("url"), f"{d}/urls", "r1")
    assert spark.read.json(f"{d}/urls/run_id=r1").count() == 1
    pages = spark.createDataFrame([(1, "https://www.a.com/p/q", "<p>x</p>")], "page_id long, url string, html string")
    K.write_pages(pages, f"{d}/pages")
    back = read_store(spark, f"{d}/pages").first()
    assert back.site == "www_a_com" and back.mirror_path == "p/q.html"


def test_media_dedup_and_same_file(spark):
    media = spark.createDataFrame(
        [(1, "https://a.com/p", 0, "img", "https://a.com/i/x.png?v=1"),
         (1, "https://a.com/p", 1, "img", "https://a.com/i/x.png?v=2"),
         (2, "https://a.com/q", 0, "img", "http://a.com/i/x.png"),
         (2, "https://a.com/q", 1, "img", "https://cdn.b.com/y.png")],
        "page_id long, src_url string, pos int, kind string, url string")
    st = {(r.page_id, r.pos): r.status for r in M.media_status(media).collect()}
    assert st == {(1, 0): "downloaded", (1, 1): "exists", (2, 0): "skipped", (2, 1): None}
    local = spark.createDataFrame([("k1", bytearray(b"abc")), ("k2", bytearray(b"abcd"))], "url_key string, content binary")
    remote = spark.createDataFrame([("k1", None, bytearray(b"abcdef")), ("k2", 4, None)],
                                   "url_key string, size int, content binary")
    same = {r.url_key: r.same for r in M.same_file(local, remote).collect()}
    assert same == {"k1": True, "k2": True}


def test_fetchlog_labels_and_reports(spark):
    codes = spark.createDataFrame([(c,) for c in (200, 201, 299, 302, 404, 418, 503, 999, 100)], "c int")
    got = {r.c: r.l for r in codes.select("c", FL.status_label("c").alias("l")).collect()}
    assert got == {200: "OK", 201: "Created", 299: "Success", 302: "Found", 404: "Not Found", 418: "Client Error",
                   503: "Service Unavailable", 999: "Unknown", 100: "INFO"}
    errs = spark.createDataFrame([(i, f"u{i}") for i in range(13)], "i int, u string")
    lines = R.first_errors(errs, ["i"], F.concat(F.lit("- "), F.col("u")), "E").orderBy("rank").collect()
    assert [r.line for r in lines] == [f"- u{i}" for i in range(10)] + ["- ... and 3 more"]
    res = spark.createDataFrame(
        [("https://s.com/", "Root", "index.md", True), ("https://s.com/a", "B", "d/b.md", True),
         ("https://s.com/b", "A", "d/a.md", True), ("https://s.com/c", "Z", "d/e/z.md", True),
         ("https://s.com/f", "F", "d/f.md", False)],
        "url string, title string, markdown_path string, converted boolean")
    toc = [r.line for r in R.table_of_contents(res).orderBy("sort_key").collect()]
    assert toc == ["- [Root](index.md)", "- **d/**", "  - [A](d/a.md)", "  - [B](d/b.md)", "  - **e/**",
                   "    - [Z](d/e/z.md)"]
    idx = [r.line for r in R.site_index(res).orderBy("sort_key").collect()]
    assert idx[0] == "# Pages of s.com" and idx[6:12] == toc and idx[-1].startswith("Written on 2")
    own = [r.line for r in R.site_index(res, heading="{site}!", contents="C").orderBy("sort_key").collect()]
    assert own[0] == "# s.com!" and own[4] == "## C"


def test_media_refs_all_kinds(spark):
    from webcorpus.operators.html import parse_pages
    html = ("<link rel='preload stylesheet' href='/s.css'><script src='/a.js'></script><script>inline()</script>"
            "<img src=''><img src='i.png'><a href='/d/r.PDF?x=1'>d</a><a href='/x.html'>x</a>"
            "<video src='/v.mp4'></video><audio src='//cdn.o.org/a.mp3'></audio><source src='s.webm'>")
    df = parse_pages(spark.createDataFrame([(1, "https://h.com/p/q", html)], "page_id long, url string, html string"))
    got = [(r.pos, r.kind, r.url) for r in M.extract_media(df).orderBy("pos").collect()]
    assert got == [(0, "img", "https://h.com/p/i.png"), (1, "stylesheet", "https://h.com/s.css"),
                   (2, "script", "https://h.com/a.js"), (3, "document", "https://h.com/d/r.PDF?x=1"),
                   (4, "video", "https://h.com/v.mp4"), (5, "audio", "https://cdn.o.org/a.mp3"),
                   (6, "source", "https://h.com/p/s.webm")]
