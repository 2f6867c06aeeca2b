import posixpath
import random
from urllib.parse import unquote, urljoin, urlsplit

from pyspark.sql import functions as F

from webcorpus.functions import urls as U

PIECES = ["", "a", "b", "..", ".", "c.html", "x y", "%41", "%zz", "+", "ü", "index.php", "", ""]
SCHEMES = ["http:", "https:", "", "", "", "mailto:", "ftp:", "javascript:", "HTTP:"]
HOSTS = ["//a.com", "//www.b.org:8080", "//u:p@c.net", "", "", "", "///"]


def _rand_url(rng):
    path = "/".join(rng.choice(PIECES) for _ in range(rng.randint(0, 4)))
    if rng.random() < 0.5:
        path = "/" + path
    q = rng.choice(["", "", "?q=1", "?", "?a=b&c=d"])
    f = rng.choice(["", "", "#top", "#"])
    return rng.choice(SCHEMES) + rng.choice(HOSTS) + path + q + f


def _pairs(n=1500, seed=7):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = "https://" + rng.choice(["a.com", "www.a.com", "b.org:81"]) + "/" + "/".join(
            rng.choice(["x", "y", "z.html", ""]) for _ in range(rng.randint(0, 3))) + rng.choice(["", "?k=v"])
        out.append((base, _rand_url(rng)))
    out += [("https://a.com/b/c", ""), ("https://a.com/b/c", "?x"), ("https://a.com/b/c", "#f"),
            ("https://a.com/b/c", "../../../../g"), ("https://a.com/b/c/", "./"), ("https://a.com", "g/.."),
            ("http://a.com/b/c?q", "//other.org/p?z#f"), ("https://a.com/b", "mailto:x@y.z"),
            ("https://a.com/b", " \thttp://c.com/d\n")]
    return out


def test_url_join_matches_urljoin(spark):
    pairs = _pairs()
    df = spark.createDataFrame(pairs, "base string, href string")
    got = df.select("base", "href", U.url_join("base", "href").alias("j"),
                    U.url_join(F.col("base"), F.col("href")).alias("c")).collect()
    bad = [(r.base, r.href, r.j, r.c, urljoin(r.base, r.href)) for r in got
           if r.j != urljoin(r.base, r.href) or r.c != r.j]
    assert not bad, bad[:10]


def test_url_split_matches_urlsplit(spark):
    rng = random.Random(3)
    urls = [_rand_url(rng) for _ in range(800)] + ["https://a.com/a b", "HTTPS://A.com:8080/x;y?z#w", ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select("u", U.url_split("u").alias("s")).collect()
    for r in got:
        e = urlsplit(r.u)
        assert tuple(r.s) == (e.scheme, e.netloc, e.path, e.query, e.fragment), r.u


def test_unquote_and_normalize(spark):
    vals = ["a%20b", "a+b", "%zz", "100%", "%E2%82%AC", "x%2", "plain", "%41%", "a%20b%zz"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = {r.v: r.d for r in df.select("v", U.url_unquote("v").alias("d")).collect()}
    for v in vals:
        assert got[v] == unquote(v), v
    df = spark.createDataFrame([("/a%20b#frag", "https://h.com/x/y"), ("", "https://h.com"), ("http://o.org/p#f", "https://h.com")],
                               "u string, b string")
    got = [r.n for r in df.select(U.normalize_url("u", "b").alias("n")).collect()]
    assert got == ["https://h.com/a b", "", "http://o.org/p"]


def test_relative_path_matches_posixpath(spark):
    rng = random.Random(11)
    segs = ["pages", "a", "b", "c.md", "0", "1"]
    rows = []
    for _ in range(400):
        t = "/".join(rng.choice(segs) for _ in range(rng.randint(1, 4)))
        d = "/".join(rng.choice(segs[:-1]) for _ in range(rng.randint(1, 3)))
        rows.append((t, d))
    df = spark.createDataFrame(rows, "t string, d string")
    for r in df.select("t", "d", U.relative_path("t", "d").alias("r")).collect():
        assert r.r == posixpath.relpath(r.t, r.d), (r.t, r.d)


def _py_sanitize(filename):
    import os
    import re
    filename = re.sub(r'[<>:"/\\|?*]', "_", filename)
    name, ext = os.path.splitext(filename)
    if name.upper() in U.RESERVED_NAMES:
        filename = f"_{name}{ext}"
    filename = filename.rstrip(". ")
    return filename or "unnamed"


def test_filenames(spark):
    import hashlib
    names = ["con", "CON.txt", "a<b>c", "x. .", "", "...", ".hidden", "lpt1.tar.gz", "ok.md", "com1x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", U.sanitize_filename("n").alias("s")).collect():
        assert r.s == _py_sanitize(r.n), r.n
    long_url = "https://h.com/" + "p" * 250
    df = spark.createDataFrame([("https://a.b.com/x/y.html?q=1",), (long_url,)], "u string")
    got = [r.f for r in df.select(U.url_to_filename("u").alias("f")).collect()]
    assert got[0] == "page_a_b_com_x_y_html.html"
    p = ("h.com/" + "p" * 250).replace("/", "_").replace(".", "_")
    assert got[1] == f"page_{p[:100]}_{hashlib.md5(long_url.encode()).hexdigest()[:16]}.html"


def test_paths_and_slug(spark):
    rows = [("https://www.a.com/",), ("https://a.com/blog/2020/04/15/my-post/",), ("https://a.com/x/y",),
            ("https://a.com/x/y.php",), ("https://a.com/news/item.html?q=1",)]
    df = spark.createDataFrame(rows, "u string")
    got = df.select(U.mirror_path("u").alias("m"), U.slug("u").alias("s"), U.markdown_path("u").alias("md"),
                    U.metadata_path(U.mirror_path("u")).alias("meta"), U.record_filename("u", F.lit(3)).alias("r"),
                    U.site_folder("u").alias("sf"), U.strip_query("u").alias("sq")).collect()
    assert got[0].m == "www_a_com_index.html" and got[0].s == "" and got[0].md == "index.md"
    assert got[1].s == "my-post" and got[1].m == "blog/2020/04/15/my-post.html"
    assert got[2].m == "x/y.html" and got[2].md == "x/y.md" and got[2].meta == "x/y_meta.json"
    assert got[3].m == "x/y.php" and got[3].md == "x/y.md" and got[3].s == "y"
    assert got[4].s == "item" and got[4].sq == "https://a.com/news/item.html"
    assert got[0].r == "www_a_com_index_json" and got[2].r == "a_com_y_json"


def test_relative_path_takes_its_arguments_apart_once(spark):
    """The expression names each argument once, so that a long argument (a page's folder) is computed once per row."""
    text = str(U.relative_path(F.lit("media"), F.concat(F.col("folder"), F.lit("/x"))))
    assert text.count("folder") == 1
