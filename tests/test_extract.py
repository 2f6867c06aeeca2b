from pyspark.sql import functions as F

from webcorpus.operators import extract as X
from webcorpus.operators.html import parse_html, parse_pages

RICH = """<html><head><title>My Post | Site</title>
<meta name="description" content="short">
<meta property="og:description" content="  A much   longer
 description from og  ">
<meta property="og:image" content="/img/hero.png">
<script type="application/ld+json">[{"@type": "BlogPosting", "headline": "LD Headline",
 "datePublished": "2021-03-04T10:00:00+05:00", "author": {"name": "By Jane Doe."},
 "articleSection": ["News", "News", "Tech"]}]</script>
<script type="application/ld+json">{bad json</script>
</head><body class="post single-post">
<div class="tags"><a>#Spark</a><a>spark</a><a>Big Data</a></div>
<div class="tag-links"><a>#big data</a></div>
<time datetime="2020-01-02">x</time>
<p>Body <b>text</b></p></body></html>"""

PLAIN = """<html><head><title>Plain Title - My Blog</title></head>
<body class="page single-page"><h1>Heading</h1>
<div class="byline">Posted by  Ann Smith,</div>
<span class="post-date">March 5, 2019</span>
<div class="summary">Sum
mary   text here</div>
<div class="categories"><a> Cat A </a><a>Cat B</a><a>Cat A</a></div>
<div class="post-thumbnail"><img src="thumb.jpg"></div>
</body></html>"""

NOTITLE = """<body><h1> Only H1 </h1><div class="entry-meta"><span class="date">31/12/2020</span></div>
<p class="excerpt">tiny</p></body>"""


def test_parse_html_tree():
    nodes = parse_html('<p><b>a &amp; b<br><p>c</p><script>var t="</p>";</script>')
    tags = [n["tag"] for n in nodes]
    assert tags == ["p", "b", "#text", "br", "p", "#text", "script", "#data"]
    assert nodes[0]["end"] == len(nodes) - 1  # unclosed p spans the rest
    assert nodes[2]["text"] == "a & b"
    assert nodes[7]["text"] == 'var t="</p>";'
    assert nodes[4]["parent"] == 1


def test_metadata_golden(spark):
    df = spark.createDataFrame(
        [(1, "https://www.ex.com/blog/2021/03/04/my-post/", RICH), (2, "https://ex.com/about/team", PLAIN),
         (3, "https://ex.com/x.html", NOTITLE)],
        "page_id long, url string, html string",
    )
    rows = {r.page_id: r for r in X.extract_metadata(parse_pages(df), with_timestamp=False).collect()}
    r = rows[1]
    assert r.title == "LD Headline"
    assert r.excerpt == "A much longer description from og"
    assert r.date_published == "2021-03-04"
    assert r.date_modified == "2020-01-02"
    assert r.author == "Jane Doe"
    assert r.categories == ["News", "News", "Tech"]
    assert r.tags == ["big data", "Spark"]  # selector order: .tag-links before .tags
    assert r.featured_image == "https://www.ex.com/img/hero.png"
    assert r.content_type == "post" and r.slug == "my-post"
    p = rows[2]
    assert p.title == "Plain Title"
    assert p.author == "Ann Smith"
    assert p.date_published == "2019-03-05"
    assert p.excerpt == "Sum mary text here"
    assert p.categories == ["Cat A", "Cat B"]
    assert p.featured_image == "https://ex.com/about/thumb.jpg"
    assert p.content_type == "page"
    n = rows[3]
    assert n.title == "Only H1" and n.date_published == "2020-12-31" and n.excerpt == "tiny"
    assert n.tags == [] and n.categories == [] and n.slug == "x"


def test_main_content_and_cleaning(spark):
    from webcorpus.operators.html import main_content_root, main_text
    docs = [
        (1, "u", "<body><nav>n</nav><div class='content'>A <span hidden>h</span><div class='ad'>x</div>B"
                 "<script>s</script></div><main>M</main></body>"),
        (2, "u", "<body><div class='sidebar'><article>inside removed</article></div><p>plain <i>text</i></p></body>"),
        (3, "u", "<p>no body</p>"),
    ]
    df = parse_pages(spark.createDataFrame(docs, "page_id long, url string, html string"))
    got = {r.page_id: (r.root, r.text) for r in df.select(
        "page_id", main_content_root(F.col("nodes")).tag.alias("root"), main_text(F.col("nodes")).alias("text")).collect()}
    assert got[1] == ("div", "A B")
    assert got[2] == ("body", "plain text")
    assert got[3] == (None, "no body")


def test_pages_are_parsed_in_slices_of_bounded_size():
    """However many rows an Arrow batch has, only a slice of it is held in parsed form; every row comes back in its place."""
    import pandas as pd

    from webcorpus.operators import html as H
    from webcorpus.operators import markdown as MD
    from webcorpus.operators import rewrite as RW

    page = "<article><p>" + "x" * 1000 + '<img src="/a.png"></p></article>'
    batch = pd.Series([None, "", *[page.replace("x", str(i % 10), 1) for i in range(2500)], "y" * 3 * H.SLICE_CHARS, None, *["<p>z"] * 2500])
    base = pd.Series(["https://h.com/p"] * len(batch))
    parsed = list(H._parse_udf.func(iter([batch, batch.iloc[:0]])))
    assert [x for p in parsed for x in p] == [parse_html(h) for h in batch]
    rendered = list(MD._render_udf(True, True, None).func(iter([(batch, base)])))
    spots = list(RW._spots_udf.func(iter([batch])))
    for parts in (parsed, rendered, spots):
        assert len(parts) > 5 and sum(map(len, parts)) == len(batch) and max(map(len, parts)) <= 1000
    assert [r for p in rendered for r in p["body"]][2:5] == [MD.render_markdown(h, "https://h.com/p")["body"] for h in batch[2:5]]
    assert [s for p in spots for s in p["segments"]][2] == RW.media_spots(batch[2])["segments"]
