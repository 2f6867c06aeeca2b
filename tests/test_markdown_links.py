import tempfile

from pyspark.sql import functions as F

from webcorpus.operators import linkcheck as LC
from webcorpus.operators import markdown as MD
from webcorpus.operators.markdown import render_markdown


GFM = [
    ("# T\ntext\n\n\n\nmore\n## H2\nnext", "# T\ntext\n\nmore\n## H2\n\nnext"),
    ("intro\n    code line 1\n     code 2\nafter", "intro\n```\ncode line 1\n code 2\n```\nafter"),
    ("", ""),
]
WIDE = [
    ("[ link ](u) and\n-item\n1.one\n*ok\xa0nbsp", "[link](u) and\n- item\n1. one\n* ok nbsp"),
    ("a\n\n\n\nb", "a\n\nb"),
    ("", ""),
]


def test_tidy_functions_give_the_expected_text(spark):
    for fn, cases in ((MD.md_tidy_gfm, GFM), (MD.md_tidy_wide, WIDE)):
        df = spark.createDataFrame(cases, "c string, want string")
        for r in df.select("want", fn("c").alias("got")).collect():
            assert r.got == r.want


def test_front_matter_word_count(spark):
    df = spark.createDataFrame([("T", "https://a.com/x", None, 'say "hi"')], "t string, u string, d string, s string")
    fm = df.select(MD.front_matter_basic("t", "u", "d", "s").alias("fm")).first().fm
    assert fm == '---\ntitle: "T"\noriginal_url: "https://a.com/x"\ndescription: "say \\"hi\\""\n---\n\n'
    docs = spark.createDataFrame([("---\ntitle: x\n---\n\none two  three",), ("no fm here",), ("a --- b c",),
                                  ("",)], "c string")
    got = [(r.w, r.rt) for r in docs.select(MD.word_count("c").alias("w"),
                                             MD.reading_time(MD.word_count("c")).alias("rt")).collect()]
    assert got == [(3, 0.0), (3, 0.0), (2, 0.0), (0, 0.0)]
    n = spark.createDataFrame([(30,), (29,), (250,)], "w int")
    assert [r.rt for r in n.select(MD.reading_time("w").alias("rt")).collect()] == [0.2, 0.1, 1.3]


def test_parse_front_matter(spark):
    docs = spark.createDataFrame([("---\ntitle: a\noriginal_url:   https://a.com/p  \n---\nbody",),
                                  ("no front matter",), ("---\ntitle: only\n---",)], "c string")
    assert [r.u for r in docs.select(MD.parse_front_matter("c").alias("u")).collect()] == ["https://a.com/p", None, None]


def test_renderer_golden():
    html = ("<html><body><nav>menu</nav><div class='ad'>buy</div><article><h2>Title</h2><p>Hello <b>big</b> "
            "<a href='/x'>world</a></p><ul><li>one</li><li>two</li></ul><img src='/i/a.png?v=1'><img src='/j/a.png'>"
            "<pre>  code\n  more</pre><table><tr><th>h</th></tr><tr><td>c</td></tr></table><script>x()</script>"
            "</article><footer>f</footer></body></html>")
    out = render_markdown(html, "https://s.com/p/q", True, True, "images")
    body = out["body"]
    assert body.startswith("## Title\n\nHello **big** [world](<https://s.com/x>)")
    assert "* one\n* two" in body and "```\n  code\n  more\n```" in body
    assert "![](images/a.png)" in body and "![](images/a_1.png)" in body
    assert "| h |" in body and "menu" not in body and "buy" not in body and "x()" not in body
    assert out["images"] == [["https://s.com/i/a.png?v=1", "a.png"], ["https://s.com/j/a.png", "a_1.png"]]


def test_renderer_media_paths():
    html = "<article><a href='/files/r.PDF?x=1'>doc</a> <a href='https://other.org/f.pdf'>ext</a></article>"
    body = render_markdown(html, "https://www.s.com/p", True, True, "images", "media")["body"]
    assert "[doc](<media/files/r.PDF>)" in body and "[ext](<https://other.org/f.pdf>)" in body


DOCS = [
    ("pages/a/one.md", "---\ntitle: One\noriginal_url: https://s.com/one\n---\n[two](https://s.com/two?x=1) "
                       "[lit](/two) [miss](/nope) [ext](https://o.org/) ![i](./images/a.png) [md](../b/x.md) [top](#t)"),
    ("pages/b/two.md", "---\ntitle: Two\noriginal_url: \"https://s.com/two\"\n---\n[back](https://s.com/one)"),
]


def test_validate_and_fix_links_resolve(spark):
    docs = spark.createDataFrame(DOCS, "path string, content string")
    v = {(r.path, r.pos): (r.status, r.to) for r in LC.validate_links(docs).collect()}
    assert v[("pages/a/one.md", 0)] == ("fixed", "../b/two.md")
    assert v[("pages/a/one.md", 1)] == ("fixed", "../b/two.md")
    assert v[("pages/a/one.md", 2)] == ("broken", None)
    assert v[("pages/a/one.md", 3)] == ("external", None)
    assert v[("pages/a/one.md", 4)][0] == "image" and v[("pages/a/one.md", 5)][0] == "md"
    assert v[("pages/a/one.md", 6)][0] == "anchor"
    assert v[("pages/b/two.md", 0)] == ("fixed", "../a/one.md")
    fixed = {r.path: r for r in LC.fix_links(docs).collect()}
    assert fixed["pages/a/one.md"].content.endswith(
        "[two](../b/two.md) [lit](../b/two.md) [miss](/nope) [ext](https://o.org/) ![i](./images/a.png) "
        "[md](../b/x.md) [top](#t)")
    assert fixed["pages/a/one.md"].fixed == 2


def test_validate_links_literal(spark):
    docs = spark.createDataFrame(DOCS, "path string, content string")
    v = {(r.path, r.pos): r.status for r in LC.validate_links(docs, resolve=False).collect()}
    # literal mode: http(s) links are external, relative ones must equal a map key verbatim
    assert v[("pages/a/one.md", 0)] == "external" and v[("pages/a/one.md", 1)] == "broken"
    assert v[("pages/a/one.md", 6)] == "broken"
    s = {r.metric: r.value for r in LC.validation_summary(docs).collect()}
    assert s["pages_mapped"] == 2 and s["fixed_links"] == 3 and s["broken_links"] == 1


def test_correction_requests(spark):
    docs = spark.createDataFrame([(1, "Blog", "text a"), (2, "weird", "text b"), (3, "light", "  ")],
                                 "id int, kind string, text string")
    tpl = spark.createDataFrame([("general", "G:{input_text}"), ("blog", "B:{input_text}"), ("light", "L:{input_text}")],
                                "type string, template string")
    got = {r.id: r.prompt for r in MD.correction_requests(docs, tpl, "kind", "text").collect()}
    assert got == {1: "B:text a", 2: "G:text b", 3: "  "}
    _ = (F, tempfile)
