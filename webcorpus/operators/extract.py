"""Article metadata (H11-H20, U12) as native expressions over the parsed ``nodes``.

JSON-LD is parsed by Spark itself (``try_parse_json`` → VARIANT) and read with
``try_variant_get``; selectors are interval tests on the pre-order tree.  No UDF.
Each field is generated as SQL text (``nodes_sql``) and handed to the JVM in one
``F.expr``; the functions take column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import urls_sql as US
from ..functions.urls_sql import _v, let, lit
from . import nodes_sql as N

# JSON-LD types read, title separators, date formats (in order), page paths.
ARTICLE_TYPES = ["Article", "BlogPosting", "WebPage"]
TITLE_SEPARATORS = [" | ", " - ", " – ", " — ", " // ", " » "]
DATE_FORMATS = ["MMMM d, yyyy", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy"]
PAGE_PATHS = ["/about/", "/contact/", "/privacy-policy/", "/terms/", "/faq/"]

# Selector lists (class names; "a b" means b inside a).
DATE_SELECTORS = [("posted-on", "time"), ("entry-date", None), ("entry-meta", ".date"), ("post-date", None),
                  ("article-date", None), ("publish-date", None)]
AUTHOR_SELECTORS = [("author-name", None), ("author", ".vcard"), ("entry-author", None), ("author-info", None),
                    ("byline", None)]
EXCERPT_CLASSES = ["entry-excerpt", "excerpt", "entry-summary", "post-excerpt", "article-excerpt", "summary"]
CATEGORY_CLASSES = ["cat-links", "category-links", "categories", "post-categories", "entry-categories"]
TAG_CLASSES = ["tag-links", "tags", "post-tags", "entry-tags", "article-tags"]
IMAGE_CLASSES = ["post-thumbnail", "featured-image", "entry-featured-image", "post-featured-image"]

AT_TYPE = "$['@type']"


def dt_attr(el: str) -> str:
    return f"try_element_at({el}.attrs, 'datetime')"


ISO_RE = r"^(\d{4}-\d{2}-\d{2})([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?$"


def _q(name: str) -> str:
    return US.ident(name)


def _sel(pair):
    outer, inner = pair
    if inner is None:
        return N.cls(outer)
    inner_sel = N.cls(inner[1:]) if inner.startswith(".") else N.tag(inner)
    return N.under(N.cls(outer), inner_sel)


def _meta(nodes: str, attr: str, value: str) -> str:
    """content of the first <meta attr=value> ('' when the tag has no content), NULL without the tag."""
    return let(N.select_first(nodes, N.all_of(N.tag("meta"), N.attr_eq(attr, value))),
               lambda m: f"CASE WHEN {m} IS NOT NULL THEN coalesce(try_element_at({m}.attrs, 'content'), '') END")


def json_ld_sql(nodes: str) -> str:
    """array<variant> of JSON-LD items: every script[type=application/ld+json], arrays
    flattened, unparsable scripts skipped."""
    scripts = N.select_all(nodes, N.all_of(N.tag("script"), N.attr_eq("type", "application/ld+json")))
    s, m, m2, t, v, w, x = (_v(p) for p in ("s", "m", "m", "t", "v", "w", "x"))
    texts = (f"transform({scripts}, {s} -> array_join(transform(filter({nodes}, {m} -> {m}.parent = {s}.idx), "
             f"{m2} -> {m2}.text), ''))")
    parsed = f"filter(transform({texts}, {t} -> try_parse_json({t})), {v} -> {v} IS NOT NULL)"
    items = f"transform({parsed}, {w} -> coalesce(try_variant_get({w}, '$', 'array<variant>'), array({w})))"
    return f"filter(flatten({items}), {x} -> {x} IS NOT NULL)"


def _articles(ld: str) -> str:
    v = _v("v")
    types = ", ".join(lit(a) for a in ARTICLE_TYPES)
    return f"filter({ld}, {v} -> try_variant_get({v}, {lit(AT_TYPE)}, 'string') IN ({types}))"


def _ld_text(v: str, path: str) -> str:
    """The scalar at ``path`` of a JSON-LD item as text; NULL for a list or an object."""
    kind = f"schema_of_variant(try_variant_get({v}, {lit(path)}, 'variant'))"
    return f"CASE WHEN NOT startswith({kind}, 'ARRAY') AND NOT startswith({kind}, 'OBJECT') THEN try_variant_get({v}, {lit(path)}, 'string') END"


def _ld_first(ld: str, path: str) -> str:
    v, s = _v("v"), _v("s")
    vals = f"transform({_articles(ld)}, {v} -> {_ld_text(v, path)})"
    return f"try_element_at(filter({vals}, {s} -> {s} IS NOT NULL AND {s} != ''), 1)"


def title_sql(nodes: str, ld: str) -> str:
    """JSON-LD headline → og:title → twitter:title → <title> (cut at separators) → h1."""
    t = N.select_first(nodes, N.tag("title"))
    title_text = let(t, lambda x: N.py_strip(N.get_text(nodes, x)))

    def cut(sep):
        return lambda x: (f"CASE WHEN contains({x}, {lit(sep)}) THEN "
                          f"{N.py_strip(f'split_part({x}, {lit(sep)}, 1)')} ELSE {x} END")

    for sep in TITLE_SEPARATORS:
        title_text = let(title_text, cut(sep))
    h1 = N.select_first(nodes, N.tag("h1"))
    return (f"coalesce({N.nz(_ld_first(ld, '$.headline'))}, {N.nz(_meta(nodes, 'property', 'og:title'))}, "
            f"{N.nz(_meta(nodes, 'name', 'twitter:title'))}, {N.nz(title_text)}, {N.text_of(nodes, h1)}, '')")


def format_date_sql(raw: str) -> str:
    """ISO (date of the wall clock, offset ignored) or one of four formats → yyyy-MM-dd; else raw."""
    def body(r):
        iso_date = f"try_to_date(regexp_extract({r}, {lit(ISO_RE)}, 1), 'yyyy-MM-dd')"
        formats = ", ".join(f"try_to_date({r}, {lit(f)})" for f in DATE_FORMATS)
        parsed = f"coalesce(CASE WHEN {r} RLIKE {lit(ISO_RE)} THEN {iso_date} END, {formats})"
        return f"CASE WHEN {r} = '' THEN {r} ELSE coalesce(date_format({parsed}, 'yyyy-MM-dd'), {r}) END"

    return let(raw, body)


def date_sql(nodes: str, ld: str, modified: bool = False) -> str:
    """JSON-LD → three metas → first time[datetime] → six class selectors; formatted."""
    key = "dateModified" if modified else "datePublished"
    metas = ([("property", "article:modified_time"), ("itemprop", "dateModified"), ("name", "dateModified")]
             if modified else
             [("property", "article:published_time"), ("itemprop", "datePublished"), ("name", "datePublished")])
    n = _v("n")
    times = N.select_all(nodes, lambda x: f"{N.tag('time')(x)} AND coalesce(try_element_at({x}.attrs, 'datetime'), '') != ''")
    cands = [N.nz(_ld_first(ld, f"$.{key}"))] + [N.nz(_meta(nodes, a, v)) for a, v in metas]
    cands.append(f"try_element_at(transform({times}, {n} -> try_element_at({n}.attrs, 'datetime')), 1)")

    def by_class(el):
        return (f"CASE WHEN {el} IS NOT NULL THEN coalesce({N.nz(dt_attr(el))}, "
                f"{N.py_strip(N.get_text(nodes, el))}) END")

    for pair in DATE_SELECTORS:
        cands.append(let(N.select_first(nodes, _sel(pair)), by_class))
    return format_date_sql(f"coalesce({', '.join(cands)}, '')")


def author_sql(nodes: str, ld: str) -> str:
    """JSON-LD author (object name or string) → meta author → five selectors → a[rel=author]."""
    v = _v("v")

    def name_or_str(x):
        return f"coalesce({_ld_text(x, '$.author.name')}, {_ld_text(x, '$.author')})"

    with_author = f"filter({_articles(ld)}, {v} -> {name_or_str(v)} IS NOT NULL)"
    ld_author = let(f"try_element_at({with_author}, 1)", name_or_str)
    cands = [N.nz(ld_author), N.nz(_meta(nodes, "name", "author"))]
    cands += [N.text_of(nodes, N.select_first(nodes, _sel(p))) for p in AUTHOR_SELECTORS]
    cands.append(N.text_of(nodes, N.select_first(nodes, N.all_of(N.tag("a"), N.attr_eq("rel", "author")))))
    a = let(f"coalesce({', '.join(cands)}, '')",
            lambda x: N.py_strip(f"regexp_replace({x}, {lit('(?iU)^by' + N.PY_WS + '+')}, '')"))
    a = let(a, lambda x: N.py_strip(f"regexp_replace({x}, {lit('(?iU)^posted by' + N.PY_WS + '+')}, '')"))
    return f"regexp_replace({a}, {lit('[.,;:]+$')}, '')"


def excerpt_sql(nodes: str) -> str:
    """Meta description; while shorter than 10: og → twitter → six class selectors;
    whitespace collapsed, > 300 characters cut to 297 + '...'."""
    def upgrade(v):
        return f"CASE WHEN length({v}.e) < 10 AND {v}.c IS NOT NULL THEN {v}.c ELSE {v}.e END"

    def found_text(el):
        return f"CASE WHEN {el} IS NOT NULL THEN {N.py_strip(N.get_text(nodes, el))} END"

    e = f"coalesce({_meta(nodes, 'name', 'description')}, '')"
    for attr, val in (("property", "og:description"), ("name", "twitter:description")):
        e = let(f"named_struct('e', {e}, 'c', {_meta(nodes, attr, val)})", upgrade)
    found = ", ".join(let(N.select_first(nodes, N.cls(c)), found_text) for c in EXCERPT_CLASSES)
    e = let(f"named_struct('e', {e}, 'c', coalesce({found}))", upgrade)
    return let(N.collapse_ws(e), lambda x: f"CASE WHEN length({x}) > 300 THEN concat(substring({x}, 1, 297), '...') "
                                           f"ELSE {x} END")


def _anchor_texts(nodes: str, classes: list[str]) -> str:
    parts = []
    for c in classes:
        n = _v("n")
        parts.append(f"transform({N.select_all(nodes, N.under(N.cls(c), N.tag('a')))}, "
                     f"{n} -> {N.py_strip(N.get_text(nodes, n))})")
    return f"concat({', '.join(parts)})"


def categories_sql(nodes: str, ld: str) -> str:
    """JSON-LD articleSection (list or string, kept as is) else anchors under five classes, distinct."""
    v, s, t = _v("v"), _v("s"), _v("t")
    one = f"try_variant_get({v}, '$.articleSection', 'string')"
    sections = (f"flatten(transform({_articles(ld)}, {v} -> coalesce("
                f"try_variant_get({v}, '$.articleSection', 'array<string>'), "
                f"CASE WHEN {one} IS NOT NULL THEN array({one}) END, cast(array() AS array<string>))))")
    sections = f"filter({sections}, {s} -> {s} IS NOT NULL AND {s} != '')"
    from_html = f"array_distinct(filter({_anchor_texts(nodes, CATEGORY_CLASSES)}, {t} -> {t} != ''))"
    return let(sections, lambda x: f"CASE WHEN size({x}) > 0 THEN {x} ELSE {from_html} END")


def tags_sql(nodes: str) -> str:
    """Anchors under five tag classes; leading '#' stripped, then case-insensitive
    distinct keeping the first spelling (Q18: strip before the duplicate test)."""
    s, t, acc, x, y = (_v(p) for p in ("s", "t", "acc", "x", "y"))
    texts = (f"filter(transform({_anchor_texts(nodes, TAG_CLASSES)}, {s} -> regexp_replace({s}, '^#+', '')), "
             f"{t} -> {t} != '')")
    return (f"aggregate({texts}, cast(array() AS array<string>), ({acc}, {x}) -> "
            f"CASE WHEN exists({acc}, {y} -> lower({y}) = lower({x})) THEN {acc} ELSE concat({acc}, array({x})) END)")


def image_sql(nodes: str, ld: str, url: str) -> str:
    """Og:image → twitter:image → JSON-LD image (object url or string) → four selectors;
    made absolute against the page url."""
    v = _v("v")

    def url_or_str(x):
        return f"coalesce({_ld_text(x, '$.image.url')}, {_ld_text(x, '$.image')})"

    def src_of(x):
        return f"CASE WHEN {x} IS NOT NULL THEN try_element_at({x}.attrs, 'src') END"

    arts = f"filter({_articles(ld)}, {v} -> {url_or_str(v)} IS NOT NULL)"
    ld_img = let(f"try_element_at({arts}, 1)", url_or_str)
    imgs = [let(N.select_first(nodes, N.under(N.cls(c), N.all_of(N.tag("img"), N.has_attr("src")))), src_of)
            for c in IMAGE_CLASSES]
    img = (f"coalesce({N.nz(_meta(nodes, 'property', 'og:image'))}, {N.nz(_meta(nodes, 'name', 'twitter:image'))}, "
           f"{N.nz(ld_img)}, {', '.join(imgs)}, '')")
    return let(img, lambda x: (f"CASE WHEN {x} = '' OR startswith({x}, 'http://') OR startswith({x}, 'https://') "
                               f"THEN {x} ELSE {US.url_join(url, x, U.USES_RELATIVE, U.USES_NETLOC)} END"))


def content_type_sql(nodes: str, url: str) -> str:
    """H19: 'page' for the five page paths; else body classes (substring tests): page / post /
    archive; default 'post'."""
    path = f"lower({US.url_split(url)}.path)"
    by_path = let(path, lambda p: " OR ".join(f"contains({p}, {lit(x)})" for x in PAGE_PATHS))
    classes = let(N.select_first(nodes, N.tag("body")), lambda b: f"coalesce(array_join({b}.classes, ' '), '')")
    by_class = let(classes, lambda c: (
        f"CASE WHEN contains({c}, 'page') AND contains({c}, 'single-page') THEN 'page' "
        f"WHEN contains({c}, 'post') AND contains({c}, 'single-post') THEN 'post' "
        f"WHEN contains({c}, 'archive') THEN 'archive' ELSE 'post' END"))
    return f"CASE WHEN {by_path} THEN 'page' ELSE {by_class} END"


def json_ld(nodes: str = "nodes") -> Column:
    return F.expr(json_ld_sql(_q(nodes)))


def meta_title(nodes: str = "nodes", ld: str = "_ld") -> Column:
    return F.expr(title_sql(_q(nodes), _q(ld)))


def meta_date(nodes: str = "nodes", ld: str = "_ld", modified: bool = False) -> Column:
    return F.expr(date_sql(_q(nodes), _q(ld), modified))


def meta_author(nodes: str = "nodes", ld: str = "_ld") -> Column:
    return F.expr(author_sql(_q(nodes), _q(ld)))


def meta_excerpt(nodes: str = "nodes") -> Column:
    return F.expr(excerpt_sql(_q(nodes)))


def meta_categories(nodes: str = "nodes", ld: str = "_ld") -> Column:
    return F.expr(categories_sql(_q(nodes), _q(ld)))


def meta_tags(nodes: str = "nodes") -> Column:
    return F.expr(tags_sql(_q(nodes)))


def meta_image(nodes: str = "nodes", ld: str = "_ld", url: str = "url") -> Column:
    return F.expr(image_sql(_q(nodes), _q(ld), _q(url)))


def content_type(nodes: str = "nodes", url: str = "url") -> Column:
    return F.expr(content_type_sql(_q(nodes), _q(url)))


def extract_metadata(parsed: DataFrame, with_timestamp: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The article metadata record per page (empty strings / lists as defaults), after the columns ``keep``."""
    with_ld = parsed.withColumn("_ld", json_ld("nodes"))
    cols = [
        "page_id",
        "url",
        meta_title().alias("title"),
        meta_excerpt().alias("excerpt"),
        meta_date(modified=False).alias("date_published"),
        meta_date(modified=True).alias("date_modified"),
        meta_author().alias("author"),
        meta_categories().alias("categories"),
        meta_tags().alias("tags"),
        meta_image().alias("featured_image"),
        content_type().alias("content_type"),
        F.coalesce(U.slug("url"), F.lit("")).alias("slug"),
    ]
    if with_timestamp:
        cols.append((F.unix_micros(F.current_timestamp()) / 1e6).alias("extracted_timestamp"))
    return with_ld.select(*(keep or []), *cols)
