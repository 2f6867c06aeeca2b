"""Markdown: rendering (M1 with H6-H9), tidy passes (M2, M3), front matter (M4-M7),
Markdown links (M8), word counts (M9, M10) and correction requests (M11).

Only the renderer is Python (an Arrow-batched pandas UDF; rendering a tree to text is
per-document imperative work); everything else is native string/array expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U
from ..functions.urls import at, let
from .html import NODES_TYPE, parse_html, slices
from .media import DOCUMENT_EXTENSIONS

# Subtrees removed before rendering (H6a), the boilerplate list (H6b) and
# the main-content preference order (H7).
ALWAYS_REMOVED_TAGS = ["script", "style", "iframe"]
BOILERPLATE_TAGS = ["script", "style", "iframe", "noscript", "header", "footer", "nav"]
BOILERPLATE_CLASSES = [
    "comments", "comment-section", "sidebar", "widget", "header", "footer", "site-header", "site-footer", "nav",
    "menu", "advertisement", "ad", "advert", "social-sharing", "share-buttons", "related-posts",
]
BOILERPLATE_IDS = ["related-posts"]
MAIN_CONTENT = [("tag", "article"), ("class", "post-content"), ("class", "entry-content"), ("class", "content"),
                ("tag", "main"), ("class", "main-content"), ("class", "article-content"), ("class", "post"),
                ("id", "content")]

MD_LINK_RE = r"\[([^\]]*)\]\(([^)]+)\)"

_BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "li",
          "blockquote", "pre", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "body", "html", "form",
          "figure", "figcaption", "dl", "dt", "dd"}


# ---------------------------------------------------------------------------
# M1 renderer (runs inside the UDF)
# ---------------------------------------------------------------------------

def _matches(node, kind, value):
    if kind == "tag":
        return node["tag"] == value
    if kind == "class":
        return value in (node["classes"] or [])
    return (node["attrs"] or {}).get("id") == value


def _removed(node, boilerplate):
    a = node["attrs"] or {}
    if node["tag"] in ALWAYS_REMOVED_TAGS or "hidden" in a or "display:none" in a.get("style", ""):
        return True
    if boilerplate:
        if node["tag"] in BOILERPLATE_TAGS or a.get("id") in BOILERPLATE_IDS:
            return True
        if any(c in BOILERPLATE_CLASSES for c in (node["classes"] or [])):
            return True
    return False


def _children(nodes):
    kids = [[] for _ in nodes]
    roots = []
    for n in nodes:
        (kids[n["parent"]] if n["parent"] >= 0 else roots).append(n["idx"])
    return kids, roots


def _local_media(url, base_url, media_dir):
    """A same-site document link → its local media path (U16 layout) under ``media_dir``."""
    from urllib.parse import urlsplit

    if not media_dir or not url:
        return None
    u = urlsplit(url)
    ext = u.path.rsplit("/", 1)[-1]
    ext = ext[ext.rfind("."):].lower() if "." in ext.lstrip(".") else ""
    if ext not in DOCUMENT_EXTENSIONS:
        return None
    if base_url and u.netloc.replace("www.", "") != urlsplit(base_url).netloc.replace("www.", ""):
        return None
    path = u.path.strip("/")
    return f"{media_dir}/{path}" if path else None


def _call(generator):
    """The return value of a generator that yields the generators whose values it needs, on an explicit stack."""
    stack, value = [generator], None
    while stack:
        try:
            needed = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(needed)
            value = None
    return value


def render_markdown(html, base_url=None, boilerplate=True, main_content=True, image_dir=None, media_dir=None):
    """Our Markdown dialect: ATX headings, **bold**, _italic_, `code`, fenced pre, '*' bullets,
    numbered lists, '>' quotes, [text](<url>) links, ![alt](url) images, pipe tables, no wrapping."""
    nodes = parse_html(html)
    return None if nodes is None else render_nodes(nodes, base_url, boilerplate, main_content, image_dir, media_dir)


def render_nodes(nodes, base_url=None, boilerplate=True, main_content=True, image_dir=None, media_dir=None):
    """``render_markdown`` of a parsed page."""
    kids, roots = _children(nodes)
    removed = [False] * len(nodes)
    for n in nodes:
        if not n["tag"].startswith("#") and _removed(n, boilerplate):
            for i in range(n["idx"], n["end"] + 1):
                removed[i] = True
    start = roots
    if main_content:
        for kind, value in MAIN_CONTENT:
            hit = next((n for n in nodes if not n["tag"].startswith("#") and not removed[n["idx"]]
                        and _matches(n, kind, value)), None)
            if hit is not None:
                start = [hit["idx"]]
                break
        else:
            body = next((n for n in nodes if n["tag"] == "body"), None)
            if body is not None:
                start = [body["idx"]]
    images, used, taken = {}, {}, set()

    def image_name(src):
        if src in images:
            return images[src]
        base = src.split("?")[0].rstrip("/").split("/")[-1] or "image"
        base = re.sub(r'[<>:"/\\|?*]', "_", base)
        stem, dot, ext = base.rpartition(".")
        n, name = used.get(base, 0), base
        while name in taken:  # also a name that another image has of its own
            n += 1
            name = f"{stem}_{n}.{ext}" if dot else f"{base}_{n}"
        used[base] = n
        taken.add(name)
        images[src] = name
        return name

    def join(href):
        if base_url and href is not None:
            from urllib.parse import urljoin
            return urljoin(base_url, href)
        return href

    # the three below are generators that yield the calls they need to ``_call``: depth is bounded by memory only
    def inlines(idxs, pre=False):
        out = []
        for k in idxs:
            out.append((yield inline(k, pre)))
        return "".join(out)

    def inline(i, pre=False):
        n = nodes[i]
        if removed[i]:
            return ""
        t = n["tag"]
        if t == "#text":
            return n["text"] if pre else re.sub(r"\s+", " ", n["text"])
        if t == "#data":
            return ""
        if t in _BLOCK and not pre:
            return "\n\n" + (yield block(i)) + "\n\n"
        inner = yield inlines(kids[i], pre or t == "pre")
        a = n["attrs"] or {}
        if t in ("b", "strong"):
            return f"**{inner.strip()}**" if inner.strip() else inner
        if t in ("i", "em"):
            return f"_{inner.strip()}_" if inner.strip() else inner
        if t == "code" and not pre:
            return f"`{inner}`"
        if t == "br":
            return "  \n"
        if t == "a" and "href" in a:
            target = join(a["href"])
            target = _local_media(target, base_url, media_dir) or target
            return f"[{inner.strip()}](<{target}>)"
        if t == "img":
            src = join(a.get("src", ""))
            if image_dir and src:
                src = f"{image_dir}/{image_name(src)}"
            return f"![{a.get('alt', '')}]({src})"
        if t in _BLOCK:
            return "\n\n" + (yield block(i)) + "\n\n"
        return inner

    def block(i):
        n = nodes[i]
        if removed[i]:
            return ""
        t = n["tag"]
        if t.startswith("#"):
            return (yield inline(i))
        if t in ("h1", "h2", "h3", "h4", "h5", "h6"):
            text = (yield inlines(kids[i])).strip()
            return f"{'#' * int(t[1])} {text}" if text else ""
        if t == "hr":
            return "* * *"
        if t == "pre":
            body = (yield inlines(kids[i], True)).strip("\n")
            return f"```\n{body}\n```"
        if t in ("ul", "ol"):
            out, k = [], 0
            for c in kids[i]:
                if nodes[c]["tag"] == "li" and not removed[c]:
                    k += 1
                    mark = f"{k}." if t == "ol" else "*"
                    out.append(f"{mark} " + (yield blocks(kids[c])).strip().replace("\n", "\n  "))
            return "\n".join(out)
        if t == "blockquote":
            quoted = yield blocks(kids[i])
            return "\n".join("> " + ln for ln in quoted.strip().split("\n"))
        if t == "table":
            rows = []
            for r in range(n["idx"] + 1, n["end"] + 1):
                if nodes[r]["tag"] == "tr" and not removed[r]:
                    cells = []
                    for c in kids[r]:
                        if nodes[c]["tag"] in ("td", "th"):
                            cells.append((yield blocks(kids[c])).strip().replace("\n", " "))
                    rows.append("| " + " | ".join(cells) + " |")
                    if len(rows) == 1:
                        rows.append("|" + "---|" * len(cells))
            return "\n".join(rows)
        if t in _BLOCK:
            return (yield blocks(kids[i]))
        return (yield inline(i))

    def blocks(idxs):
        parts, buf = [], []
        for k in idxs:
            if removed[k]:
                continue
            if nodes[k]["tag"] in _BLOCK:
                if buf:
                    parts.append("".join(buf).strip())
                    buf = []
                parts.append((yield block(k)).strip())
            else:
                buf.append((yield inline(k)))
        if buf:
            parts.append("".join(buf).strip())
        return "\n\n".join(p for p in parts if p)

    text = _call(blocks(start))
    text = re.sub(r"[ \t]+\n", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text).strip() + "\n"
    return {"body": text, "images": [[k, v] for k, v in images.items()]}


RENDER_TYPE = T.StructType([
    T.StructField("nodes", NODES_TYPE),
    T.StructField("body", T.StringType()),
    T.StructField("images", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("error", T.StringType()),
])


def _render_udf(boilerplate: bool, main_content: bool, image_dir: str | None, media_dir: str | None = None,
                with_nodes: bool = False):
    def attempt(html, base):
        """A row that cannot be rendered carries its error; the others of its batch are not affected."""
        if html is None:
            return None, None, None, "the page has no HTML"
        nodes = parse_html(html)
        try:
            out = render_nodes(nodes, base, boilerplate, main_content, image_dir, media_dir)
            return nodes if with_nodes else None, out["body"], out["images"], None
        except Exception as e:  # noqa: BLE001  whatever a page's content does
            return nodes if with_nodes else None, None, None, str(e) or type(e).__name__

    @F.pandas_udf(RENDER_TYPE)
    def render(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for html, base in batches:
            for rows in slices(html):
                out = [attempt(h, b) for h, b in zip(html.iloc[rows], base.iloc[rows], strict=True)]
                yield pd.DataFrame({name: [o[i] for o in out] for i, name in enumerate(("nodes", "body", "images", "error"))})

    return render


def _image_map(c: Column) -> Column:
    return F.transform(c, lambda p: F.struct(at(p, 1).alias("url"), at(p, 2).alias("name")))


def to_markdown(pages: DataFrame, absolutize: bool = True, boilerplate: bool = True, main_content: bool = True,
                image_dir: str | None = "images", media_dir: str | None = None) -> DataFrame:
    """M1 (+H6 clean, H7 main content, H8 image rewrite, H9 absolute links): adds ``body``
    (Markdown), ``images`` (array<struct<url, name>>: the page's image map) and ``error`` (NULL unless the page could not be
    rendered; then the others are NULL)."""
    udf = _render_udf(boilerplate, main_content, image_dir, media_dir)
    base = F.col("url") if absolutize else F.lit(None).cast("string")
    r = pages.withColumn("_r", udf(F.col("html"), base)).drop("html")
    return r.withColumn("body", F.col("_r.body")).withColumn("images", _image_map(F.col("_r.images"))).withColumn(
        "error", F.col("_r.error")).drop("_r")


def error_document(url: Column, error: Column) -> Column:
    """M7: what stands in for a page that could not be converted (fixed form)."""
    return F.concat(F.lit("---\ntitle: Error converting content\nurl: "), F.coalesce(url, F.lit("")),
                    F.lit("\n---\n\nError: "), error)


def convert(pages: DataFrame, image_dir: str | None = "images", media_dir: str | None = None, tidy: str = "wide",
            preserve_hierarchy: bool = True) -> DataFrame:
    """M7 (+M1, M2 or M3, M5, U17, F12): page_id, url, title, markdown_path, document, images, converted, error.

    One Python pass parses and renders a page; front matter, tidy pass ('wide', 'gfm' or 'none') and paths are native. A
    page that fails (no HTML, a link that is no URL, …) fails alone: converted is false, error says why, document is the error document
    and markdown_path NULL."""
    from .extract import extract_metadata

    udf = _render_udf(True, True, image_dir, media_dir, with_nodes=True)
    r = pages.select("page_id", "url", udf(F.col("html"), F.col("url")).alias("_r"))
    r = r.select("page_id", "url", F.col("_r.nodes").alias("nodes"), F.col("_r.body").alias("_body"),
                 F.col("_r.images").alias("_images"), F.col("_r.error").alias("_error"))
    md = extract_metadata(r, with_timestamp=False, keep=["_body", "_images", "_error"])
    fields = ["title", "date_published", "date_modified", "author", "excerpt", "categories", "tags", "featured_image", "slug", "url"]
    front = front_matter_full(F.struct(*fields))
    body = {"wide": md_tidy_wide, "gfm": md_tidy_gfm, "none": F.col}[tidy]("_body")
    ok = F.col("_error").isNull()
    document = F.when(ok, markdown_document(F.concat(front, F.lit("\n")), body)).otherwise(error_document(F.col("url"), F.col("_error")))
    return md.select(
        "page_id", "url", F.when(ok, F.col("title")).alias("title"),
        F.when(ok, U.markdown_path(F.col("url"), F.col("slug"), preserve_hierarchy)).alias("markdown_path"),
        document.alias("document"), _image_map(F.col("_images")).alias("images"), ok.alias("converted"), F.col("_error").alias("error"))


def reconvert(results: DataFrame, pages: DataFrame, **options) -> DataFrame:
    """The results with the failed rows converted again from ``pages`` (their mended html); the others are not touched."""
    done = F.coalesce(F.col("converted"), F.lit(False))
    again = pages.join(results.where(~done).select("page_id"), "page_id", "left_semi")
    fresh = convert(again, **options)
    kept = results.where(done).unionByName(results.where(~done).join(again.select("page_id"), "page_id", "left_anti"))
    return kept.unionByName(fresh)


# ---------------------------------------------------------------------------
# Native text functions
# ---------------------------------------------------------------------------

def md_tidy_gfm(c) -> Column:
    """M2: ≥3 newlines → 2; blank line after a heading; indented (≥4 spaces) line runs become
    fenced blocks with 4 spaces removed."""
    c = U._col(c)
    s = F.regexp_replace(c, r"\n{3,}", "\n\n")
    s = F.regexp_replace(s, r"(?d)(\n#{1,6} .+)\n(?=[^\n])", "$1\n\n")

    def fence(lines):
        n = F.size(lines)
        flagged = F.transform(lines, lambda ln, i: F.struct(
            ln.alias("l"), ((i < n - 1) & ln.rlike(r"^ {4,}[^\n]+$") & (F.length(ln) >= 5)).alias("b")))
        init = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("inb"))
        folded = F.aggregate(
            flagged, init,
            lambda acc, x: F.struct(
                F.concat(
                    acc.out,
                    F.when(x.b != acc.inb, F.array(F.lit("```"))).otherwise(F.array().cast("array<string>")),
                    F.array(F.when(x.b, F.substring(x.l, 5, 1 << 30)).otherwise(x.l)),
                ).alias("out"),
                x.b.alias("inb"),
            ),
        )
        return F.array_join(folded.out, "\n")

    return let(F.split(s, "\n", -1), fence)


def md_tidy_wide(c) -> Column:
    """M3: '[ x ](y)' → '[x](y)'; ≥3 newlines → 2; NBSP → space; newline around code fences;
    a space after list markers."""
    s = F.regexp_replace(U._col(c), r"\[ (.*?) \]\((.*?)\)", "[$1]($2)")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    s = F.replace(s, F.lit(" "), F.lit(" "))
    s = F.regexp_replace(s, r"(?U)```(\w+)(?!\n)", "```$1\n")
    s = F.regexp_replace(s, r"(?<!\n)```", "\n```")
    s = F.regexp_replace(s, r"(?m)^([*+-])(?! )", "$1 ")
    return F.regexp_replace(s, r"(?m)^(\d+\.)(?! )", "$1 ")


def _yaml_dq(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def front_matter_basic(title=None, url=None, date=None, description=None) -> Column:
    """M4: '---', title / original_url / date / description (double quotes escaped) when present, '---'."""
    lines = [F.lit("---")]
    for key, col, esc in (("title", title, False), ("original_url", url, False), ("date", date, False),
                          ("description", description, True)):
        if col is None:
            continue
        v = U._col(col)
        v = F.replace(v, F.lit('"'), F.lit('\\"')) if esc else v
        lines.append(F.when(U._col(col).isNotNull(), F.concat(F.lit(f"{key}: "), _yaml_dq(v))))
    lines.append(F.lit("---\n\n"))
    return F.concat_ws("\n", *lines)


def _yaml_scalar(c: Column) -> Column:
    """Single-quoted (quotes doubled) only when the value needs quoting."""
    needs = c.rlike(r"[:#'\"\[\]{},&*!|>%@`]|^[\s-?]|\s$")
    return F.when(needs, F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(c)


def front_matter_full(md: Column) -> Column:
    """M5 from an article-metadata struct: title, date, last_modified_at, author, excerpt,
    categories, tags, header image, permalink, original_url; empty fields omitted."""
    def line(key, v):
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{key}: "), _yaml_scalar(v)))

    def lst(key, arr):
        return F.when(F.size(F.coalesce(arr, F.array().cast("array<string>"))) > 0, F.concat(
            F.lit(f"{key}:\n"), F.array_join(F.transform(arr, lambda x: F.concat(F.lit("  - "), _yaml_scalar(x))), "\n")))

    return F.concat_ws(
        "\n",
        F.lit("---"),
        line("title", md.title),
        line("date", md.date_published),
        line("last_modified_at", md.date_modified),
        line("author", md.author),
        line("excerpt", md.excerpt),
        lst("categories", md.categories),
        lst("tags", md.tags),
        F.when(F.coalesce(md.featured_image, F.lit("")) != "",
               F.concat(F.lit("header:\n  image: "), _yaml_scalar(md.featured_image))),
        F.when(F.coalesce(md.slug, F.lit("")) != "", F.concat(F.lit("permalink: /"), md.slug, F.lit("/"))),
        line("original_url", md.url),
        F.lit("---\n"),
    )


def parse_front_matter(content) -> Column:
    """M6: the ``original_url`` of the first '---' block (trimmed), NULL when absent."""
    fm = F.regexp_extract(U._col(content), r"(?s)---\s*\n(.*?)\n---", 1)
    url = F.regexp_extract(fm, r"(?d)original_url:\s*(.*)", 1)
    found = fm.rlike(r"original_url:")
    return F.when(found, F.regexp_replace(url, r"(?U)^\s+|\s+$", ""))


def markdown_document(front_matter: Column, body: Column) -> Column:
    """M7: front matter + body; NULL body (failed conversion) gives NULL."""
    return F.when(body.isNotNull(), F.concat(front_matter, body))


def md_links(content) -> Column:
    """M8: array<struct<pos, text, url>> of every [text](url), in order."""
    c = U._col(content)
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(c, F.lit(MD_LINK_RE), 1), F.regexp_extract_all(c, F.lit(MD_LINK_RE), 2)),
        lambda z, i: F.struct(i.alias("pos"), z["0"].alias("text"), z["1"].alias("url")),
    )


def word_count(content) -> Column:
    """M9: whitespace-separated words after the second '---' (or after the only one)."""
    c = U._col(content)
    body = F.when(c.contains("---"), at(F.split(c, "---", 3), -1)).otherwise(c)
    return F.size(F.filter(F.split(body, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")).cast("int")


def reading_time(words) -> Column:
    """Minutes at 200 words/minute, 1 decimal, half-up (Q12: 30 words → 0.2)."""
    w = U._col(words).cast("bigint")
    # exact integer half-up rounding of w/200 to tenths (no binary-float midpoint surprises)
    return F.when(w > 0, F.floor((w + 10) / 20) / 10.0).otherwise(F.lit(0.0))


def correction_requests(docs: DataFrame, templates: DataFrame, type_col: str, text_col: str,
                        default_type: str = "general") -> DataFrame:
    """One request per document: the template of its type (case-insensitive), else the one of ``default_type``, with
    ``{input_text}`` replaced; blank text passes through unchanged. Without a default template, documents of an unknown type
    keep their text. Any number of templates: a left join and one scalar subquery."""
    # one template per (case-folded) type, like a dict
    t = templates.groupBy(F.lower("type").alias("_t")).agg(F.max("template").alias("_tpl"))
    default = t.where(F.col("_t") == default_type.lower()).select(F.max("_tpl")).scalar()
    j = docs.withColumn("_t", F.lower(F.col(type_col))).join(t, "_t", "left").withColumn("_default", default)
    text, template = F.col(text_col), F.coalesce("_tpl", "_default")
    prompt = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", text).otherwise(
        F.coalesce(F.replace(template, F.lit("{input_text}"), text), text))
    return j.withColumn("prompt", prompt).drop("_t", "_tpl", "_default")
