"""H1: one distributed HTML parse, then native selectors over the parsed tree.

``parse_pages`` is the only Python step for HTML: an Arrow-batched pandas UDF that
runs the standard library's ``html.parser`` tokenizer (the same tokenizer a
BeautifulSoup ``html.parser`` tree is built from) and returns the document as a
flat, pre-order ``nodes`` array.  Every extraction operator afterwards is plain
``filter``/``transform``/``exists`` on that array, so it stays in the JVM and needs
no shuffle.

Node layout (pre-order, ``idx`` = array position - 1):

* ``idx``/``parent``/``depth`` – tree position (parent -1 at top level)
* ``end``    – idx of the last descendant, so descendants of ``n`` are exactly
               ``n.idx < m.idx <= n.end`` (no ancestor walk needed)
* ``tag``    – lower-case element name, ``#text`` for character data and
               ``#data`` for raw script/style content (which get_text skips)
* ``attrs``  – map of attributes (entities decoded, last duplicate wins)
* ``classes``– the class attribute split on whitespace
* ``text``   – character data for ``#text``/``#data`` nodes
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import at, let

NODE_TYPE = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)
NODES_TYPE = T.ArrayType(NODE_TYPE)

# Elements without content (never pushed on the open-element stack).
VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
RAW_TEXT_ELEMENTS = frozenset(["script", "style"])


class _TreeBuilder(HTMLParser):
    """Flat pre-order tree; end tags close the most recent open element of that name
    (unmatched end tags are ignored, nothing is closed implicitly)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.stack: list[int] = []

    def _add(self, tag, attrs=None, text=None):
        idx = len(self.nodes)
        classes = None
        if attrs is not None:
            cls = attrs.get("class")
            classes = cls.split() if cls else []
        self.nodes.append(
            {
                "idx": idx,
                "parent": self.stack[-1] if self.stack else -1,
                "end": idx,
                "depth": len(self.stack),
                "tag": tag,
                "attrs": attrs,
                "classes": classes,
                "text": text,
            }
        )
        return idx

    @staticmethod
    def _attrs(attrs):
        return {k: ("" if v is None else v) for k, v in attrs}

    def handle_starttag(self, tag, attrs):
        idx = self._add(tag, self._attrs(attrs))
        if tag not in VOID_ELEMENTS:
            self.stack.append(idx)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, self._attrs(attrs))

    def handle_endtag(self, tag):
        for pos in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[pos]]["tag"] == tag:
                last = len(self.nodes) - 1
                for i in self.stack[pos:]:
                    self.nodes[i]["end"] = last
                del self.stack[pos:]
                return

    def handle_data(self, data):
        parent = self.nodes[self.stack[-1]]["tag"] if self.stack else None
        kind = "#data" if parent in RAW_TEXT_ELEMENTS else "#text"
        prev = self.nodes[-1] if self.nodes else None
        if prev is not None and prev["tag"] == kind and prev["parent"] == (self.stack[-1] if self.stack else -1):
            prev["text"] += data
        else:
            self._add(kind, None, data)

    def finish(self):
        self.close()
        last = len(self.nodes) - 1
        for i in self.stack:
            self.nodes[i]["end"] = last
        self.stack = []
        return self.nodes


def parse_html(html):
    """Parse one document (plain Python; used by the UDF and by tests)."""
    if html is None:
        return None
    b = _TreeBuilder()
    try:
        b.feed(html)
        return b.finish()
    except Exception:  # tolerant: keep what was parsed
        last = len(b.nodes) - 1
        for i in b.stack:
            b.nodes[i]["end"] = last
        return b.nodes


#: Characters of HTML of which a task holds the parsed form at once, whatever the size of its Arrow batches; one page at least.
SLICE_CHARS = 1 << 19


def slices(html: pd.Series, chars: int | None = None) -> Iterator[slice]:
    """Consecutive rows, all of them: a slice ends where it has ``chars`` characters (SLICE_CHARS) or a thousand rows."""
    start, held, most = 0, 0, chars or SLICE_CHARS
    for stop, text in enumerate(html, 1):
        held += len(text or "")
        if held >= most or stop - start >= 1000:
            yield slice(start, stop)
            start, held = stop, 0
    if start < len(html):
        yield slice(start, len(html))


@F.pandas_udf(NODES_TYPE)
def _parse_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in batches:
        for rows in slices(html):
            yield html.iloc[rows].map(parse_html)


def parse_pages(df: DataFrame, html_col: str = "html", out: str = "nodes", drop_html: bool = True) -> DataFrame:
    """H1: add the ``nodes`` column; by default the raw html column is dropped
    right after (it is the widest column and nothing downstream needs it). Map-only, for tables and streams: a task per input split
    (``spark.sql.files.maxPartitionBytes``)."""
    res = df.withColumn(out, _parse_udf(F.col(html_col)))
    return res.drop(html_col) if drop_html and html_col != out else res


# ---------------------------------------------------------------------------
# Native helpers over ``nodes``.  A selector is a function (nodes, node) -> Column.
# ---------------------------------------------------------------------------

def tag(name: str):
    return lambda nodes, n: n.tag == name


def cls(name: str):
    return lambda nodes, n: F.array_contains(n.classes, name)


def el_id(value: str):
    return lambda nodes, n: at(n.attrs, F.lit("id")) == value


def has_attr(name: str):
    return lambda nodes, n: F.map_contains_key(n.attrs, name)


def attr_eq(name: str, value: str):
    return lambda nodes, n: F.coalesce(at(n.attrs, F.lit(name)) == value, F.lit(False))


def attr_word(name: str, value: str):
    """Multi-valued attribute (rel, class) contains the word ``value``."""
    return lambda nodes, n: F.coalesce(
        F.array_contains(F.split(F.trim(at(n.attrs, F.lit(name))), r"\s+"), value), F.lit(False)
    )


def attr_contains(name: str, value: str):
    return lambda nodes, n: F.coalesce(at(n.attrs, F.lit(name)).contains(value), F.lit(False))


def all_of(*sels):
    def sel(nodes, n):
        out = sels[0](nodes, n)
        for s in sels[1:]:
            out = out & s(nodes, n)
        return out

    return sel


def any_of(*sels):
    def sel(nodes, n):
        out = sels[0](nodes, n)
        for s in sels[1:]:
            out = out | s(nodes, n)
        return out

    return sel


class under:
    """Descendant combinator ``ancestor sel``: an interval test against the (few) nodes
    matching ``ancestor``.  ``select_all`` computes those spans once per document, so the
    cost is O(nodes × matches), not an ancestor walk per node."""

    def __init__(self, ancestor, sel):
        self.ancestor, self.sel = ancestor, sel

    def spans(self, nodes: Column) -> Column:
        return F.filter(nodes, lambda m: self.ancestor(nodes, m))

    def with_spans(self, nodes: Column, spans: Column, n: Column) -> Column:
        return self.sel(nodes, n) & F.exists(spans, lambda m: (m.idx < n.idx) & (n.idx <= m.end))

    def __call__(self, nodes, n):
        return self.with_spans(nodes, self.spans(nodes), n)


def is_element(n: Column) -> Column:
    return ~n.tag.startswith("#")


def select_all(nodes: Column, sel) -> Column:
    """All element nodes matching ``sel`` in document order."""
    if isinstance(sel, under):
        return let(sel.spans(nodes), lambda sp: F.filter(nodes, lambda n: is_element(n) & sel.with_spans(nodes, sp, n)))
    return F.filter(nodes, lambda n: is_element(n) & sel(nodes, n))


def select_first(nodes: Column, sel) -> Column:
    return at(select_all(nodes, sel), 1)


def descendants(nodes: Column, node: Column) -> Column:
    return F.slice(nodes, node.idx + 2, F.greatest(node.end - node.idx, F.lit(0)))


def get_text(nodes: Column, node: Column) -> Column:
    """BeautifulSoup ``get_text()``: all descendant character data (script/style skipped)."""
    return F.array_join(
        F.transform(F.filter(descendants(nodes, node), lambda m: m.tag == "#text"), lambda m: m.text), ""
    )


def string_of(nodes: Column, node: Column) -> Column:
    """BeautifulSoup ``.string``: the text of a node whose only child is text (one element level deep)."""

    def one(kids):
        only = at(kids, 1)
        inner = F.filter(nodes, lambda m: m.parent == only.idx)
        return (
            F.when(F.size(kids) != 1, F.lit(None).cast("string"))
            .when(only.tag.isin("#text", "#data"), only.text)
            .otherwise(
                let(inner, lambda ik: F.when((F.size(ik) == 1) & at(ik, 1).tag.isin("#text", "#data"),
                                             at(ik, 1).text))
            )
        )

    return let(F.filter(nodes, lambda m: m.parent == node.idx), one)


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace plus the \\x1c-\\x1f separators)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse_ws(c: Column) -> Column:
    """Python ``' '.join(s.split())``."""
    return py_strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


# ---------------------------------------------------------------------------
# H6 / H7 on the parsed tree (the renderer applies the same rules in Python)
# ---------------------------------------------------------------------------

def removal_roots(nodes: Column, boilerplate: bool = True) -> Column:
    """H6: element nodes whose subtree is dropped before rendering: script, style, iframe,
    inline display:none, [hidden]; with ``boilerplate`` also noscript/header/footer/nav
    tags, the boilerplate classes and the related-posts id."""
    from .markdown import ALWAYS_REMOVED_TAGS, BOILERPLATE_CLASSES, BOILERPLATE_IDS, BOILERPLATE_TAGS

    tags = BOILERPLATE_TAGS if boilerplate else ALWAYS_REMOVED_TAGS

    def sel(ns, n):
        cond = (n.tag.isin(tags) | F.map_contains_key(n.attrs, "hidden")
                | F.coalesce(at(n.attrs, "style").contains("display:none"), F.lit(False)))
        if boilerplate:
            cond = (cond | F.coalesce(at(n.attrs, "id").isin(BOILERPLATE_IDS), F.lit(False))
                    | F.arrays_overlap(n.classes, F.array(*[F.lit(c) for c in BOILERPLATE_CLASSES])))
        return cond

    return select_all(nodes, sel)


def main_content_root(nodes: Column, boilerplate: bool = True) -> Column:
    """H7: the first non-removed node matching the preference list (article, .post-content,
    .entry-content, .content, main, .main-content, .article-content, .post, #content), else
    <body>, else NULL (the whole document)."""
    from .markdown import MAIN_CONTENT

    def pick(spans):
        def kept(sel):
            return lambda ns, n: sel(ns, n) & ~F.exists(spans, lambda r: (r.idx <= n.idx) & (n.idx <= r.end))

        cands = []
        for kind, value in MAIN_CONTENT:
            base = tag(value) if kind == "tag" else cls(value) if kind == "class" else el_id(value)
            cands.append(select_first(nodes, kept(base)))
        cands.append(select_first(nodes, tag("body")))
        return F.coalesce(*cands)

    return let(removal_roots(nodes, boilerplate), pick)


def main_text(nodes: Column, boilerplate: bool = True) -> Column:
    """Character data of the main content without removed subtrees (get_text semantics)."""
    def text(v):
        root, spans = v.root, v.spans
        inside = F.filter(
            nodes,
            lambda m: (m.tag == "#text")
            & (root.isNull() | ((m.idx > root.idx) & (m.idx <= root.end)))
            & ~F.exists(spans, lambda r: (r.idx <= m.idx) & (m.idx <= r.end)),
        )
        return F.array_join(F.transform(inside, lambda m: m.text), "")

    return let(F.struct(main_content_root(nodes, boilerplate).alias("root"),
                        removal_roots(nodes, boilerplate).alias("spans")), text)
