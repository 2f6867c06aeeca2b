"""H10 (+H8): references of a page to its media, rewritten to local paths in the original HTML.

One tokenizer pass finds where each attribute value stands in the source and cuts the text there; everything between
stays byte for byte. Resolving (U2), the same-site test (F7), the document test (F6) and the local path (U16, U19) are native.
Every same-site reference has a local file, whichever page fetched it first (W3), and its path follows from the url alone; so no join is needed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U
from ..functions import urls_sql as US
from ..functions.urls_sql import _v, ident, let, lit
from .html import slices
from .media import DOCUMENT_EXTENSIONS, _ext_sql

#: Element to the attribute that names its medium; kinds as in H5.
MEDIA_ATTRIBUTES = {"img": ("src", "img"), "script": ("src", "script"), "link": ("href", "stylesheet"), "a": ("href", "document"),
                    "video": ("src", "video"), "audio": ("src", "audio"), "source": ("src", "source")}
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']?[^\s>]*))?""")

SPOTS = T.StructType([
    T.StructField("segments", T.ArrayType(T.StringType())),
    T.StructField("refs", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "value", "raw")]))),
])


class _Spots(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.found: list[tuple[int, int, str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag not in MEDIA_ATTRIBUTES:
            return
        name, kind = MEDIA_ATTRIBUTES[tag]
        given = dict(attrs)
        value = given.get(name)
        if not value or tag == "link" and "stylesheet" not in (given.get("rel") or "").split():
            return
        raw = self.get_starttag_text()
        spans = [m for m in _ATTRIBUTE.finditer(raw, 1 + len(tag)) if m[1].lower() == name and m[2]]
        if spans:
            text = spans[-1][2]  # of equal attributes the last one counts, as in H1
            if text[:1] in "\"'" and text[-1:] == text[:1]:
                text = text[1:-1]
            if unescape(text) == value:
                line, column = self.getpos()
                start = self.lines[line - 1] + column
                self.found.append((start + spans[-1].start(2), start + spans[-1].end(2), kind, value))


def media_spots(html: str | None) -> dict | None:
    """The source cut at its media references: ``segments`` (one more than ``refs``) and each reference's kind, value and raw text."""
    if html is None:
        return None
    parser = _Spots(html)
    parser.feed(html)
    parser.close()
    segments, refs, at = [], [], 0
    for start, end, kind, value in parser.found:
        segments.append(html[at:start])
        refs.append({"kind": kind, "value": value, "raw": html[start:end]})
        at = end
    return {"segments": [*segments, html[at:]], "refs": refs}


@F.pandas_udf(SPOTS)
def _spots_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for html in batches:
        for rows in slices(html):
            out = [media_spots(h) for h in html.iloc[rows]]
            yield pd.DataFrame({k: [o[k] if o else None for o in out] for k in ("segments", "refs")})


def _local_sql(base: str, ref: str, prefix: str) -> str:
    """The quoted local path of a reference; '' if it stays as it is (another site), NULL if it is a link to no document."""
    def of(url: str) -> str:
        path = let(f"trim(BOTH '/' FROM {US.url_split(url)}.path)", lambda p: f"CASE WHEN {p} = '' THEN concat('media_', xxhash64({url})) ELSE {p} END")
        extensions = ", ".join(lit(e) for e in DOCUMENT_EXTENSIONS)
        medium = f"{ref}.kind <> 'document' OR {_ext_sql(url)} IN ({extensions})"
        here = f"{US.site_key(url)} = {US.site_key(base)}"
        return f"CASE WHEN NOT ({medium}) THEN NULL WHEN NOT ({here}) THEN '' ELSE concat('\"', replace(replace(concat({prefix}, '/', {path}), '&', '&amp;'), '\"', '&quot;'), '\"') END"

    return let(US.url_join(base, f"{ref}.value", U.USES_RELATIVE, U.USES_NETLOC), of)


def rewrite_media_refs(pages: DataFrame, html_dir: str = "HTML", media_dir: str = "media") -> DataFrame:
    """page_id, url, html (rewritten), references (to media, of any site), rewritten: img, script, stylesheet, video, audio, source and document
    references of the page's own site point to ``media_dir``, relative to the page's file in ``html_dir`` (both in the
    site's folder). NULL html stays NULL with 0 references. Map-only."""
    cut = pages.select("page_id", "url", _spots_udf("html").alias("s"))
    folder = U.let(U.dirname(U.mirror_path("url")), lambda d: F.concat_ws("/", F.lit(html_dir), F.when(d != "", d)))
    cut = cut.select("page_id", "url", "s.segments", "s.refs", U.relative_path(F.lit(media_dir), folder).alias("prefix"))
    r, s, k, x = _v("r"), _v("s"), _v("k"), _v("x")
    # the prefix is bound outside of the loop over the references: once per page, also where the optimizer puts its expression here
    local = let(ident("prefix"), lambda p: f"transform(refs, {r} -> {_local_sql(ident('url'), r, p)})")
    cut = cut.withColumn("local", F.expr(local))
    new = f"zip_with(refs, local, ({r}, {x}) -> coalesce(nullif({x}, ''), {r}.raw))"
    html = f"concat(array_join(flatten(zip_with(slice(segments, 1, size(refs)), {new}, ({s}, {k}) -> array({s}, {k}))), ''), element_at(segments, -1))"
    count = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return cut.select("page_id", "url", F.when(F.col("refs").isNotNull(), F.expr(html)).alias("html"),
                      count(F.when(F.col("refs").isNotNull(), F.size(F.filter("local", lambda v: v.isNotNull())))).alias("references"),
                      count(F.when(F.col("refs").isNotNull(), F.size(F.filter("local", lambda v: v != "")))).alias("rewritten"))
