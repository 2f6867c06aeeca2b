"""Media references (H5, F6, F7, F13, U16, W3, A5) and content dedup."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import urls_sql as US
from ..functions.urls_sql import _v, lit
from . import nodes_sql as N

# Document extensions treated as media, allowed image extensions, max image size.
DOCUMENT_EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar"]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "svg"]
MAX_IMAGE_BYTES = 10 * 1024 * 1024


def url_extension(url) -> Column:
    """``os.path.splitext(url.split('?')[0])[1].lower()`` (leading dots of the name don't count)."""
    u = F.split(U._col(url), r"\?", 2).getItem(0)
    base = F.regexp_extract(u, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def is_document(url) -> Column:
    """the URL names a document file (pdf, Office, zip, rar)."""
    return url_extension(url).isin(DOCUMENT_EXTENSIONS)


def allowed_image(url, size=None) -> Column:
    """allowed image extension (jpg, jpeg, png, gif, svg) and, when known, ≤ 10 MiB."""
    ok = F.substring(url_extension(url), 2, 10).isin(IMAGE_EXTENSIONS)
    if size is not None:
        ok = ok & (F.coalesce(U._col(size), F.lit(0)) <= MAX_IMAGE_BYTES)
    return ok


def _ext_sql(u: str) -> str:
    base = f"regexp_extract(try_element_at(split({u}, {lit(chr(92) + '?')}, 2), 1), {lit('([^/]*)$')}, 1)"
    return f"lower(regexp_extract({base}, {lit(r'(?s)^\.*[^.].*(\.[^.]*)$')}, 1))"


def media_refs_sql(nodes: str, base: str) -> str:
    """H5 as SQL text: array<struct<pos, kind, url>> in the reference's order: img[src],
    stylesheet links, script[src], document anchors, then video, audio and source[src];
    duplicates kept."""
    def refs(sel, attr: str, kind: str) -> str:
        found = N.select_all(nodes, lambda n: f"({sel(n)}) AND {N.has_attr(attr)(n)}")
        n, r = _v("n"), _v("r")
        return (f"filter(transform({found}, {n} -> named_struct('kind', {lit(kind)}, "
                f"'ref', try_element_at({n}.attrs, {lit(attr)}))), {r} -> {r}.ref != '')")

    def stylesheet(n: str) -> str:
        return (f"{n}.tag = 'link' AND coalesce(array_contains(split(trim(try_element_at({n}.attrs, 'rel')), "
                f"{lit(chr(92) + 's+')}), 'stylesheet'), false)")

    d, d2, c = _v("d"), _v("d"), _v("c")
    joined = US.url_join(base, f"{d}.ref", U.USES_RELATIVE, U.USES_NETLOC)
    # only hrefs that can name a document are resolved: the extension of the joined url comes
    # from the href's own last segment, unless the href has no path ('?…', '#…') and inherits the base's;
    # tabs and line ends are no part of a url (U1), so they are taken out first
    ext_any = "|".join(e[1:] for e in DOCUMENT_EXTENSIONS)
    maybe = (f"filter({refs(N.tag('a'), 'href', 'document')}, {c} -> lower({US.clean(f'{c}.ref')}) RLIKE {lit(chr(92) + '.(' + ext_any + ')')} "
             f"OR startswith({US.clean(f'{c}.ref')}, '?') OR startswith({US.clean(f'{c}.ref')}, '#') OR {US.clean(f'{c}.ref')} = '')")
    docs = (f"filter(transform({maybe}, {d} -> named_struct('kind', {d}.kind, "
            f"'ref', {joined})), {d2} -> {_ext_sql(f'{d2}.ref')} IN ({', '.join(lit(e) for e in DOCUMENT_EXTENSIONS)}))")
    parts = [refs(N.tag("img"), "src", "img"), refs(stylesheet, "href", "stylesheet"),
             refs(N.tag("script"), "src", "script"), docs, refs(N.tag("video"), "src", "video"),
             refs(N.tag("audio"), "src", "audio"), refs(N.tag("source"), "src", "source")]
    r, i = _v("r"), _v("i")
    url = US.url_join(base, f"{r}.ref", U.USES_RELATIVE, U.USES_NETLOC)
    return (f"transform(concat({', '.join(parts)}), ({r}, {i}) -> named_struct('pos', {i}, 'kind', {r}.kind, "
            f"'url', CASE WHEN {r}.kind = 'document' THEN {r}.ref ELSE {url} END))")


def media_refs(nodes: str = "nodes", base: str = "url") -> Column:
    """H5 (column names in, Column out)."""
    return F.expr(media_refs_sql(US.ident(nodes), US.ident(base)))


def extract_media(parsed: DataFrame) -> DataFrame:
    """One row per media reference: page_id, src_url, pos, kind, url."""
    rows = parsed.select("page_id", F.col("url").alias("src_url"), F.explode(media_refs("nodes", "url")).alias("m"))
    return rows.select("page_id", "src_url", "m.pos", "m.kind", "m.url")


def media_status(media: DataFrame) -> DataFrame:
    """F7 + W3 + U16: external references are not fetched (status NULL); for same-site ones,
    in corpus order (page_id, pos): the first use of a url key is 'downloaded' unless an
    earlier key already produced the same file ('skipped'); later uses are 'exists'.

    Only the first use of a key can be anything but 'exists', so the grouped minima come back by (page_id, pos), a key
    of its own for every row: a url that every page uses is no hot join key, and external rows meet none."""
    m = media.select(
        "*",
        U.same_site("url", "src_url").alias("same_site"),
        U.url_key("url").alias("url_key"),
        U.site_folder("url").alias("site"),
        U.media_path("url").alias("file_path"),
    ).persist(StorageLevel.MEMORY_AND_DISK)  # read by two branches: parse the pages once
    # a key fixes its (site, file), so the first use of a file is the minimum over its keys' first uses
    key_first = m.where("same_site").groupBy("url_key", "site", "file_path").agg(F.min(F.struct("page_id", "pos")).alias("first"))
    path_first = key_first.groupBy("site", "file_path").agg(F.min("first").alias("path_first"))
    firsts = key_first.join(path_first, ["site", "file_path"]).select(
        "first.page_id", "first.pos", F.when(F.col("first") == F.col("path_first"), "downloaded").otherwise("skipped").alias("_first"))
    status = F.when(F.col("same_site"), F.coalesce("_first", F.lit("exists")))
    return m.join(firsts, ["page_id", "pos"], "left").withColumn("status", status).drop("_first")


def media_summary(status: DataFrame) -> DataFrame:
    """A5 per page: total references, handled (downloaded + exists + skipped) and each outcome."""
    return status.groupBy("page_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status").isNotNull()).alias("downloaded"),
        F.count_if(F.col("status") == "downloaded").alias("new_files"),
        F.count_if(F.col("status") == "exists").alias("exists"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(~F.col("same_site")).alias("external"),
    )


def media_items(status: DataFrame) -> DataFrame:
    """The per-page item list of the page-metadata record (K3); bounded by one page's references."""
    item = F.struct("pos", "url", "file_path", "status")
    return status.where(F.col("status").isNotNull()).groupBy("page_id").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )


def content_dedup(df: DataFrame, key: str, content: str) -> DataFrame:
    """Exact-content dedup: sha256 of the body; the smallest key per hash is the original,
    the others point to it; rows without content are one group.  Grouped min + join (the hash shuffle carries 32 bytes, not bodies)."""
    h = df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("content_hash"),
                  F.octet_length(F.col(content)).alias("size"))
    orig = h.groupBy("content_hash").agg(F.min(key).alias("original"), F.count("*").alias("copies"))
    orig = orig.withColumnRenamed("content_hash", "__hash")
    h = h.join(orig, F.col("content_hash").eqNullSafe(F.col("__hash"))).drop("__hash")
    return h.withColumn("is_duplicate", F.col(key) != F.col("original"))


def same_file(local: DataFrame, remote: DataFrame, key: str = "url_key") -> DataFrame:
    """Local file vs remote resource by key: equal size when the remote size is known;
    otherwise, for local files under 1 KiB, equal first 1 KiB of content."""
    j = local.alias("l").join(remote.alias("r"), key)
    known = F.col("r.size").isNotNull()
    small = F.octet_length(F.col("l.content")) < 1024
    prefix_eq = F.substring(F.col("r.content"), F.lit(1), F.octet_length(F.col("l.content"))) == F.col("l.content")
    same = F.when(known, F.octet_length(F.col("l.content")) == F.col("r.size")).when(small, prefix_eq).otherwise(False)
    return j.select(key, same.alias("same"))
