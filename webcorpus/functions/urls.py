"""URL scalar functions (U1-U19) as native Column expressions.

Everything here compiles to JVM expressions (regexp_extract, split, aggregate, ...)
so it stays inside whole-stage codegen; there is no Python UDF in this module.
Semantics follow the Python standard library's ``urllib.parse`` (lexical split,
RFC 3986 resolution with its Python-specific details) because that is what the
reference pipeline uses; ``parse_url`` is avoided on purpose (it goes through
``java.net.URI`` and rejects or rewrites URLs the Python parser accepts).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls_sql as S

# Scheme lists of Python's urllib.parse (uses_relative, uses_netloc).
USES_RELATIVE = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]
USES_NETLOC = [
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
    "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
    "git+ssh", "ws", "wss", "itms-services",
]

_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_REST_RE = r"(?s)^(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at(arr: Column, i) -> Column:
    """NULL-tolerant ``element_at`` (1-based; negative counts from the end; map keys too)."""
    return F.try_element_at(arr, F.lit(i) if isinstance(i, (int, str)) else i)


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it many times inside ``fn`` (a lambda variable).

    Column expressions are trees: referring to a sub-expression twice copies it, and
    nested URL logic would grow exponentially.  A one-element ``transform`` evaluates
    the value once per row and keeps the plan linear in size.
    """
    return at(F.transform(F.array(value), fn), 1)


def _clean(c: Column) -> Column:
    """Leading C0 controls/spaces stripped, tab/CR/LF removed (as urlsplit does)."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def url_split(c) -> Column:
    """struct<scheme, netloc, path, query, fragment>; never fails, NULL in → NULL fields."""
    if isinstance(c, str):
        return F.expr(S.url_split(S.ident(c)))
    def parts(u):
        return let(
            F.regexp_replace(u, _SCHEME_RE, ""),
            lambda rest: F.struct(
                F.lower(F.regexp_extract(u, _SCHEME_RE, 1)).alias("scheme"),
                F.regexp_extract(rest, _REST_RE, 2).alias("netloc"),
                F.regexp_extract(rest, _REST_RE, 3).alias("path"),
                F.regexp_extract(rest, _REST_RE, 5).alias("query"),
                F.regexp_extract(rest, _REST_RE, 7).alias("fragment"),
            ),
        )

    return let(_clean(_col(c)), parts)


def url_unsplit(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    """Inverse of url_split (urlunsplit): empty query/fragment are dropped."""
    return let(
        F.struct(scheme.alias("s"), netloc.alias("n"), path.alias("p"), query.alias("q"), fragment.alias("f")),
        lambda v: _unsplit(v.s, v.n, v.p, v.q, v.f),
    )


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    slash_path = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    body = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc, slash_path))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when((scheme != "") & scheme.isin(USES_NETLOC) & ((path == "") | path.startswith("/")),
              F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    with_scheme = F.when(scheme != "", F.concat(scheme, F.lit(":"), body)).otherwise(body)
    with_query = F.when(query != "", F.concat(with_scheme, F.lit("?"), query)).otherwise(with_scheme)
    return F.when(fragment != "", F.concat(with_query, F.lit("#"), fragment)).otherwise(with_query)


def _remove_dot_segments(segs: Column) -> Column:
    """Resolve '.' and '..' like urljoin: '..' above the root is dropped."""
    return let(segs, _fold_dots)


def _fold_dots(segs: Column) -> Column:
    empty = F.array().cast("array<string>")
    resolved = F.aggregate(
        segs,
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    resolved = F.when(at(segs, -1).isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(
        resolved
    )
    joined = F.array_join(resolved, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def url_join(base, href) -> Column:
    """``urllib.parse.urljoin(base, href)`` as a native expression."""
    if isinstance(base, str) and isinstance(href, str):
        return F.expr(S.url_join(S.ident(base), S.ident(href), USES_RELATIVE, USES_NETLOC))
    base, href = _col(base), _col(href)
    core = let(
        F.struct(url_split(base).alias("b"), url_split(href).alias("h")),
        lambda v: _join_parts(v.b, v.h, href),
    )
    return (
        F.when(base.isNull() | (base == ""), href)
        .when(href.isNull() | (href == ""), base)
        .otherwise(core)
    )


def _join_parts(b: Column, h: Column, href: Column) -> Column:
    scheme = F.when(h.scheme != "", h.scheme).otherwise(b.scheme)
    netloc = F.when(scheme.isin(USES_NETLOC), b.netloc).otherwise(h.netloc)

    def rel_segments(bparts):
        bdir = F.when(at(bparts, -1) != "", F.slice(bparts, 1, F.size(bparts) - 1)).otherwise(bparts)
        return let(
            F.concat(bdir, F.split(h.path, "/")),
            lambda rel: F.when(
                F.size(rel) > 2,
                F.concat(
                    F.slice(rel, 1, 1),
                    F.filter(F.slice(rel, 2, F.size(rel) - 2), lambda x: x != ""),
                    F.slice(rel, -1, 1),
                ),
            ).otherwise(rel),
        )

    segs = F.when(h.path.startswith("/"), F.split(h.path, "/")).otherwise(let(F.split(b.path, "/"), rel_segments))
    resolved = url_unsplit(scheme, netloc, _remove_dot_segments(segs), h.query, h.fragment)
    no_path = url_unsplit(scheme, netloc, b.path, F.when(h.query != "", h.query).otherwise(b.query), h.fragment)
    with_netloc = url_unsplit(scheme, h.netloc, h.path, h.query, h.fragment)
    return let(
        scheme,
        lambda sch: F.when((sch != b.scheme) | ~sch.isin(USES_RELATIVE), href)
        .when(sch.isin(USES_NETLOC) & (h.netloc != ""), with_netloc)
        .when(h.path == "", no_path)
        .otherwise(resolved),
    )


def url_unquote(c) -> Column:
    """Percent-decoding like ``urllib.parse.unquote``: '+' is kept, malformed '%' kept literally."""
    c = _col(c)
    prepared = F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(prepared)
    return F.when(~c.contains("%"), c).otherwise(F.coalesce(decoded, c))


def normalize_url(url, base=None) -> Column:
    """U3: '' for empty; drop the fragment; join to base when there is no netloc; percent-decode."""
    url = _col(url)
    cut = F.split(url, "#", 2).getItem(0)
    if base is not None:
        base = _col(base)
        joined = F.when((base.isNotNull()) & (base != "") & (url_split(cut).netloc == ""), url_join(base, cut))
        cut = joined.otherwise(cut)
    return F.when(url.isNull() | (url == ""), F.lit("")).otherwise(url_unquote(cut))


def get_domain(url) -> Column:
    """U4: the netloc (userinfo and port kept)."""
    if isinstance(url, str):
        return F.expr(S.get_domain(S.ident(url)))
    return url_split(url).netloc


def same_domain_exact(a, b) -> Column:
    """Netloc equality."""
    return get_domain(a) == get_domain(b)


def site_key(url) -> Column:
    """The netloc with every 'www.' removed (the reference's site identity)."""
    if isinstance(url, str):
        return F.expr(S.site_key(S.ident(url)))
    return F.replace(get_domain(url), F.lit("www."), F.lit(""))


def same_site(a, b) -> Column:
    """Equality after removing every 'www.' substring of both netlocs."""
    return site_key(a) == site_key(b)


def origin(url) -> Column:
    """scheme://netloc of a URL."""
    if isinstance(url, str):
        return F.expr(S.origin(S.ident(url)))
    s = url_split(url)
    return F.concat(s.scheme, F.lit("://"), s.netloc)


def to_relative(url, base) -> Column:
    """Same netloc → path[?query][#fragment], else unchanged."""
    u = url_split(url)
    rel = F.concat(
        u.path,
        F.when(u.query != "", F.concat(F.lit("?"), u.query)).otherwise(F.lit("")),
        F.when(u.fragment != "", F.concat(F.lit("#"), u.fragment)).otherwise(F.lit("")),
    )
    return F.when(u.netloc == get_domain(base), rel).otherwise(_col(url))


def url_key(url) -> Column:
    """Scheme://netloc+path (query and fragment dropped)."""
    if isinstance(url, str):
        return F.expr(S.url_key(S.ident(url)))
    s = url_split(url)
    return F.concat(s.scheme, F.lit("://"), s.netloc, s.path)


def strip_query(url) -> Column:
    """U8: only when a query is present → scheme://netloc+path (fragment goes with it)."""
    if isinstance(url, str):
        return F.expr(S.strip_query(S.ident(url)))
    return F.when(url_split(url).query != "", url_key(url)).otherwise(_col(url))


def drop_fragment(url) -> Column:
    return F.split(_col(url), "#", 2).getItem(0)


def url_to_filename(url, extension: str = ".html") -> Column:
    """netloc+path with / . ? & = space % → '_'; long names shortened with an md5 tag."""
    s = url_split(url)
    url = _col(url)
    p = F.translate(F.replace(F.concat(s.netloc, s.path), F.lit("://"), F.lit("_")), "/.?&= %", "_______")
    p = F.when(
        F.length(p) > 200, F.concat(F.substring(p, 1, 100), F.lit("_"), F.substring(F.md5(url), 1, 16))
    ).otherwise(p)
    return F.concat(F.lit("page_"), p, F.lit(extension))


# Reserved Windows device names.
RESERVED_NAMES = [
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
]


def sanitize_filename(name) -> Column:
    """Windows-invalid characters → '_', reserved names prefixed, trailing dots/spaces cut."""
    f = F.regexp_replace(_col(name), r'[<>:"/\\|?*]', "_")
    # os.path.splitext: the extension starts at the last dot that follows a non-dot character
    stem = F.regexp_extract(f, r"(?s)^(\.*[^.].*)\.[^.]*$", 1)
    stem = F.when(stem == "", f).otherwise(stem)
    f = F.when(F.upper(stem).isin(RESERVED_NAMES), F.concat(F.lit("_"), f)).otherwise(f)
    f = F.regexp_replace(f, r"[. ]+$", "")
    return F.when(f == "", F.lit("unnamed")).otherwise(f)


def _strip_slashes(c: Column) -> Column:
    return F.regexp_replace(c, r"^/+|/+$", "")


def slug(url) -> Column:
    """Last path segment after dropping a blog/posts/articles/news prefix, a date and .html/.php/.asp."""
    p = _strip_slashes(url_split(url).path)
    p = F.regexp_replace(p, r"^(blog|posts|articles|news)/", "")
    p = F.regexp_replace(p, r"^\d{4}/\d{2}/\d{2}/", "")
    p = F.regexp_replace(p, r"/+$", "")
    p = F.regexp_replace(p, r"\.(html|php|asp)$", "")
    return at(F.split(p, "/"), -1)


def site_folder(url) -> Column:
    """Netloc with '.' → '_'."""
    return F.replace(get_domain(url), F.lit("."), F.lit("_"))


def mirror_path(url) -> Column:
    """Page path inside the site's HTML folder (query and host not part of it)."""
    p = _strip_slashes(url_split(url).path)
    last = at(F.split(p, "/"), -1)
    with_ext = F.when(last.contains("."), p).otherwise(F.concat(p, F.lit(".html")))
    return F.when(p == "", F.concat(site_folder(url), F.lit("_index.html"))).otherwise(with_ext)


def metadata_path(mpath) -> Column:
    """Same folders, file stem + '_meta.json'."""
    mpath = _col(mpath)
    d = F.regexp_extract(mpath, r"^(.*/)?[^/]*$", 1)
    base = F.regexp_extract(mpath, r"([^/]*)$", 1)
    stem = F.regexp_extract(base, r"(?s)^(\.*[^.].*)\.[^.]*$", 1)
    stem = F.when(stem == "", base).otherwise(stem)
    return F.concat(d, stem, F.lit("_meta.json"))


def media_path(url) -> Column:
    """U16: media file path; an empty path gets 'media_<xxhash64(url)>'."""
    p = _strip_slashes(url_split(url).path)
    return F.when(p == "", F.concat(F.lit("media_"), F.xxhash64(_col(url)).cast("string"))).otherwise(p)


def markdown_path(url, slug_col=None, preserve_hierarchy: bool = True) -> Column:
    """Slug (else last segment, else 'index'), .html/.php/.asp dropped, sanitised, '.md'."""
    p = _strip_slashes(url_split(url).path)
    last = F.when(p == "", F.lit("index")).otherwise(at(F.split(p, "/"), -1))
    name = last if slug_col is None else F.when(F.coalesce(_col(slug_col), F.lit("")) != "", _col(slug_col)).otherwise(last)
    name = sanitize_filename(F.regexp_replace(name, r"\.(html|php|asp)$", ""))
    name = F.when(name.endswith(".md"), name).otherwise(F.concat(name, F.lit(".md")))
    if not preserve_hierarchy:
        return name
    parts = F.split(p, "/")
    sub = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    return F.when(F.size(parts) > 1, F.concat(sub, F.lit("/"), name)).otherwise(name)


def record_filename(url, i) -> Column:
    """U18: '{netloc}_{last segment or index}.json' with every '.' → '_', long names cut with the index."""
    s = url_split(url)
    p = _strip_slashes(s.path)
    last = F.when(p == "", F.lit("index")).otherwise(at(F.split(p, "/"), -1))
    f = F.replace(F.concat(s.netloc, F.lit("_"), last, F.lit(".json")), F.lit("."), F.lit("_"))
    return F.when(F.length(f) > 100, F.concat(F.substring(f, 1, 95), F.lit("_"), _col(i).cast("string"), F.lit(".json"))).otherwise(f)


def dirname(path) -> Column:
    """posixpath.dirname for relative paths."""
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def _norm_parts(path: Column) -> Column:
    """posixpath.normpath segments of a relative path ('' and '.' dropped, '..' folded)."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (at(acc, -1) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def relative_path(target, from_dir) -> Column:
    """``os.path.relpath(target, from_dir)`` for relative POSIX paths; target itself when from_dir is ''."""
    def common(p):
        return F.aggregate(
            F.zip_with(p.t, p.s, lambda a, b: F.when(a == b, 1).otherwise(0)),
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("run")),
            lambda acc, x: F.struct(
                F.when(acc.run & (x == 1), acc.n + 1).otherwise(acc.n).alias("n"),
                (acc.run & (x == 1)).alias("run"),
            ),
            lambda acc: acc.n,
        )

    def joined(p, n):
        ups = F.array_repeat(F.lit(".."), F.size(p.s) - n)
        rest = F.slice(p.t, n + 1, F.greatest(F.size(p.t) - n, F.lit(0)))
        return let(F.array_join(F.concat(ups, rest), "/"), lambda rel: F.when(rel == "", F.lit(".")).otherwise(rel))

    def relative(v):
        parts = F.struct(_norm_parts(v.target).alias("t"), _norm_parts(v.from_dir).alias("s"))
        rel = let(parts, lambda p: let(common(p), lambda n: joined(p, n)))
        return F.when(v.from_dir.isNull() | (v.from_dir == ""), v.target).otherwise(rel)

    return let(F.struct(_col(target).alias("target"), _col(from_dir).alias("from_dir")), relative)
