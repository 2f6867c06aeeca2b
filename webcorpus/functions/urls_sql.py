"""SQL-text forms of the URL functions.

Building a Column tree from Python costs one py4j round trip per node (plus one more
when each proxy is garbage collected); a URL join is hundreds of nodes.  When the
inputs are plain column references the same expression is emitted as SQL text and
parsed once by the JVM (``F.expr``), which keeps query construction fast.  The
semantics are identical to the Column versions in ``urls.py`` (both are exercised by
the property tests).
"""

from __future__ import annotations

import itertools

_ids = itertools.count()

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
REST_RE = r"(?s)^(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def lit(s: str) -> str:
    """A Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    """A (possibly dotted) column reference, back-quoted per part."""
    return ".".join(f"`{p}`" for p in name.split("."))


def _v(prefix: str) -> str:
    return f"{prefix}_{next(_ids)}"


def let(value: str, body) -> str:
    """Bind ``value`` to a fresh lambda variable for ``body(var)`` (evaluated once)."""
    v = _v("v")
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def in_list(x: str, items) -> str:
    return f"{x} IN ({', '.join(lit(i) for i in items)})"


def clean(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, {lit(r'^[\x00-\x20]+')}, ''), {lit(r'[\t\r\n]')}, '')"


def url_split(c: str) -> str:
    def parts(u):
        return let(
            f"regexp_replace({u}, {lit(SCHEME_RE)}, '')",
            lambda rest: (
                f"named_struct('scheme', lower(regexp_extract({u}, {lit(SCHEME_RE)}, 1)), "
                f"'netloc', regexp_extract({rest}, {lit(REST_RE)}, 2), "
                f"'path', regexp_extract({rest}, {lit(REST_RE)}, 3), "
                f"'query', regexp_extract({rest}, {lit(REST_RE)}, 5), "
                f"'fragment', regexp_extract({rest}, {lit(REST_RE)}, 7))"
            ),
        )

    return let(clean(c), parts)


def _unsplit(v: str, uses_netloc) -> str:
    s, n, p, q, f = (f"{v}.s", f"{v}.n", f"{v}.p", f"{v}.q", f"{v}.f")
    slash = f"CASE WHEN {p} = '' OR startswith({p}, '/') THEN {p} ELSE concat('/', {p}) END"
    body = (f"CASE WHEN {n} != '' THEN concat('//', {n}, {slash}) "
            f"WHEN startswith({p}, '//') THEN concat('//', {p}) "
            f"WHEN {s} != '' AND {in_list(s, uses_netloc)} AND ({p} = '' OR startswith({p}, '/')) "
            f"THEN concat('//', {p}) ELSE {p} END")
    ws = f"CASE WHEN {s} != '' THEN concat({s}, ':', {body}) ELSE {body} END"
    wq = f"CASE WHEN {q} != '' THEN concat({ws}, '?', {q}) ELSE {ws} END"
    return f"CASE WHEN {f} != '' THEN concat({wq}, '#', {f}) ELSE {wq} END"


def url_unsplit(scheme: str, netloc: str, path: str, query: str, fragment: str, uses_netloc) -> str:
    packed = (f"named_struct('s', {scheme}, 'n', {netloc}, 'p', {path}, 'q', {query}, 'f', {fragment})")
    return let(packed, lambda v: _unsplit(v, uses_netloc))


def _fold_dots(segs: str) -> str:
    acc, s = _v("acc"), _v("seg")
    folded = (f"aggregate({segs}, cast(array() AS array<string>), ({acc}, {s}) -> "
              f"CASE WHEN {s} = '..' THEN slice({acc}, 1, greatest(size({acc}) - 1, 0)) "
              f"WHEN {s} = '.' THEN {acc} ELSE concat({acc}, array({s})) END)")
    res = (f"CASE WHEN try_element_at({segs}, -1) IN ('.', '..') THEN concat({folded}, array('')) "
           f"ELSE {folded} END")
    return let(f"array_join({res}, '/')", lambda j: f"CASE WHEN {j} = '' THEN '/' ELSE {j} END")


def url_join(base: str, href: str, uses_relative, uses_netloc) -> str:
    def parts(v):
        b, h = f"{v}.b", f"{v}.h"
        scheme = f"CASE WHEN {h}.scheme != '' THEN {h}.scheme ELSE {b}.scheme END"

        def with_scheme(sch):
            netloc = f"CASE WHEN {in_list(sch, uses_netloc)} THEN {b}.netloc ELSE {h}.netloc END"

            def rel_segments(bparts):
                bdir = (f"CASE WHEN try_element_at({bparts}, -1) != '' THEN slice({bparts}, 1, size({bparts}) - 1) "
                        f"ELSE {bparts} END")
                x = _v("x")
                return let(
                    f"concat({bdir}, split({h}.path, '/', -1))",
                    lambda rel: (f"CASE WHEN size({rel}) > 2 THEN concat(slice({rel}, 1, 1), "
                                 f"filter(slice({rel}, 2, size({rel}) - 2), {x} -> {x} != ''), slice({rel}, -1, 1)) "
                                 f"ELSE {rel} END"),
                )

            segs = (f"CASE WHEN startswith({h}.path, '/') THEN split({h}.path, '/', -1) "
                    f"ELSE {let(f'split({b}.path, {lit(chr(47))}, -1)', rel_segments)} END")
            resolved = url_unsplit(sch, netloc, let(segs, _fold_dots), f"{h}.query", f"{h}.fragment", uses_netloc)
            no_path = url_unsplit(sch, netloc, f"{b}.path",
                                  f"CASE WHEN {h}.query != '' THEN {h}.query ELSE {b}.query END", f"{h}.fragment",
                                  uses_netloc)
            with_netloc = url_unsplit(sch, f"{h}.netloc", f"{h}.path", f"{h}.query", f"{h}.fragment", uses_netloc)
            return (f"CASE WHEN ({sch} != {b}.scheme) OR NOT ({in_list(sch, uses_relative)}) THEN {href} "
                    f"WHEN {in_list(sch, uses_netloc)} AND {h}.netloc != '' THEN {with_netloc} "
                    f"WHEN {h}.path = '' THEN {no_path} ELSE {resolved} END")

        return let(scheme, with_scheme)

    core = let(f"named_struct('b', {url_split(base)}, 'h', {url_split(href)})", parts)
    return (f"CASE WHEN {base} IS NULL OR {base} = '' THEN {href} "
            f"WHEN {href} IS NULL OR {href} = '' THEN {base} ELSE {core} END")


def url_key(c: str) -> str:
    return let(url_split(c), lambda s: f"concat({s}.scheme, '://', {s}.netloc, {s}.path)")


def origin(c: str) -> str:
    return let(url_split(c), lambda s: f"concat({s}.scheme, '://', {s}.netloc)")


def get_domain(c: str) -> str:
    return f"{url_split(c)}.netloc"


def site_key(c: str) -> str:
    return f"replace({get_domain(c)}, 'www.', '')"


def strip_query(c: str) -> str:
    return let(url_split(c), lambda s: f"CASE WHEN {s}.query != '' THEN concat({s}.scheme, '://', {s}.netloc, {s}.path) "
                                       f"ELSE {c} END")
