"""SQL-text builders over the parsed ``nodes`` array (same rules as the Column helpers in
``html.py``).  Each builder returns Spark SQL text; callers wrap the finished expression
in one ``F.expr``, so a large extraction is parsed once by the JVM instead of being
assembled node by node through py4j."""

from __future__ import annotations

from ..functions.urls_sql import _v, let, lit

PY_WS = r"[\s\x1c-\x1f]"


def tag(name: str):
    return lambda n: f"{n}.tag = {lit(name)}"


def cls(name: str):
    return lambda n: f"array_contains({n}.classes, {lit(name)})"


def el_id(value: str):
    return lambda n: f"coalesce(try_element_at({n}.attrs, 'id') = {lit(value)}, false)"


def has_attr(name: str):
    return lambda n: f"map_contains_key({n}.attrs, {lit(name)})"


def attr_eq(name: str, value: str):
    return lambda n: f"coalesce(try_element_at({n}.attrs, {lit(name)}) = {lit(value)}, false)"


def all_of(*sels):
    return lambda n: " AND ".join(f"({s(n)})" for s in sels)


class under:
    """Descendant combinator; ``select_all`` computes the ancestor spans once per document."""

    def __init__(self, ancestor, sel):
        self.ancestor, self.sel = ancestor, sel


def select_all(nodes: str, sel) -> str:
    v = _v("n")
    if isinstance(sel, under):
        a, r = _v("a"), _v("r")
        return let(
            f"filter({nodes}, {a} -> {sel.ancestor(a)})",
            lambda sp: (f"filter({nodes}, {v} -> NOT startswith({v}.tag, '#') AND ({sel.sel(v)}) "
                        f"AND exists({sp}, {r} -> {r}.idx < {v}.idx AND {v}.idx <= {r}.end))"),
        )
    return f"filter({nodes}, {v} -> NOT startswith({v}.tag, '#') AND ({sel(v)}))"


def select_first(nodes: str, sel) -> str:
    return f"try_element_at({select_all(nodes, sel)}, 1)"


def get_text(nodes: str, node: str) -> str:
    m, m2 = _v("m"), _v("m")
    return (f"array_join(transform(filter(slice({nodes}, {node}.idx + 2, greatest({node}.end - {node}.idx, 0)), "
            f"{m} -> {m}.tag = '#text'), {m2} -> {m2}.text), '')")


def py_strip(c: str) -> str:
    return f"regexp_replace({c}, {lit('(?U)^' + PY_WS + '+|' + PY_WS + '+$')}, '')"


def collapse_ws(c: str) -> str:
    return py_strip(f"regexp_replace({c}, {lit('(?U)' + PY_WS + '+')}, ' ')")


def nz(c: str) -> str:
    """NULL for '' (Python's `if not x`)."""
    return let(c, lambda x: f"CASE WHEN {x} != '' THEN {x} END")


def text_of(nodes: str, node: str) -> str:
    """Stripped text of a node, NULL when the node is missing or the text is empty."""
    return let(node, lambda x: f"CASE WHEN {x} IS NOT NULL THEN {nz(py_strip(get_text(nodes, x)))} END")
