"""F5 for a table of patterns: URLs that match any of many regular expressions.

Every pattern's longest literal that a match must contain goes into one Aho-Corasick automaton. A URL is read once by
it; only the patterns whose literal occurs are tried. Patterns without such a literal are tried on every URL.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns of one automaton; groups of URLs per automaton when there are more patterns than that.
PATTERN_BYTES, URL_GROUPS = 8 << 20, 256


def required_literal(pattern: str) -> str:
    """The longest text that every match of ``pattern`` contains ('' if none is sure)."""
    from re import _constants as C
    from re import _parser

    tree = _parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        return ""
    runs = [""]

    def walk(items):
        for op, arg in items:
            if op is C.LITERAL:
                runs[-1] += chr(arg)
            elif op is C.SUBPATTERN and not arg[1] and not arg[2]:  # no flags of its own
                walk(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
                runs.append("")
                walk(arg[2])
                runs.append("")
            elif op is not C.AT:  # anchors take no characters
                runs.append("")

    walk(tree)
    return max(runs, key=len)


class PatternSet:
    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.regexes = [re.compile(p) for p in patterns]
        by_literal: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            by_literal.setdefault(required_literal(p), []).append(i)
        self.always = by_literal.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for literal, which in by_literal.items():
            self.automaton.add_word(literal, which)
        if by_literal:
            self.automaton.make_automaton()

    def matches(self, url: str | None) -> bool:
        if url is None:
            return False
        if any(self.regexes[i].search(url) for i in self.always):
            return True
        tried = set()
        if len(self.automaton):
            for _, which in self.automaton.iter(url):
                for i in which:
                    if i not in tried:
                        tried.add(i)
                        if self.regexes[i].search(url):
                            return True
        return False


def exclude_by_table(df: DataFrame, patterns: DataFrame, url_col: str = "url", pattern_col: str = "pattern") -> DataFrame:
    """Rows of ``df`` whose URL matches none of the ``patterns`` (searched anywhere in it); a NULL URL stays.

    NULL patterns are none, an empty one matches every URL, one that is no regular expression is an error. Up to PATTERN_BYTES of
    patterns go to the executors as one automaton, and rows are filtered where they are; more are split by hash into sets of
    that size, and the distinct URLs of a group meet each set in a cogroup.
    """
    rows = patterns.select(F.col(pattern_col).alias("pattern")).where(F.col(pattern_col).isNotNull()).distinct()
    size = rows.agg(F.sum(F.octet_length("pattern") + 8)).first()[0] or 0
    if size <= PATTERN_BYTES:
        held = sorted(r.pattern for r in rows.collect())

        def keep(batches):
            found = PatternSet(held)
            for batch in batches:
                urls = batch.column(url_col).to_pylist()
                yield batch.filter(pa.array([not found.matches(u) for u in urls]))

        return df.mapInArrow(keep, df.schema) if held else df
    sets = -(-2 * size // PATTERN_BYTES)
    keyed = rows.withColumn("set", F.pmod(F.xxhash64("pattern"), F.lit(sets))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(URL_GROUPS - 1))))
    urls = df.select(F.col(url_col).alias("u")).where(F.col(url_col).isNotNull()).distinct()
    urls = urls.withColumn("part", F.pmod(F.xxhash64("u"), F.lit(URL_GROUPS)).cast("int")).withColumn("set", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(sets - 1).cast("bigint"))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = PatternSet(sorted(right["pattern"].to_pylist()))
        return pa.table({"u": pa.array([u for u in left["u"].to_pylist() if found.matches(u)], pa.string())})

    hit = urls.groupBy("set", "part").cogroup(keyed.groupBy("set", "part")).applyInArrow(meet, "u string").distinct()
    return df.join(hit, F.col(url_col) == F.col("u"), "left_anti")
