"""Reports (A6, A10, A11, A12, T2, T4, F12, U18).

Outputs are row sets with explicit order keys, not one big string per site: a site
with a third of the corpus must not become one value in one task.  ``write_lines``
(sinks) turns ordered rows into text files.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .markdown import word_count, reading_time
from .windows import top_k_per_group

SEP = "\u0001"  # below every printable character: a prefix sorts before its extensions


def _key_part(kind: int, name: Column) -> Column:
    return F.concat(F.lit(str(kind)), name)


def conversion_ok(df: DataFrame) -> Column:
    """a missing flag counts as failed."""
    return F.coalesce(F.col("converted"), F.lit(False))


def table_of_contents(results: DataFrame, root: str = "") -> DataFrame:
    """A10 + T4: per site, one row per ToC line with its depth and a sort key.

    Converted results (``converted`` and a ``markdown_path``) are listed: in every directory
    first its files by title, then its sub-directories by name, recursively; files at the
    root come first (Q10).  ``results(url, title, markdown_path, converted)``."""
    ok = results.where(conversion_ok(results) & F.col("markdown_path").isNotNull() & (F.col("markdown_path") != ""))
    path = F.col("markdown_path")
    rel = F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path) if root else path
    files = ok.select(
        U.get_domain("url").alias("site"),
        rel.alias("path"),
        F.coalesce(F.col("title"), F.regexp_extract(rel, r"([^/]*)$", 1)).alias("title"),
    ).withColumn("dirs", F.filter(F.split(U.dirname(F.col("path")), "/"), lambda d: (d != "") & (d != ".")))
    dir_keys = F.transform(F.col("dirs"), lambda d: _key_part(1, d))
    file_rows = files.select(
        "site",
        F.size("dirs").alias("depth"),
        F.concat_ws(SEP, F.concat(dir_keys, F.array(_key_part(0, F.col("title"))))).alias("sort_key"),
        F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("path"), F.lit(")")).alias("line_body"),
    )
    # every ancestor directory once: explode prefixes, then a distinct (grouped) projection
    dir_rows = files.select(
        "site", F.posexplode(F.transform(F.col("dirs"), lambda d, i: F.slice(F.col("dirs"), 1, i + 1))).alias("i", "pre")
    ).select(
        "site",
        F.col("i").alias("depth"),
        F.concat_ws(SEP, F.transform(F.col("pre"), lambda d: _key_part(1, d))).alias("sort_key"),
        F.concat(F.lit("- **"), F.try_element_at(F.col("pre"), F.lit(-1)), F.lit("/**")).alias("line_body"),
    ).distinct()
    rows = file_rows.unionByName(dir_rows)
    return rows.select("site", "depth", "sort_key",
                       F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("line_body")).alias("line"))


def site_index(results: DataFrame, when: Column | None = None, heading: str = "Pages of {site}",
               intro: str = "Markdown copies of the pages of {site}.", contents: str = "Pages", colophon: str = "Written on {date}.") -> DataFrame:
    """Index lines per site: heading, introduction, the table of contents, and a closing line with the date. The texts are
    the caller's; ``{site}`` and ``{date}`` stand for the site (or 'a site without a name') and the day of ``when`` (today)."""
    when = when if when is not None else F.current_date()
    toc = table_of_contents(results).select("site", F.concat(F.lit("1"), F.col("sort_key")).alias("sort_key"), "line")
    sites = results.where(F.col("url").isNotNull() & (F.col("url") != "")).select(U.get_domain("url").alias("site")).distinct()
    name = F.when(F.col("site") != "", F.col("site")).otherwise(F.lit("a site without a name"))

    def lines(place: str, *texts: str) -> DataFrame:
        filled = [F.replace(F.replace(F.lit(t), F.lit("{site}"), name), F.lit("{date}"), F.date_format(when, "yyyy-MM-dd")) for t in texts]
        rows = sites.select("site", F.posexplode(F.array(*filled)).alias("i", "line"))
        return rows.select("site", F.concat(F.lit(place), F.lpad(F.col("i").cast("string"), 3, "0")).alias("sort_key"), "line")

    head = lines("0", f"# {heading}", "", intro, "", f"## {contents}", "")
    return head.unionByName(toc).unionByName(lines("2", "", colophon))


def page_records(docs: DataFrame) -> DataFrame:
    """A12 + U18 + M9 + M10: per converted document: url, title ('Untitled'), download date,
    markdown path, images, word count, reading time and the record's file name.
    ``docs(idx, url, title, markdown_path, content, images, download_date, converted)``."""
    ok = docs.where(conversion_ok(docs))
    words = word_count(F.col("content"))
    return ok.select(
        "url",
        F.coalesce(F.col("title"), F.lit("Untitled")).alias("title"),
        "download_date",
        "markdown_path",
        "images",
        words.alias("word_count"),
        reading_time(words).alias("reading_time"),
        U.record_filename(F.col("url"), F.col("idx")).alias("record_file"),
    )


def metrics(df: DataFrame, exprs: dict) -> DataFrame:
    """One global aggregate computing several counters, unpivoted to (metric, value) rows:
    a single pass over ``df`` however many counters are asked for."""
    agg = df.agg(*[e.cast("bigint").alias(f"m{i}") for i, e in enumerate(exprs.values())])
    pairs = ", ".join(f"'{name}', m{i}" for i, name in enumerate(exprs))
    return agg.selectExpr(f"stack({len(exprs)}, {pairs}) AS (metric, value)")


def download_report(discovered: DataFrame, downloads: DataFrame, conversions: DataFrame,
                    validation: DataFrame) -> DataFrame:
    """The eight counters as (metric, value) rows; one aggregate per input table."""
    conv_ok = conversion_ok(conversions)
    done = F.coalesce(F.col("downloaded"), F.lit(False))
    parts = [
        metrics(discovered, {"crawled_urls": F.count("*")}),
        metrics(downloads, {"downloaded_pages": F.count_if(done), "failed_downloads": F.count_if(~done)}),
        metrics(conversions, {
            "converted_pages": F.count_if(conv_ok),
            "failed_conversions": F.count_if(~conv_ok),
            "downloaded_images": F.coalesce(F.sum(F.when(conv_ok, F.size("images")).otherwise(0)), F.lit(0)),
        }),
        metrics(validation, {"fixed_links": F.count_if(F.col("status") == "fixed"),
                             "broken_links": F.count_if(F.col("status") == "broken")}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_errors(errors: DataFrame, order: list[str], line: Column, section: str, k: int = 10) -> DataFrame:
    """The first ``k`` entries of an error list (as report lines) and, when there are more,
    an '... and N more' line; skew-safe global top-k plus one global count."""
    errors = errors.persist(StorageLevel.MEMORY_AND_DISK)  # read by the top-k and the count
    top = top_k_per_group(errors.withColumn("_line", line), [], order, k, rank_col="rank")
    lines = top.select(F.lit(section).alias("section"), "rank", F.col("_line").alias("line"))
    more = errors.agg(F.count("*").alias("n")).where(F.col("n") > k).select(
        F.lit(section).alias("section"), F.lit(k + 1).alias("rank"),
        F.concat(F.lit("- ... and "), (F.col("n") - k).cast("string"), F.lit(" more")).alias("line"))
    return lines.unionByName(more)
