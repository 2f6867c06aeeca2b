"""Writers (K1-K8, E3): every output is a distributed Spark write; nothing is collected.

One file per page (the reference's layout) is an anti-pattern at scale, so pages and
Markdown documents are stored as partitioned tables with their mirror/markdown path as
a column; ``write_lines`` produces ordered text files for reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.windows import join_null_safe, number_rows
from .store import TARGET_BYTES, page_bytes, pages_of, write_store


def write_urls(df: DataFrame, path: str, run_id: str) -> None:
    """K1: the discovered URLs of one run as JSON Lines under run_id=…"""
    df.write.mode("overwrite").json(f"{path.rstrip('/')}/run_id={run_id}")


def write_pages(pages: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> None:
    """K2: fetched pages with their site and mirror path (Q16: site + path is the key), in files of about
    ``target_bytes`` (see ``store``; ``store.replace_sites`` replaces single sites)."""
    write_store(pages_of(pages), path, "site", ["mirror_path"], page_bytes("html"), target_bytes)


#: Columns of the fetch log in a page's metadata record, with what a log without them gives.
_LOG_COLUMNS = {"status_code": "int", "content_type": "string", "size_bytes": "bigint", "download_time_ms": "bigint", "headers": "map<string,string>"}


def page_metadata(log: DataFrame, links: DataFrame, media_items: DataFrame, media_summary: DataFrame) -> DataFrame:
    """K3: the page-metadata record: page_id, url, timestamp, status_code, headers, content_type, size_bytes, download_time_ms,
    download_path, metadata_path, links[], media{total, downloaded, items[]}.

    ``log`` has one row per page (page_id, url, ts) and what it knows of status, headers, size and elapsed time; a column
    that it lacks is NULL. Link lists are bounded by one page's anchors."""
    link_lists = links.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "url", "text", "internal"))).alias("links"))
    m = media_summary.join(media_items, "page_id", "left").select(
        "page_id", F.struct(F.col("total").cast("int").alias("total"), F.col("downloaded").cast("int").alias("downloaded"),
                            F.coalesce("items", F.array()).alias("items")).alias("media"))
    known = [(F.col(c) if c in log.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _LOG_COLUMNS.items()]
    fetched = log.select("page_id", "url", (F.col("ts") if "ts" in log.columns else F.lit(None)).cast("timestamp_ntz").alias("timestamp"), *known)
    mp = U.mirror_path("url")
    return (fetched.join(link_lists, "page_id", "left").join(m, "page_id", "left")
            .withColumn("download_path", mp).withColumn("metadata_path", U.metadata_path(mp)))


def session_urls(log: DataFrame, session: Column) -> DataFrame:
    """The URLs of each session in the order of their requests: session, ordinal (from 0), url, count, timestamp
    (the session's first ``ts``). ``log``: seq, ts, url. The ordinal comes from one numbering of all rows, so a session that holds most of the log
    is spread like the others; only one row per session is joined back."""
    rows = number_rows(log.select(session.alias("session"), "seq", "ts", "url"), ["session", "seq", "url"], "_n")
    per = rows.groupBy("session").agg(F.min("_n").alias("_first"), F.count("*").alias("count"), F.min("ts").alias("timestamp"))
    return join_null_safe(rows.drop("ts"), per, ["session"]).select(
        "session", (F.col("_n") - F.col("_first")).alias("ordinal"), "url", "count", "timestamp")


def write_session(log: DataFrame, path: str, session: str) -> dict:
    """K4: one session's URL list and its record, from one pass over the log: the URLs as JSON Lines in order under
    ``urls/session=…``, and one record (session, count, timestamp, urls: the list's folder) under ``sessions/session=…``, whose count and
    time are observed while the list is written. Returns the record."""
    seen = Observation("session")
    rows = log.select("seq", "ts", "url").repartitionByRange("seq").sortWithinPartitions("seq")  # its sampling is a job of its own
    rows = rows.observe(seen, F.count("*").alias("count"), F.min("ts").cast("string").alias("timestamp"))
    folder = f"{path.rstrip('/')}/urls/session={session}"
    rows.select("seq", "url").write.mode("overwrite").json(folder)
    record = {"session": session, "count": seen.get["count"], "timestamp": seen.get["timestamp"], "urls": folder}
    spark = log.sparkSession
    spark.createDataFrame([tuple(record.values())], "session string, count bigint, timestamp string, urls string").write.mode(
        "overwrite").json(f"{path.rstrip('/')}/sessions/id={session}")
    return record


def status_record(log: DataFrame, session: Column | None = None) -> DataFrame:
    """K6: the status report per session: total_requests, successful_requests, status_codes (code to count; bounded by the
    number of codes), timestamp (the last ``ts``). Requests without a status count in the total only."""
    keyed = log.withColumn("session", session if session is not None else F.lit("all"))
    codes = keyed.groupBy("session", "status_code").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    entries = F.collect_list(F.when(F.col("status_code").isNotNull(), F.struct(F.col("status_code").cast("string").alias("key"), F.col("n").alias("value"))))
    return codes.groupBy("session").agg(
        F.sum("n").alias("total_requests"),
        F.sum(F.when((F.col("status_code") >= 200) & (F.col("status_code") < 300), F.col("n")).otherwise(0)).alias("successful_requests"),
        F.map_from_entries(F.array_sort(entries)).alias("status_codes"), F.max("ts").alias("timestamp"))


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """K3/K4/K6/K8: JSON Lines, optionally partitioned (e.g. by session)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def append_log(df: DataFrame, path: str) -> None:
    """K5 + E3: add new log entries to an existing log table (old entries stay as they are)."""
    df.write.mode("append").json(path)


def write_markdown(docs: DataFrame, path: str, site: str = "site", document_path: str = "path", target_bytes: int = TARGET_BYTES) -> None:
    """K7: Markdown documents (``site``, ``document_path``, content) in files of about ``target_bytes``."""
    rows = docs.select(site, document_path, *[c for c in docs.columns if c not in (site, document_path)])
    write_store(rows, path, site, [document_path], page_bytes("content"), target_bytes)


def write_lines(rows: DataFrame, path: str, group: str, order: list[str] | Column, line: str = "line") -> None:
    """K8: report lines as text files, one folder per ``group``, lines in ``order``.  Rows are
    range-partitioned by (group, order) so no task holds a whole large group."""
    order_cols = order if isinstance(order, list) else [order]
    (rows.repartitionByRange(group, *order_cols).sortWithinPartitions(group, *order_cols)
     .select(group, line).write.mode("overwrite").partitionBy(group).text(path))
