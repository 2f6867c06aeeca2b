"""Structured Streaming versions of the fetch-log operators.

The reference keeps running counters in one process; here they are event-time
aggregations with watermarks (append mode emits a window once it can no longer
change), stream-side dedup, a keyed stateful back-off processor and an incremental
page pipeline.  Checkpoints live under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import urls as U
from ..operators.fetchlog import DEFAULT_POLICY, RetryPolicy, is_rate_limited, is_retryable
from ..session import checkpoint_dir

FETCH_LOG_SCHEMA = ("seq bigint, ts timestamp_ntz, url string, status_code int, size_bytes bigint, "
                    "content_type string, attempt int")


def stream_location(spark: SparkSession, name: str) -> str:
    """Checkpoint folder of a named stream inside the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), "streams", name)


def read_fetch_log_stream(spark: SparkSession, path: str, schema: str = FETCH_LOG_SCHEMA,
                          max_files_per_trigger: int | None = None) -> DataFrame:
    """A fetch log arriving as parquet files; ``ts`` becomes a (zoned) timestamp because
    watermarks need one."""
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path).withColumn("ts", F.col("ts").cast("timestamp"))


def status_counts_windowed(log: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Responses per status code per event-time window."""
    return (log.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "status_code")
            .agg(F.count("*").alias("responses"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status_code", "responses"))


def throughput_windowed(log: DataFrame, window: str = "1 hour", slide: str | None = None,
                        delay: str = "10 minutes") -> DataFrame:
    """R2: requests, bytes, requests/s and KB/s per tumbling (or sliding) window and site."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    agg = (log.withWatermark("ts", delay).withColumn("site", U.get_domain("url"))
           .groupBy(w.alias("w"), "site")
           .agg(F.count("*").alias("requests"), F.sum("size_bytes").alias("bytes")))
    secs = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    return agg.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "site", "requests", "bytes",
        (F.col("requests") / secs).alias("req_per_s"), (F.col("bytes") / secs / 1024).alias("kb_per_s"))


def dedup_urls(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first event per url key within the watermark delay."""
    return (log.withColumn("url_key", U.url_key("url")).withWatermark("ts", delay)
            .dropDuplicatesWithinWatermark(["url_key"]))


def host_sessions(log: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Fetch sessions per host (a new session after ``gap`` without requests)."""
    return (log.withWatermark("ts", delay).withColumn("host", U.get_domain("url"))
            .groupBy("host", F.session_window("ts", gap).alias("s"))
            .agg(F.count("*").alias("requests"), F.sum("size_bytes").alias("bytes"))
            .select("host", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "requests", "bytes"))


BACKOFF_OUT = "site string, seq bigint, backoff boolean, backoffs bigint, delay_s double"
PENDING = "seq array<bigint>, ts array<bigint>, bump array<boolean>"


class _BackOff(StatefulProcessor):
    """A site's back-off events so far (value state), and its rows that wait for the watermark, by time slot (map state)."""

    def __init__(self, policy: RetryPolicy, slot_ms: int):
        self.policy, self.slot_ms = policy, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("backoffs", "n bigint")
        self.pending = handle.getMapState("pending", "slot bigint", PENDING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:  # as they come: each Arrow batch goes to its slots, none is gathered with others
            for slot, part in pdf.groupby((pdf["us"] // 1000 // self.slot_ms + 1) * self.slot_ms):
                slot = int(slot)
                old = self.pending.getValue((slot,)) if self.pending.containsKey((slot,)) else ([], [], [])
                fresh = (part["seq"].tolist(), part["us"].tolist(), part["bump"].tolist())
                self.pending.updateValue((slot,), tuple(list(o) + n for o, n in zip(old, fresh, strict=True)))
                self.handle.registerTimer(slot)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = expiredTimerInfo.getExpiryTimeInMs()
        if not self.pending.containsKey((slot,)):
            return
        seq, ts, bump = self.pending.getValue((slot,))
        self.pending.removeKey((slot,))
        rows = pd.DataFrame({"seq": list(seq), "ts": list(ts), "bump": list(bump)}).sort_values(["ts", "seq"], kind="stable")
        before = self.count.get()[0] if self.count.exists() else 0
        running = before + rows["bump"].astype("int64").cumsum()
        self.count.update((int(running.iloc[-1]),))
        p = self.policy
        delay = (p.request_delay * p.backoff_factor ** running.astype("float64")).clip(upper=p.max_delay)
        site = pd.Series([key[0]] * len(rows), index=rows.index, dtype=object)
        yield pd.DataFrame({"site": site, "seq": rows["seq"], "backoff": rows["bump"], "backoffs": running, "delay_s": delay})

    def close(self) -> None:
        pass


def backoff_state(log: DataFrame, policy: RetryPolicy = DEFAULT_POLICY, slot: str = "1 hour",
                  delay: str = "10 minutes") -> DataFrame:
    """The adaptive delay in force after each response, per site in (ts, seq) order, as keyed state.

    Retryable responses with attempts left (F8) and rate-limit signals (F9: 429, or an ``error`` text that says so)
    each raise the site's count of back-offs; a row's delay is the W6 closed form. Rows wait in slots of ``slot`` until the watermark (``delay`` behind the
    latest time) passes the slot's end; then a timer applies them in order, whichever batch or partition they came
    in, and their state is removed. Rows behind the watermark are late and dropped by Spark. A task holds one slot of
    one site at a time. Needs the RocksDB state store (``with_rocksdb``)."""
    err = F.col("error") if "error" in log.columns else None
    bump = is_retryable(F.col("status_code"), F.col("attempt"), policy) | is_rate_limited(F.col("status_code"), err)
    keyed = log.withWatermark("ts", delay).select(F.coalesce(U.get_domain("url"), F.lit("")).alias("site"), "seq", "ts", F.unix_micros("ts").alias("us"), bump.alias("bump"))
    slot_ms = int(pd.Timedelta(slot).total_seconds() * 1000)
    return keyed.groupBy("site").transformWithStateInPandas(
        statefulProcessor=_BackOff(policy, slot_ms), outputStructType=BACKOFF_OUT, outputMode="Append", timeMode="EventTime")


@contextmanager
def with_rocksdb(spark: SparkSession):
    """The session with the RocksDB state store, which keyed state with timers needs; the former setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_table(df: DataFrame, path: str, name: str, location: str | None = None) -> DataFrame:
    """Run a streaming query over everything available now into a Parquet table at ``path`` (a shared folder)."""
    q = (df.writeStream.format("parquet").outputMode("append").option("path", path)
         .option("checkpointLocation", location or stream_location(df.sparkSession, name))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_available(df: DataFrame, name: str, output_mode: str = "append", location: str | None = None):
    """Run a streaming query over everything available now into a memory table ``name``."""
    spark = df.sparkSession
    q = (df.writeStream.format("memory").queryName(name).outputMode(output_mode)
         .option("checkpointLocation", location or stream_location(spark, name))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


#: The tables of the incremental pipeline; every row bears the run and epoch that wrote it.
INCREMENTAL = {
    "links": "page_id bigint, src_url string, pos int, href string, url string, text string, internal boolean",
    "metadata": "page_id bigint, url string, title string, excerpt string, date_published string, date_modified string, author string, "
                "categories array<string>, tags array<string>, featured_image string, content_type string, slug string",
    "markdown": "page_id bigint, url string, title string, markdown_path string, document string, images array<struct<url:string,name:string>>, converted boolean, error string",
    "processed": "url_key string, page_id bigint",
    "commits": "pages bigint",
}
_EPOCH = ", run string, epoch bigint"


def _open(spark: SparkSession, out: str, table: str) -> DataFrame:
    return spark.read.schema(INCREMENTAL[table] + _EPOCH).parquet(f"{out}/{table}")


def read_incremental(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table of the incremental pipeline: the rows of committed epochs only."""
    commits = _open(spark, out, "commits").select("run", "epoch")
    return _open(spark, out, table).join(F.broadcast(commits.distinct()), ["run", "epoch"], "left_semi")


def prepare_incremental(spark: SparkSession, out: str) -> None:
    """Make the (empty) tables, so that the first batch reads them like any other."""
    for table, schema in INCREMENTAL.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/{table}/run=none/epoch=-1")


def write_epoch(df: DataFrame, out: str, run: str, epoch: int) -> None:
    """One micro-batch of pages to links, metadata and Markdown, exactly once.

    Pages whose url key another committed epoch has processed are skipped (the reference's skip-if-exists), and of the
    batch's pages with one key the smallest page_id is kept; pages without links count as processed. Everything is written under the epoch's own
    folders, replacing what an earlier attempt at the same epoch left there; the commit record comes last, and readers
    see committed epochs only. An output that cannot be read is an error, never taken for an empty one."""
    from ..operators.extract import extract_metadata
    from ..operators.html import parse_pages
    from ..operators.links import extract_links
    from ..operators.markdown import convert

    spark = df.sparkSession

    def put(rows: DataFrame, table: str) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{table}/run={run}/epoch={epoch}")

    others = read_incremental(spark, out, "processed").where((F.col("run") != run) | (F.col("epoch") != epoch))
    keyed = df.select("page_id", "url", "html", U.url_key("url").alias("url_key"))
    first = keyed.groupBy("url_key").agg(F.min("page_id").alias("page_id")).join(others.select("url_key"), "url_key", "left_anti")
    new = keyed.join(first, ["url_key", "page_id"]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        pages = new.select("page_id", "url", "html")
        parsed = parse_pages(pages)
        put(extract_links(parsed), "links")
        put(extract_metadata(parsed, with_timestamp=False), "metadata")
        put(convert(pages), "markdown")
        put(new.select("url_key", "page_id"), "processed")
        put(new.agg(F.count("*").alias("pages")), "commits")
    finally:
        new.unpersist()


def incremental_pages(pages_stream: DataFrame, out: str, name: str = "pages", location: str | None = None) -> None:
    """Everything available now of a stream of pages (page_id, url, html), batch by batch, into the tables in ``out``
    (read with ``read_incremental``); the stream's checkpoint folder names the run."""
    spark = pages_stream.sparkSession
    location = location or stream_location(spark, name)
    run = hashlib.md5(location.encode()).hexdigest()[:12]
    out = out.rstrip("/")
    prepare_incremental(spark, out)
    q = (pages_stream.writeStream.foreachBatch(lambda df, epoch: write_epoch(df, out, run, epoch))
         .option("checkpointLocation", location).trigger(availableNow=True).start())
    q.awaitTermination()
