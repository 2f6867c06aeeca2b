import datetime
import glob
import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from webcorpus.functions import urls as U
from webcorpus.operators import fetchlog as FL
from webcorpus.operators.html import parse_pages
from webcorpus.operators.links import links_from_pages
from webcorpus.sources.fixtures import fx_fetch_log, fx_pages
from webcorpus.streaming import fetchlog_stream as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log_dir(spark):
    """The derived fetch log written as four files, one after another in ts order."""
    d = tempfile.mkdtemp(prefix="wc-stream-", dir="/tmp")
    log = fx_fetch_log(spark, SF).withColumn("part", F.ntile(4).over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts", "seq")))
    for i in range(1, 5):
        log.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(d)
    return d


def _batch_log(spark):
    return fx_fetch_log(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))


def test_status_counts_stream_equals_batch(spark, log_dir):
    stream = ST.read_fetch_log_stream(spark, log_dir, max_files_per_trigger=1)
    got = ST.run_available(ST.status_counts_windowed(stream, "1 hour", "10 minutes"), "wc_r1",
                           location=tempfile.mkdtemp(dir="/tmp"))
    b = _batch_log(spark)
    wm = b.agg(F.max("ts")).first()[0]
    exp = (b.groupBy(F.window("ts", "1 hour").alias("w"), "status_code").count()
           .where(F.col("w.end") <= F.lit(wm) - F.expr("INTERVAL 10 MINUTES")))
    g = sorted((r.window_start, r.status_code, r.responses) for r in got.collect())
    e = sorted((r.w.start, r.status_code, r["count"]) for r in exp.collect())
    assert g == e and len(g) > 0


def test_backoff_state_equals_batch(spark, log_dir):
    """Rows in several batches and any order within them; error texts count; only what the watermark has not passed waits."""
    late = F.when(F.col("seq") % 37 == 11, F.lit("Rate limit exceeded"))
    stream = ST.read_fetch_log_stream(spark, log_dir, max_files_per_trigger=1).withColumn("error", late)
    with ST.with_rocksdb(spark):
        got = ST.run_to_table(ST.backoff_state(stream, slot="1 hour", delay="10 minutes"), tempfile.mkdtemp(dir="/tmp") + "/out", "wc_r4",
                              location=tempfile.mkdtemp(dir="/tmp")).collect()
    log = _batch_log(spark).withColumn("error", late)
    w = Window.partitionBy("site").orderBy("ts", "seq")
    bump = FL.is_retryable(F.col("status_code"), F.col("attempt")) | FL.is_rate_limited(F.col("status_code"), F.col("error"))
    rows = log.withColumn("site", U.get_domain("url")).withColumn("b", bump).withColumn("n", F.sum(F.col("b").cast("long")).over(w))
    passed = log.agg(F.max("ts")).first()[0] - datetime.timedelta(minutes=10)
    exp = rows.where(F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR") <= F.lit(passed))
    p = FL.DEFAULT_POLICY
    want = sorted((r.site, r.seq, r.b, r.n, round(min(p.max_delay, p.request_delay * p.backoff_factor**r.n), 9)) for r in exp.collect())
    assert sorted((r.site, r.seq, r.backoff, r.backoffs, round(r.delay_s, 9)) for r in got) == want
    assert len(want) > 900 and any(r[2] for r in want)


def test_dedup_and_sessions(spark, log_dir):
    stream = ST.read_fetch_log_stream(spark, log_dir, max_files_per_trigger=1)
    got = ST.run_available(ST.dedup_urls(stream, "1 hour"), "wc_r3", location=tempfile.mkdtemp(dir="/tmp"))
    keys = {r.url_key for r in got.collect()}
    b = _batch_log(spark)
    from webcorpus.functions import urls as U
    assert keys == {r.k for r in b.select(U.url_key("url").alias("k")).distinct().collect()}
    stream = ST.read_fetch_log_stream(spark, log_dir, max_files_per_trigger=1)
    sess = ST.run_available(ST.host_sessions(stream, "30 minutes"), "wc_r5", location=tempfile.mkdtemp(dir="/tmp"))
    rows = sess.collect()
    assert rows and all(r.session_end > r.session_start for r in rows)
    assert sum(r.requests for r in rows) <= b.count()


def _pages_stream(spark, src):
    return spark.readStream.schema("page_id bigint, url string, html string").option("maxFilesPerTrigger", 1).parquet(src)


def test_incremental_pages_exactly_once(spark):
    src, out, location = (tempfile.mkdtemp(prefix="wc-pages-", dir="/tmp") for _ in range(3))
    pages = fx_pages(spark, SF).unionByName(spark.createDataFrame([(901, "https://plain.example/", "no links"), (902, "https://plain.example/?again", "x")],
                                                                  "page_id bigint, url string, html string"))
    parts = [pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
    ST.incremental_pages(_pages_stream(spark, src), out, location=location)
    read = lambda t: ST.read_incremental(spark, out, t)
    # skip-if-exists: of the pages with one key the first epoch's, then the smallest id, is kept
    early = read("processed").where("epoch = 0").first().page_id % 2  # the file of the first epoch
    first = {}
    for r in pages.select("page_id", U.url_key("url").alias("k")).collect():
        first[r.k] = min(first.get(r.k, (9, 0)), (int(r.page_id % 2 != early), r.page_id))
    kept = {p for _, p in first.values()}
    assert {r.page_id for r in read("processed").collect()} == kept and len(kept & {901, 902}) == 1
    for table in ("metadata", "markdown"):
        assert sorted(r.page_id for r in read(table).collect()) == sorted(kept)
    want = links_from_pages(pages.where(F.col("page_id").isin(list(kept)))).count()
    before = sorted(map(str, read("links").drop("run", "epoch").collect()))
    assert len(before) == want
    # nothing new: nothing changes; a replayed epoch replaces its own output
    ST.incremental_pages(_pages_stream(spark, src), out, location=location)
    run = read("commits").first().run
    for epoch in (0, 1):
        batch = spark.read.parquet(src).where(F.col("page_id") % 2 == (early if epoch == 0 else 1 - early))
        ST.write_epoch(batch, out, run, epoch)
    assert sorted(map(str, read("links").drop("run", "epoch").collect())) == before
    # an epoch without its commit record does not count
    links_from_pages(batch).write.parquet(f"{out}/links/run={run}/epoch=99")
    assert len(before) == read("links").count()


def test_incremental_pages_with_damaged_output(spark):
    src, out, location = (tempfile.mkdtemp(prefix="wc-pages-", dir="/tmp") for _ in range(3))
    fx_pages(spark, SF).where("page_id < 5").coalesce(1).write.mode("append").parquet(src)
    ST.incremental_pages(_pages_stream(spark, src), out, location=location)
    n = ST.read_incremental(spark, out, "links").count()
    files = glob.glob(f"{out}/processed/run=[!n]*/epoch=0/part-*.parquet")
    kept = {f: open(f, "rb").read() for f in files}
    for f in files:
        with open(f, "wb") as h:
            h.write(b"not parquet")
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        open(crc, "wb").close() if os.path.exists(crc) else None
    fx_pages(spark, SF).where("page_id BETWEEN 5 AND 9").coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception):  # never taken for an empty output
        ST.incremental_pages(_pages_stream(spark, src), out, location=location)
    for f, content in kept.items():
        with open(f, "wb") as h:
            h.write(content)
        os.replace(f, f)
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    ST.incremental_pages(_pages_stream(spark, src), out, location=location)
    assert ST.read_incremental(spark, out, "processed").count() == 10 and ST.read_incremental(spark, out, "links").count() > n


def test_parse_pages_on_a_stream(spark):
    src = tempfile.mkdtemp(prefix="wc-pages-", dir="/tmp")
    fx_pages(spark, SF).write.mode("append").parquet(src)
    parsed = parse_pages(_pages_stream(spark, src)).select("page_id", F.size("nodes").alias("n"))
    got = ST.run_to_table(parsed, tempfile.mkdtemp(dir="/tmp") + "/out", "wc_h1", location=tempfile.mkdtemp(dir="/tmp"))
    want = parse_pages(fx_pages(spark, SF)).select("page_id", F.size("nodes").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
