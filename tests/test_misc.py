import tempfile

from pyspark.sql import functions as F

from webcorpus.operators import fetchlog as FL
from webcorpus.operators import markdown as MD
from webcorpus.sources.fixtures import fx_fetch_log
from webcorpus.streaming import fetchlog_stream as ST


def test_front_matter_full_and_document(spark):
    df = spark.createDataFrame(
        [("https://a.com/p", "It's: a title", "2020-01-02", "", "Ann", "ex", ["News"], ["x", "y"], "https://a.com/i.png",
          "p")],
        "url string, title string, date_published string, date_modified string, author string, excerpt string, "
        "categories array<string>, tags array<string>, featured_image string, slug string")
    md = F.struct(*df.columns)
    r = df.select(MD.front_matter_full(md).alias("fm"), MD.markdown_document(MD.front_matter_full(md), F.lit("body"))
                  .alias("doc"), MD.markdown_document(F.lit("x"), F.lit(None).cast("string")).alias("none")).first()
    assert r.fm == ("---\ntitle: 'It''s: a title'\ndate: 2020-01-02\nauthor: Ann\nexcerpt: ex\ncategories:\n  - News\n"
                    "tags:\n  - x\n  - y\nheader:\n  image: 'https://a.com/i.png'\npermalink: /p/\n"
                    "original_url: 'https://a.com/p'\n---\n")
    assert r.doc == r.fm + "body" and r.none is None


def test_combined_log(spark):
    page = spark.createDataFrame([(1, "https://a.com/", 200)], "seq long, url string, status_code int")
    media = spark.createDataFrame([("https://a.com/i.png", "downloaded")], "url string, status string")
    rows = FL.combined_log(page, media).orderBy("type").collect()
    assert [(r.type, r.url, r.status_code, r.status) for r in rows] == [
        ("media", "https://a.com/i.png", None, "downloaded"), ("page", "https://a.com/", 200, None)]


def test_throughput_windowed_stream(spark):
    d = tempfile.mkdtemp(prefix="wc-r2-", dir="/tmp")
    log = fx_fetch_log(spark, "/root/testdata/sf0.001")
    log.coalesce(1).write.mode("overwrite").parquet(d)
    stream = ST.read_fetch_log_stream(spark, d)
    got = ST.run_available(ST.throughput_windowed(stream, "1 hour", "30 minutes", "10 minutes"), "wc_r2",
                           location=tempfile.mkdtemp(dir="/tmp")).collect()
    assert got and all(r.req_per_s == r.requests / 3600 for r in got)
    b = log.withColumn("ts", F.col("ts").cast("timestamp"))
    wm = b.agg(F.max("ts")).first()[0]
    from webcorpus.functions import urls as U
    exp = (b.withColumn("site", U.get_domain("url")).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "site")
           .agg(F.count("*").alias("n")).where(F.col("w.end") <= F.lit(wm) - F.expr("INTERVAL 10 MINUTES")))
    assert sorted((r.window_start, r.site, r.requests) for r in got) == sorted(
        (r.w.start, r.site, r.n) for r in exp.collect())


def test_status_map_and_page_metadata(spark):
    from webcorpus.operators import media as M
    from webcorpus.operators.links import links_from_pages
    from webcorpus.sources import sinks as K
    from webcorpus.sources.fixtures import fx_pages

    log = fx_fetch_log(spark, "/root/testdata/sf0.001")
    rep = FL.status_report(log, with_map=True).collect()
    for r in rep:
        assert sum(r.status_codes.values()) == r.responses
    pages = fx_pages(spark, "/root/testdata/sf0.001")
    from webcorpus.operators.html import parse_pages
    st = M.media_status(M.extract_media(parse_pages(pages)))
    meta = K.page_metadata(pages.select("page_id", "url"), links_from_pages(pages), M.media_items(st),
                           M.media_summary(st)).orderBy("page_id").first()
    assert meta.download_path and meta.metadata_path.endswith("_meta.json")
    assert meta.media.total == 2 and len(meta.links) >= 2 and meta.links[0].pos == 0
