"""Phase 2 queries: fetch-log analytics over the derived fetch log (events × pages)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fetchlog as FL
from ..sources import sinks as SK
from ..sources.fixtures import FX_FETCH_LOG_SQL, fx_fetch_log
from ..streaming import fetchlog_stream as ST
from . import sqlfrag as S
from .registry import register

W = f"WITH {FX_FETCH_LOG_SQL}"
SITE = S.netloc("url")


def _r6(c):
    return F.round(c, 6)


@register("status_counts", f"{W} SELECT status_code, count(*) AS responses FROM fx_fetch_log GROUP BY 1")
def q_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + T3."""
    return FL.status_counts(fx_fetch_log(spark, sf_dir))


_LABEL_SQL = (
    "CASE status_code "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FL.STATUS_LABELS.items())
    + " ELSE CASE status_code // 100 "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FL.CLASS_LABELS.items())
    + " ELSE 'Unknown' END END"
)


@register(
    "status_classes",
    f"""{W}
SELECT CAST(status_code // 100 AS VARCHAR) || 'xx' AS status_class, status_code, count(*) AS responses,
       {_LABEL_SQL} AS label
FROM fx_fetch_log GROUP BY status_code""",
)
def q_status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return FL.status_classes(fx_fetch_log(spark, sf_dir))


@register(
    "status_report",
    f"""{W}
SELECT {SITE} AS site, count(DISTINCT url) AS urls, count(*) AS responses,
       count(*) FILTER (WHERE status_code >= 200 AND status_code < 300) AS successful,
       count(*) FILTER (WHERE status_code >= 300 AND status_code < 400) AS redirects,
       count(*) FILTER (WHERE status_code >= 400) AS errors,
       CAST(sum(CASE WHEN status_code < 300 THEN size_bytes ELSE 0 END) AS BIGINT) AS ok_bytes,
       min(ts) AS first_ts, max(ts) AS last_ts
FROM fx_fetch_log GROUP BY 1""",
)
def q_status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 / A9 / A13 per site."""
    return FL.status_report(fx_fetch_log(spark, sf_dir))


@register(
    "throughput",
    f"""{W}, t AS (
  SELECT {SITE} AS site, seq, ts,
         count(*) OVER w AS cum_requests, CAST(sum(coalesce(size_bytes, 0)) OVER w AS BIGINT) AS cum_bytes,
         (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY {SITE}))) / 1e6 AS elapsed_s
  FROM fx_fetch_log
  WINDOW w AS (PARTITION BY {SITE} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT site, seq, ts, cum_requests, cum_bytes, round(elapsed_s, 6) AS elapsed_s,
       round(CASE WHEN elapsed_s > 0 THEN cum_requests / elapsed_s ELSE 0 END, 6) AS req_per_s,
       round(CASE WHEN elapsed_s > 0 THEN cum_bytes / elapsed_s / 1024 ELSE 0 END, 6) AS kb_per_s,
       cum_requests % 10 = 0 AS report_point
FROM t""",
)
def q_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 + W5 (running totals per site, skew-safe)."""
    t = FL.throughput(fx_fetch_log(spark, sf_dir))
    return t.select(
        "site", "seq", "ts", "cum_requests", "cum_bytes",
        _r6(F.col("elapsed_s")).alias("elapsed_s"), _r6(F.col("req_per_s")).alias("req_per_s"),
        _r6(F.col("kb_per_s")).alias("kb_per_s"), "report_point",
    )


@register(
    "attempts",
    f"""{W}
SELECT seq, url, row_number() OVER (PARTITION BY url ORDER BY ts, seq) AS attempt_no FROM fx_fetch_log""",
)
def q_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt numbers per URL (bucketed running count, skew-safe)."""
    return FL.attempt_numbers(fx_fetch_log(spark, sf_dir)).select("seq", "url", "attempt_no")


_P = FL.DEFAULT_POLICY
_RETRY_CODES = ", ".join(str(c) for c in _P.retry_codes)


@register(
    "effective_delay",
    f"""{W}, b AS (
  SELECT {SITE} AS site, seq, url, status_code, attempt,
         coalesce(status_code IN ({_RETRY_CODES}) AND attempt <= {_P.max_retries}, false)
           OR coalesce(status_code = 429, false) AS backoff
  FROM fx_fetch_log)
SELECT site, seq, url, status_code, attempt, backoff,
       CAST(sum(CAST(backoff AS BIGINT)) OVER (PARTITION BY site ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS backoffs,
       round(least({_P.max_delay}, {_P.request_delay} * pow({_P.backoff_factor},
             sum(CAST(backoff AS BIGINT)) OVER (PARTITION BY site ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))), 6) AS delay_s
FROM b""",
)
def q_effective_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 adaptive back-off audit."""
    d = FL.effective_delay(fx_fetch_log(spark, sf_dir))
    return d.withColumn("delay_s", _r6(F.col("delay_s")))


_ERR_SQL = f"""
e AS (SELECT url, max(attempt) AS attempts, count(*) FILTER (WHERE status_code >= 400) AS errors,
             arg_max(status_code, attempt) AS last_status, arg_max(ts, attempt) AS last_ts
      FROM fx_fetch_log GROUP BY url)"""


@register("error_summary", f"{W}, {_ERR_SQL} SELECT *, last_status >= 400 AS failed FROM e")
def q_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return FL.error_summary(fx_fetch_log(spark, sf_dir))


@register(
    "retry_plan",
    f"""{W}, {_ERR_SQL}, a AS (
  SELECT url, attempts, last_status, last_ts,
         CASE WHEN last_status < 400 THEN 'done'
              WHEN last_status IN ({_RETRY_CODES}) AND attempts <= {_P.max_retries} THEN 'retry'
              ELSE 'failed' END AS action FROM e)
SELECT url, attempts, last_status, action,
       round(CASE WHEN action = 'retry' THEN {_P.request_delay} * pow(2.0, attempts) END, 6) AS wait_s,
       CASE WHEN action = 'retry'
            THEN last_ts + to_microseconds(CAST(round({_P.request_delay} * pow(2.0, attempts) * 1e6) AS BIGINT)) END
         AS next_try_at
FROM a""",
)
def q_retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7."""
    r = FL.retry_plan(fx_fetch_log(spark, sf_dir))
    return r.withColumn("wait_s", _r6(F.col("wait_s")))


_MP = "trim(" + S.path("url") + ", '/')"
_MIRROR = (
    f"CASE WHEN {_MP} = '' THEN replace({SITE}, '.', '_') || '_index.html' "
    f"WHEN regexp_extract({_MP}, '([^/]*)$', 1) LIKE '%.%' THEN {_MP} ELSE {_MP} || '.html' END"
)


@register(
    "path_collisions",
    f"""{W}, k AS (
  SELECT seq, url, replace({SITE}, '.', '_') AS site, {_MIRROR} AS mirror_path FROM fx_fetch_log
  WHERE content_type LIKE '%text/html%' AND status_code >= 200 AND status_code < 300)
SELECT seq, url, site, mirror_path,
       CASE WHEN seq = min(seq) OVER (PARTITION BY site, mirror_path) THEN 'downloaded' ELSE 'skipped' END AS status
FROM k""",
)
def q_path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 first-wins mirror paths (F1 applied)."""
    return FL.path_collisions(fx_fetch_log(spark, sf_dir))


@register(
    "response_flags",
    f"""{W}
SELECT seq, url, content_type LIKE '%text/html%' AS is_html,
       coalesce(status_code IN ({_RETRY_CODES}) AND attempt <= {_P.max_retries}, false) AS retryable,
       coalesce(status_code = 429, false) AS rate_limited,
       CAST(status_code // 100 AS VARCHAR) || 'xx' AS status_class, {_LABEL_SQL} AS label
FROM fx_fetch_log""",
)
def q_response_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F8, F9, A3 per response."""
    log = fx_fetch_log(spark, sf_dir)
    return log.select(
        "seq",
        "url",
        F.coalesce(F.col("content_type").contains("text/html"), F.lit(False)).alias("is_html"),
        FL.is_retryable(F.col("status_code"), F.col("attempt")).alias("retryable"),
        FL.is_rate_limited(F.col("status_code")).alias("rate_limited"),
        FL.status_class("status_code").alias("status_class"),
        FL.status_label("status_code").alias("label"),
    )


@register(
    "session_urls",
    f"""{W}
SELECT strftime(ts, '%Y%m%d') AS session, row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY seq) - 1 AS ordinal, url,
       count(*) OVER (PARTITION BY strftime(ts, '%Y%m%d')) AS count, min(ts) OVER (PARTITION BY strftime(ts, '%Y%m%d')) AS timestamp
FROM fx_fetch_log""",
)
def q_session_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL list of each day's session with its count and start."""
    return SK.session_urls(fx_fetch_log(spark, sf_dir), F.date_format("ts", "yyyyMMdd"))


@register(
    "status_records",
    f"""{W},
c AS (SELECT strftime(ts, '%Y%m%d') AS session, status_code, count(*) AS n, max(ts) AS ts FROM fx_fetch_log GROUP BY 1, 2)
SELECT session, CAST(sum(n) AS BIGINT) AS total_requests, CAST(coalesce(sum(n) FILTER (WHERE status_code BETWEEN 200 AND 299), 0) AS BIGINT) AS successful_requests,
       string_agg(status_code || '=' || n, ',' ORDER BY status_code) AS status_codes, max(ts) AS timestamp
FROM c GROUP BY 1""",
)
def q_status_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the status report of each day's session."""
    records = SK.status_record(fx_fetch_log(spark, sf_dir), F.date_format("ts", "yyyyMMdd"))
    codes = F.array_join(F.transform(F.array_sort(F.map_entries("status_codes")), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")
    return records.withColumn("status_codes", codes)


_DAY = 86_400_000


@register(
    "backoff_stream",
    f"""{W}, b AS (
  SELECT {SITE} AS site, seq, ts, coalesce(status_code IN ({_RETRY_CODES}) AND attempt <= {_P.max_retries}, false)
         OR coalesce(status_code = 429, false) OR event_error AS backoff
  FROM (SELECT *, seq % 37 = 11 AS event_error FROM fx_fetch_log)),
r AS (SELECT site, seq, ts, backoff, CAST(sum(CAST(backoff AS BIGINT)) OVER (PARTITION BY site ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS backoffs FROM b)
SELECT site, seq, backoff, backoffs, round(least({_P.max_delay}, {_P.request_delay} * pow({_P.backoff_factor}, backoffs)), 6) AS delay_s
FROM r WHERE (epoch_ms(ts) // {_DAY} + 1) * {_DAY} <= (SELECT epoch_ms(max(ts)) - 600000 FROM r)""",
)
def q_backoff_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The back-off audit as a stream over the log's files, error texts included: all days that the watermark has passed."""
    folder = ST.stream_location(spark, f"backoff-{uuid.uuid4().hex}")
    error = F.when(F.col("seq") % 37 == 11, F.lit("Rate limit exceeded"))
    log = fx_fetch_log(spark, sf_dir).withColumn("error", error)
    log.repartitionByRange(4, "ts").sortWithinPartitions("ts", "seq").write.parquet(f"{folder}/log")
    stream = ST.read_fetch_log_stream(spark, f"{folder}/log", ST.FETCH_LOG_SCHEMA + ", error string")
    with ST.with_rocksdb(spark):
        out = ST.run_to_table(ST.backoff_state(stream, slot="1 day"), f"{folder}/out", "backoff", f"{folder}/state")
    return out.withColumn("delay_s", _r6(F.col("delay_s")))
