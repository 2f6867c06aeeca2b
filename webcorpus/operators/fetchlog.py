"""Fetch-log analytics.

Input: a fetch log ``(seq, ts, url, status_code, size_bytes, content_type, attempt
[, error])`` with one row per HTTP response.  Everything is a grouped aggregation
(partial + final, so hot keys collapse map-side) or a skew-safe running total from
``windows.running_sums``; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .windows import first_wins, join_null_safe, running_sums


@dataclass(frozen=True)
class RetryPolicy:
    """The reference's defaults (max_retries 3, retry codes, delays, back-off)."""

    max_retries: int = 3
    retry_codes: tuple = (429, 500, 502, 503, 504)
    request_delay: float = 0.01
    max_delay: float = 5.0
    backoff_factor: float = 2.0
    extra: dict = field(default_factory=dict)


DEFAULT_POLICY = RetryPolicy()

# Status labels (code → text), then the class fallbacks.
STATUS_LABELS = {
    200: "OK", 201: "Created", 204: "No Content",
    301: "Moved Permanently", 302: "Found", 304: "Not Modified",
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 429: "Too Many Requests",
    500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}
CLASS_LABELS = {1: "INFO", 2: "Success", 3: "Redirect", 4: "Client Error", 5: "Server Error"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def html_only(log: DataFrame, content_type: str = "content_type") -> DataFrame:
    """responses whose Content-Type contains 'text/html' (case-sensitive, as the reference)."""
    return log.where(F.coalesce(_c(content_type).contains("text/html"), F.lit(False)))


def is_retryable(status: Column, attempt: Column, policy: RetryPolicy = DEFAULT_POLICY) -> Column:
    """F8: a retry code with attempts left (attempt is 1-based: attempt k has k-1 retries used)."""
    return F.coalesce(status.isin(list(policy.retry_codes)) & (attempt <= policy.max_retries), F.lit(False))


def is_rate_limited(status: Column, error: Column | None = None) -> Column:
    """HTTP 429, or an error text mentioning 'rate' with 'limit' or 'exceed'."""
    cond = F.coalesce(status == 429, F.lit(False))
    if error is not None:
        e = F.lower(F.coalesce(error, F.lit("")))
        cond = cond | (e.contains("rate") & (e.contains("limit") | e.contains("exceed")))
    return cond


def status_label(code) -> Column:
    """A3: the status description (named codes, else the class label, else 'Unknown')."""
    code = _c(code)
    expr = None
    for k, v in STATUS_LABELS.items():
        expr = (F.when(code == k, F.lit(v)) if expr is None else expr.when(code == k, F.lit(v)))
    for k, v in CLASS_LABELS.items():
        expr = expr.when((code >= k * 100) & (code < k * 100 + 100), F.lit(v))
    return expr.otherwise(F.lit("Unknown"))


def status_class(code) -> Column:
    code = _c(code)
    return F.when((code >= 100) & (code < 600), F.concat((code / 100).cast("int").cast("string"), F.lit("xx")))


def status_counts(log: DataFrame) -> DataFrame:
    """A1 + T3: responses per status code, sorted by code (the sort runs on the aggregated rows)."""
    return log.groupBy("status_code").agg(F.count("*").alias("responses")).orderBy("status_code")


def status_classes(log: DataFrame) -> DataFrame:
    """A3 rollup: responses per status class with the code's label."""
    return log.groupBy(status_class("status_code").alias("status_class"), "status_code").agg(
        F.count("*").alias("responses")
    ).withColumn("label", status_label("status_code"))


def status_report(log: DataFrame, with_map: bool = False) -> DataFrame:
    """A2 (+A9, A13): per site: urls requested, responses, successes, skipped redirects,
    errors, bytes; optionally the code→count map (built from per-code counts, so the map
    is bounded by the number of distinct codes, not by the log)."""
    site = U.get_domain("url")
    per = log.withColumn("site", site)
    out = per.groupBy("site").agg(
        F.countDistinct("url").alias("urls"),
        F.count("*").alias("responses"),
        F.count_if((F.col("status_code") >= 200) & (F.col("status_code") < 300)).alias("successful"),
        F.count_if((F.col("status_code") >= 300) & (F.col("status_code") < 400)).alias("redirects"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.sum(F.when(F.col("status_code") < 300, F.col("size_bytes")).otherwise(0)).alias("ok_bytes"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    if with_map:
        codes = per.groupBy("site", "status_code").agg(F.count("*").alias("n")).groupBy("site").agg(
            F.map_from_entries(F.collect_list(F.struct(F.col("status_code").cast("string"), "n"))).alias(
                "status_codes"
            )
        )
        out = out.join(codes, "site", "left")
    return out


def throughput(log: DataFrame, every: int = 10, partitions: int | None = None) -> DataFrame:
    """A4 + W5: per site, in arrival order (seq): cumulative requests and bytes, elapsed
    seconds since the site's first response, requests/s and KB/s (0 when no time has
    passed).  ``report_point`` marks every ``every``-th request (the reference's progress
    line) without dropping rows."""
    site = log.withColumn("site", U.get_domain("url"))
    run = running_sums(
        site,
        ["site"],
        ["seq"],
        {"cum_bytes": F.coalesce(F.col("size_bytes"), F.lit(0)).cast("bigint")},
        count_col="cum_requests",
        partitions=partitions,
    )
    start = site.groupBy("site").agg(F.min("ts").alias("_t0"))
    # wall-clock difference (no session time zone involved, so no DST shifts)
    elapsed = F.expr("timestampdiff(MICROSECOND, _t0, ts)") / 1e6
    return (
        join_null_safe(run, start, ["site"])
        .withColumn("elapsed_s", elapsed)
        .withColumn(
            "req_per_s", F.when(F.col("elapsed_s") > 0, F.col("cum_requests") / F.col("elapsed_s")).otherwise(0.0)
        )
        .withColumn(
            "kb_per_s",
            F.when(F.col("elapsed_s") > 0, F.col("cum_bytes") / F.col("elapsed_s") / 1024).otherwise(0.0),
        )
        .withColumn("report_point", (F.col("cum_requests") % every) == 0)
        .select("site", "seq", "ts", "cum_requests", "cum_bytes", "elapsed_s", "req_per_s", "kb_per_s", "report_point")
    )


def attempt_numbers(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """1-based attempt number per URL in (ts, seq) order, skew-safe for hot URLs; late rows count at their time."""
    return running_sums(log, ["url"], ["ts", "seq"], {}, count_col="attempt_no", partitions=partitions)


def effective_delay(log: DataFrame, policy: RetryPolicy = DEFAULT_POLICY, partitions: int | None = None) -> DataFrame:
    """The adaptive delay in force after each response, per site in arrival order.

    Every retryable response with attempts left (F8) or rate-limit signal (F9) multiplies
    the delay by the back-off factor, capped at max_delay; with factor ≥ 1 this is the
    closed form ``least(max, base * factor ^ k)`` with k the running count of such events.
    """
    err = F.col("error") if "error" in log.columns else None
    bump = is_retryable(F.col("status_code"), F.col("attempt"), policy) | is_rate_limited(F.col("status_code"), err)
    site = log.withColumn("site", U.get_domain("url")).withColumn("backoff", bump)
    run = running_sums(
        site, ["site"], ["seq"], {"backoffs": F.col("backoff").cast("bigint")}, partitions=partitions,
    )
    delay = F.least(
        F.lit(policy.max_delay), F.lit(policy.request_delay) * F.pow(F.lit(policy.backoff_factor), F.col("backoffs"))
    )
    return run.select("site", "seq", "url", "status_code", "attempt", "backoff", "backoffs", delay.alias("delay_s"))


def error_summary(log: DataFrame) -> DataFrame:
    """Per URL: attempts, error responses, the last response's status and whether the URL
    ended in failure.  ``max_by`` is a partial aggregate, so a hot URL costs one row per task."""
    last = F.max_by(F.struct("status_code", "ts"), F.struct("attempt", "seq"))
    return log.groupBy("url").agg(
        F.max("attempt").alias("attempts"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        last.status_code.alias("last_status"),
        last.ts.alias("last_ts"),
    ).withColumn("failed", F.col("last_status") >= 400)


def retry_plan(log: DataFrame, policy: RetryPolicy = DEFAULT_POLICY) -> DataFrame:
    """For each URL's last response: 'done', 'retry' (with the wait, delay × 2^attempt, and
    the time of the next try) or 'failed' once max_retries is used up / the error is final."""
    s = error_summary(log)
    retryable = F.col("last_status").isin(list(policy.retry_codes))
    action = (
        F.when(F.col("last_status") < 400, F.lit("done"))
        .when(retryable & (F.col("attempts") <= policy.max_retries), F.lit("retry"))
        .otherwise(F.lit("failed"))
    )
    wait = F.when(action == "retry", F.lit(policy.request_delay) * F.pow(F.lit(2.0), F.col("attempts")))
    return s.select(
        "url",
        "attempts",
        "last_status",
        action.alias("action"),
        wait.alias("wait_s"),
        F.when(action == "retry", F.col("last_ts") + F.make_interval(secs=wait)).alias("next_try_at"),
    )


def path_collisions(log: DataFrame) -> DataFrame:
    """Successful HTML fetches claim a mirror path per site; the first (by seq) is
    'downloaded', every later claim of the same (site, path) is 'skipped' (Q16 keys by site)."""
    ok = html_only(log).where((F.col("status_code") >= 200) & (F.col("status_code") < 300))
    keyed = ok.select(
        "seq", "url", U.site_folder("url").alias("site"), U.mirror_path("url").alias("mirror_path")
    )
    marked = first_wins(keyed, ["site", "mirror_path"], F.col("seq"), "is_first")
    return marked.select(
        "seq", "url", "site", "mirror_path",
        F.when(F.col("is_first"), F.lit("downloaded")).otherwise(F.lit("skipped")).alias("status"),
    )


def combined_log(page_log: DataFrame, media_log: DataFrame) -> DataFrame:
    """Page and media log entries in one table (missing columns become NULL)."""
    return page_log.withColumn("type", F.lit("page")).unionByName(
        media_log.withColumn("type", F.lit("media")), allowMissingColumns=True
    )
