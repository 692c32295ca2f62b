"""The HTTP client's retry policy as analysis of a crawl log.

``fetch_log(url, attempt INT 0-based, status INT?, error_kind STRING?)``:
one row per attempt.  Nobody sleeps in an executor; the delays the policy
would have waited are computed as data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRYABLE_5XX = (502, 503, 504)
NETWORK_ERRORS = ("timeout", "connection")
# Progressive delays for 429, in seconds.
RATE_LIMIT_DELAYS = [5, 10, 20]


def backoff_delay(attempt: Column) -> Column:
    """``min(2 ** attempt, 4)`` seconds."""
    return F.least(F.pow(F.lit(2), attempt), F.lit(4.0))


def rate_limit_delay(attempt: Column) -> Column:
    """5, 10, 20, 20, ... seconds."""
    delays = F.array(*[F.lit(float(d)) for d in RATE_LIMIT_DELAYS])
    return F.element_at(delays, F.least(attempt, F.lit(len(RATE_LIMIT_DELAYS) - 1)) + 1)


def attempt_verdict(log: DataFrame, max_retries: int = 3) -> DataFrame:
    """``verdict`` in ok/retry/fail and the ``delay`` before the next try.

    No error (status below 400 and no error kind) is ok; 429, 502-504 and
    timeouts or connection errors are retried while ``attempt < max_retries``;
    other 4xx, other 5xx and other errors fail at once; the last allowed
    attempt always fails."""
    status, kind, attempt = F.col("status"), F.col("error_kind"), F.col("attempt")
    can_retry = attempt < max_retries
    http_error = status.isNotNull() & (status >= 400) & (status <= 599)
    ok = kind.isNull() & ~F.coalesce(http_error, F.lit(False))
    rate = http_error & (status == 429)
    server = http_error & status.isin(*RETRYABLE_5XX)
    network = ~F.coalesce(http_error, F.lit(False)) & kind.isin(*NETWORK_ERRORS)
    verdict = (F.when(ok, "ok")
               .when((rate | server | network) & can_retry, "retry")
               .otherwise("fail"))
    delay = (F.when(verdict != "retry", F.lit(0.0))
             .when(rate, rate_limit_delay(attempt))
             .otherwise(backoff_delay(attempt)))
    return log.withColumn("verdict", verdict).withColumn("delay", delay)


def fetch_outcome(verdicts: DataFrame, max_retries: int = 3) -> DataFrame:
    """per URL the first non-retry attempt decides; attempts used and the
    total delay waited before it.  One aggregate with partial aggregation: a
    URL is retried at most ``max_retries`` times, so its delays are summed per
    attempt number and the sums below the deciding attempt are added up.  A
    URL with very many attempts reaches the shuffle as one row per task."""
    decided = F.col("verdict") != "retry"
    waited = [F.sum(F.when(F.col("attempt") == k, F.col("delay"))).alias(f"_w{k}") for k in range(max_retries)]
    agg = verdicts.groupBy("url").agg(
        F.min(F.when(decided, F.col("attempt"))).alias("_at"),
        F.min_by(F.when(decided, F.struct("verdict", "status")), F.when(decided, F.col("attempt"))).alias("_d"),
        F.max("attempt").alias("_last"), *waited)
    before = [F.when(F.col("_at").isNull() | (F.col("_at") > k), F.coalesce(F.col(f"_w{k}"), F.lit(0.0)))
              .otherwise(F.lit(0.0)) for k in range(max_retries)]
    total = before[0]
    for x in before[1:]:
        total = total + x
    return agg.select(
        "url",
        F.coalesce(F.col("_d.verdict"), F.lit("pending")).alias("outcome"),
        F.col("_d.status").alias("final_status"),
        (F.coalesce("_at", "_last") + 1).cast("bigint").alias("attempts"),
        total.alias("total_delay"))


# events of one unit of the two-level positions: consecutive event ids
EVENT_UNIT = 1 << 12


def events_as_fetch_log(events: DataFrame) -> DataFrame:
    """Re-cast the driver's ``events`` as a crawl log: per user in event
    order, the n-th event (0-based) is attempt ``n mod 4`` of URL
    ``user/<user_id>/<n div 4>``; the event type gives the response."""
    from .ranking import positions
    events = events.select("event_id", "user_id", "event_type",
                           F.floor(F.col("event_id") / EVENT_UNIT).alias("_unit"))
    ranked = positions(events, ["user_id"], "_unit", ["event_id"], name="_n")
    n = F.col("_n") - 1
    status = (F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 503)
              .when(F.col("event_type") == "signup", 429).when(F.col("event_type") == "purchase", 500))
    return ranked.select(
        F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit("/"),
                 F.floor(n / 4).cast("string")).alias("url"),
        (n % 4).cast("int").alias("attempt"),
        status.cast("int").alias("status"),
        F.when(F.col("event_type") == "error", "timeout").alias("error_kind"))
