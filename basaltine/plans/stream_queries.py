"""Streams over events, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.functions.time import epoch_us
from basaltine.plans.registry import query
from basaltine.session import table
from basaltine.streaming import core


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = core.source(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", epoch_us("ts").alias("us"), F.col("ts").cast("timestamp").alias("at"))


@query("stream_log_tail", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error'")
def stream_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = _stream(spark, sf_dir).where("event_type = 'error'").select("event_id", "user_id", "value")
    return core.finished(tail, "append")


@query(
    "stream_tumbling",
    """SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = core.Closing(_stream(spark, sf_dir), "at")
    w = e.rows.withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour"), "event_type")
    out = core.finished(w.agg(F.count("*").alias("n"), F.sum("value").alias("total")), "append", e)
    return out.select("event_type", F.unix_seconds("window.start").alias("start_s"), "n", F.round("total", 4).alias("total"))


@query(
    "stream_sliding",
    """SELECT event_type, CAST((floor(epoch_us(ts) / 1800000000) - k) * 1800 AS BIGINT) AS start_s, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL""",
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = core.Closing(_stream(spark, sf_dir), "at")
    w = e.rows.withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour", "30 minutes"), "event_type")
    out = core.finished(w.agg(F.count("*").alias("n")), "append", e)
    return out.select("event_type", F.unix_seconds("window.start").alias("start_s"), "n")


@query(
    "session_windows",
    """WITH o AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    s AS (SELECT user_id, us, sum(CASE WHEN p IS NULL OR us - p >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = core.Closing(_stream(spark, sf_dir), "at")
    w = e.rows.withWatermark("at", "1 hour").groupBy(F.session_window("at", "2 hours"), "user_id")
    out = core.finished(w.agg(F.count("*").alias("n")), "append", e)
    return out.select(
        "user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n"
    )


@query(
    "stream_state_machine",
    """SELECT user_id, coalesce(arg_min(CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'CANCELLED' END, (ts, event_id))
    FILTER (event_type IN ('purchase', 'error', 'signup')), CASE WHEN bool_or(event_type = 'click') THEN 'RUNNING' ELSE 'PENDING' END) AS state, count(*) AS n FROM events GROUP BY 1""",
)
def stream_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = core.finished(core.scan_states(_stream(spark, sf_dir).drop("at")), "update")
    return out.groupBy("user_id").agg(F.max_by("state", "batch").alias("state"), F.max("n").alias("n"))


@query(
    "stream_sliding_limit",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r(user_id, k, recent, event_id, allowed) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN) FROM o
    UNION ALL SELECT user_id, k, CASE WHEN len(kept) < 2 THEN list_append(kept, us) ELSE kept END, event_id, len(kept) < 2
    FROM (SELECT o.user_id, o.k, o.us, o.event_id, list_filter(r.recent, lambda x: o.us - x <= 14400000000) AS kept FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1))
    SELECT user_id, event_id, allowed FROM r WHERE k > 0""",
)
def stream_sliding_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.finished(core.rate_limited(_stream(spark, sf_dir).drop("at"), 4 * 3_600_000_000, 2), "append")


FIRST_END = "(SELECT user_id, min((ts, event_id)) AS e FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY 1)"


@query(
    "stream_scan_messages",
    f"""WITH f AS {FIRST_END}, l AS (SELECT e.user_id, event_id, event_type, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) - 1 AS seq
    FROM events e LEFT JOIN f ON f.user_id = e.user_id WHERE f.e IS NULL OR (ts, event_id) <= f.e)
    SELECT user_id, seq, 'log' AS kind, CAST(event_id AS VARCHAR) AS body FROM l UNION ALL
    SELECT user_id, seq + 1, 'done', CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'CANCELLED' END FROM l WHERE event_type IN ('purchase', 'error', 'signup')""",
)
def stream_scan_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.finished(core.scan_messages(_stream(spark, sf_dir).drop("at"), statuses=False), "append")


@query(
    "stream_progress",
    """SELECT user_id, done, total, least(100.0, round_even(100.0 * done / total, 1))::DOUBLE AS percent FROM
    (SELECT user_id, count(*) FILTER (event_type = 'view') AS done, count(*) AS total FROM events GROUP BY 1) WHERE done > 0""",
)
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"))
    told = core.finished(core.progress(_stream(spark, sf_dir).where("event_type = 'view'"), totals), "update")
    last = F.max_by(F.struct("done", "total", "percent"), "batch").alias("told")  # what each batch changed
    return told.groupBy("user_id").agg(last).select("user_id", "told.*")


@query(
    "stream_join",
    """SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase'
    AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 2 HOUR""",
)
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir)
    v = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("vu"), F.col("at").alias("va"))
    p = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("pu"), F.col("at").alias("pa"))
    v, p = v.withWatermark("va", "1 day"), p.withWatermark("pa", "1 day")
    both = v.join(p, F.expr("vu = pu AND pa >= va AND pa <= va + INTERVAL 2 HOURS"))
    return core.finished(both.select("view_id", "purchase_id"), "append")


@query(
    "request_window_counts",
    """SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 14400000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM events""",
)
def request_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", "user_id", epoch_us("ts").alias("us"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-14_400_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("in_window"))


@query(
    "stream_stalls",
    """WITH e AS (SELECT DISTINCT event_id, user_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM events),
    o AS (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS p FROM e), s AS (SELECT user_id, ms, sum(CASE WHEN p IS NULL OR ms - p > 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms) AS k FROM o)
    SELECT user_id, min(ms) AS start_ms, max(ms) AS last_ms, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ms) + 7200000 < (SELECT max(ms) FROM e) - 3600000""",
)
def stream_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events that nothing followed for two hours, with an hour for late ones."""
    with core.settings(spark, core.ROCKS):
        return core.finished(core.stalls(_stream(spark, sf_dir).withWatermark("at", "1 hour"), 7_200_000), "append")
