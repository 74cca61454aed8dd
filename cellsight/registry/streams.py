"""Streaming queries: the events table as a file stream, read to its end, results read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellsight.registry import query
from cellsight.session import shared_dir
from cellsight.streaming import accumulate, alerts, ingest

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(t):
    return t.spark.readStream.schema(EVENT).option("pathGlobFilter", "events.parquet").parquet(t.folder)


def finished(stream, t, name):
    """Run to the end of the available files into a fresh folder of the shared directory."""
    base = f"{shared_dir(t.spark)}/streams/{name}-{uuid.uuid4().hex}"
    running = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start(f"{base}/rows")
    running.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{base}/rows")


@query(
    "stream_tumbling_sums",
    """WITH w AS (SELECT event_type, CAST(floor(epoch_us(ts) / 432000000000) AS BIGINT) AS b, sum(value) AS total, count(value) AS n FROM events GROUP BY 1, 2)
    SELECT event_type, strftime(make_timestamp(b * 432000000000), '%Y-%m-%d') AS window_start, round(total, 6) AS total, n AS observations FROM w WHERE make_timestamp((b + 1) * 432000000000) <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""",
)
def stream_tumbling_sums(t):
    out = finished(accumulate.tumbling_sums(events(t), ["event_type"], "ts", "value", "5 days", "2 days"), t, "windows")
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), F.round("total", 6).alias("total"), "observations")


@query("stream_idempotent_ingest", "SELECT strftime(ts, '%Y-%m-%d') AS run_id, 'area-' || user_id AS area_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def stream_idempotent_ingest(t):
    """Upsert of the stream by (day, area), applied twice: the second pass changes nothing."""
    base = f"{shared_dir(t.spark)}/streams/ingest-{uuid.uuid4().hex}"
    rows = lambda: events(t).select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.concat(F.lit("area-"), "user_id").alias("area_id"), "value", F.col("ts").alias("loaded_at"), "event_id"
    )
    for attempt in (1, 2):
        ingest.ingest(rows(), f"{base}/rows", f"{base}/state{attempt}", order=("loaded_at", "event_id")).awaitTermination()
    return t.spark.read.parquet(f"{base}/rows").select(F.col("run_id").cast("string").alias("run_id"), "area_id", "value")


# Which of four deliveries brings an event: eight days each, every fortieth event two deliveries late.
DELIVERY_SQL = """slots AS (SELECT *, least(CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 8 AS INTEGER), 3) AS slot FROM events),
delivered AS (SELECT *, CASE WHEN event_id % 40 = 0 THEN least(slot + 2, 3) ELSE slot END AS delivery FROM slots)"""


def deliveries(t, name):
    """The events as a stream of four deliveries, one batch each."""
    e, base = t.raw("events"), f"{shared_dir(t.spark)}/streams/{name}-{uuid.uuid4().hex}"
    slot = F.least(F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 8), F.lit(3))
    dealt = e.withColumn("delivery", F.when(F.col("event_id") % 40 == 0, F.least(slot + 2, F.lit(3))).otherwise(slot))
    for k in range(4):
        dealt.where(F.col("delivery") == k).drop("delivery").repartition(2).write.mode("append").parquet(base)  # two files, read by one batch
    return t.spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 2).parquet(base)


@query(
    "stream_daily_pentads",
    "WITH " + DELIVERY_SQL + """, marks AS (SELECT d.delivery, max(b.ts) - INTERVAL 2 DAY AS mark FROM (SELECT DISTINCT delivery FROM delivered) d LEFT JOIN delivered b ON b.delivery < d.delivery - 1 GROUP BY 1),
    kept AS (SELECT event_type, date_trunc('day', ts) AS day, value FROM delivered JOIN marks USING (delivery) WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark),
    placed AS (SELECT *, least((day(day) - 1) // 5 + 1, 6) AS p FROM kept),
    ended AS (SELECT *, CASE WHEN p < 6 THEN date_trunc('month', day) + to_days(CAST(5 * p AS INTEGER)) ELSE date_trunc('month', day) + INTERVAL 1 MONTH END AS until FROM placed)
    SELECT event_type, (year(day) * 12 + month(day) - 1) * 6 + p AS pentad_ordinal, round(sum(value), 6) AS total, CAST(count(value) AS BIGINT) AS observations, count(DISTINCT day) AS closed_days FROM ended
    WHERE until <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2""",
)
def stream_daily_pentads(t):
    """Whole calendar pentads over four deliveries, each once, when the watermark has passed its last day; rows of closed days that come late are dropped."""
    out = finished(accumulate.whole_pentads(deliveries(t, "pentads-in"), ["event_type"], "ts", "value", "2 days"), t, "pentads")
    return out.withColumn("total", F.round("total", 6))


@query(
    "stream_alerts",
    "WITH " + DELIVERY_SQL + """, marks AS (SELECT d.delivery, max(b.ts) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT delivery FROM delivered) d LEFT JOIN delivered b ON b.delivery < d.delivery - 1 GROUP BY 1),
    kept AS (SELECT DISTINCT user_id, ts, make_timestamp((epoch_us(ts) // 1000 + 86400000) * 1000) AS stale_after FROM delivered JOIN marks USING (delivery) WHERE (mark IS NULL OR ts > mark) AND ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
    seen AS (SELECT *, lag(stale_after) OVER w AS before, lead(ts) OVER w AS next FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT 'source-' || user_id AS source_key, 'current' AS state, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, strftime(ts, '%Y-%m-%d %H:%M:%S') AS observation_end FROM seen WHERE before IS NULL OR ts > before
    UNION ALL SELECT 'source-' || user_id, 'stale', strftime(stale_after, '%Y-%m-%d %H:%M:%S'), strftime(ts, '%Y-%m-%d %H:%M:%S') FROM seen WHERE (next IS NULL OR next > stale_after) AND stale_after <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_alerts(t):
    """Change-only alerts per source with a one-day stale limit, over four deliveries; late observations are dropped once the watermark of the batch before has passed them."""
    observed = deliveries(t, "alerts-in").select(F.concat(F.lit("source-"), F.col("user_id")).alias("source_key"), F.col("ts").alias("observation_end"))
    out = finished(alerts.alert_stream(observed, F.lit(1), "1 hour"), t, "alerts")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("source_key", "state", shown("at"), shown("observation_end"))


@query(
    "state_changes",
    """WITH c AS (SELECT user_id, ts, event_id, CASE WHEN value > 20 THEN 'stale' ELSE 'current' END AS state FROM events), p AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM c)
    SELECT user_id, event_id, state FROM p WHERE prev IS NULL OR prev <> state""",
)
def state_changes(t):
    """Batch twin of the alert: checks whose state differs from the one before."""
    checks = t.raw("events").withColumn("state", F.when(F.col("value") > 20, "stale").otherwise("current"))
    return alerts.state_changes(checks, ["user_id"], ["ts", "event_id"], "state", F.to_date("ts")).select("user_id", "event_id", "state")
