"""Streaming forms; every query drains the whole table with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators.drift import fit_profile
from tidegauge.session import scratch_path
from tidegauge.streaming import alert_state, contract_load, window_drift
from workload import common as c
from workload.load_queries import EVENTS_SQL
from workload.record_queries import STATES_SQL

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def event_stream(spark, sf_dir):
    schema = c.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(EVENTS_SQL)
def stream_contract_load(spark, sf_dir):
    accepted, rejected = scratch_path(spark, "accepted"), scratch_path(spark, "rejected")
    stream = contract_load.stream_flows(
        event_stream(spark, sf_dir), c.EVENTS_FLOWS, accepted, rejected, scratch_path(spark, "progress")
    )
    stream.awaitTermination()
    return spark.read.parquet(accepted).drop("batch")


FEATURES = {"value": ("value", "value"), "user_id": ("user_id", "user_id")}
EARLY_SQL = "SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'"
WINDOWS_SQL = f"""
closed AS (
  SELECT date_trunc('day', ts) AS day, * FROM events
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
),
{c.drift_ctes(EARLY_SQL, "SELECT * FROM closed", FEATURES)},
live AS (SELECT day, 'value' AS feature, value AS v FROM closed UNION ALL SELECT day, 'user_id', user_id::DOUBLE FROM closed),
day_bins AS (
  SELECT day, live.feature, len(list_filter(inner_edges, lambda q: q < v)) AS bin, count(*) AS n
  FROM live JOIN edges ON live.feature = edges.feature GROUP BY ALL
),
day_grid AS (SELECT day, counts.feature, counts.bin, expected_rows FROM counts, (SELECT DISTINCT day FROM closed)),
day_shares AS (
  SELECT g.day, g.feature, expected_rows / sum(expected_rows) OVER w AS e, coalesce(n, 0) / sum(coalesce(n, 0)) OVER w AS a
  FROM day_grid g LEFT JOIN day_bins b ON g.day = b.day AND g.feature = b.feature AND g.bin = b.bin
  WINDOW w AS (PARTITION BY g.day, g.feature)
),
day_psi AS (
  SELECT day, feature, sum((a - e) * ln((a + 1e-8) / (e + 1e-8))) AS psi_raw FROM day_shares GROUP BY day, feature
)"""


@query(
    f"""WITH {WINDOWS_SQL}
    SELECT strftime(day + INTERVAL 1 DAY, '%Y-%m-%d') AS closed_at, 'events' AS dataset, max(round(psi_raw, 4)) AS psi,
    CASE WHEN max(round(psi_raw, 4)) > 0.25 THEN 'high' WHEN max(round(psi_raw, 4)) > 0.1 THEN 'medium' ELSE 'low' END AS drift_level,
    coalesce(string_agg(feature, ',' ORDER BY CASE feature WHEN 'value' THEN 0 ELSE 1 END) FILTER (WHERE psi_raw > 0.25), '') AS features
    FROM day_psi GROUP BY day"""
)
def stream_window_drift(spark, sf_dir):
    events = c.table(spark, sf_dir, "events")
    early = events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    target = scratch_path(spark, "snapshots")
    stream = window_drift.stream_window_drift(
        event_stream(spark, sf_dir), fit_profile(early, list(FEATURES)), "events", target, scratch_path(spark, "progress"), "ts"
    )
    stream.awaitTermination()
    return spark.read.parquet(target).select(
        F.date_format("timestamp", "yyyy-MM-dd").alias("closed_at"),
        "dataset",
        "psi",
        "drift_level",
        F.array_join("features", ",").alias("features"),
    )


@query(f"WITH {STATES_SQL} SELECT alert_id, state, event_id FROM latest")
def stream_alert_state(spark, sf_dir):
    events = event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("alert_id"),
        F.when(F.col("event_type") == "purchase", "retrain_scheduled").otherwise(F.col("event_type")).alias("state"),
        "event_id",
    )
    target = scratch_path(spark, "states")
    stream = alert_state.stream_alert_state(events, target, scratch_path(spark, "progress"), order="event_id")
    stream.awaitTermination()
    return alert_state.current_states(spark, target, order="event_id").select("alert_id", "state", "event_id")


@query(f"WITH {STATES_SQL} SELECT alert_id, state, event_id FROM latest")
def stream_alert_state_compacted(spark, sf_dir):
    """Four micro-batches in two runs, with a compaction between them and another at the end."""
    events = c.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("alert_id"),
        F.when(F.col("event_type") == "purchase", "retrain_scheduled").otherwise(F.col("event_type")).alias("state"),
        "event_id",
    )
    source, target, progress = (scratch_path(spark, n) for n in ("events", "states", "progress"))
    for run in range(2):
        for part in range(2):
            events.where(F.pmod("event_id", F.lit(4)) == 2 * run + part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        alert_state.stream_alert_state(stream, target, progress, order="event_id").awaitTermination()
        alert_state.compact_states(spark, target, order="event_id")
    return spark.read.parquet(target).select("alert_id", "state", "event_id")


@query(
    """SELECT CASE WHEN event_id % 4 = 2 THEN 'rejected' ELSE 'accepted' END AS target, event_id % 4 = 2 AS with_reason, count(*) AS rows,
    count(CASE WHEN event_id % 4 <> 2 THEN value END) AS durations FROM events GROUP BY ALL"""
)
def stream_contract_batches(spark, sf_dir):
    """Four files, one micro-batch each; in one of them the durations are missing, so that it is rejected."""
    events, source = c.table(spark, sf_dir, "events"), scratch_path(spark, "events")
    for part in range(4):
        rows = events.where(F.pmod("event_id", F.lit(4)) == part)
        rows = rows.withColumn("value", F.lit(None).cast("double")) if part == 2 else rows
        rows.coalesce(1).write.mode("append").parquet(source)
    accepted, rejected = scratch_path(spark, "accepted"), scratch_path(spark, "rejected")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    contract_load.stream_flows(stream, c.EVENTS_FLOWS, accepted, rejected, scratch_path(spark, "progress")).awaitTermination()
    good = spark.read.parquet(accepted).select(F.lit("accepted").alias("target"), F.lit(False).alias("with_reason"), "flow_duration")
    bad = spark.read.parquet(rejected).select(F.lit("rejected").alias("target"), F.col("reason").contains("missing").alias("with_reason"), "flow_duration")
    return good.union(bad).groupBy("target", "with_reason").agg(F.count("*").alias("rows"), F.count("flow_duration").alias("durations"))
