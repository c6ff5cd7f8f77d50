"""Sources, sinks, history and alerts. Written tables go to the session's shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidegauge.config import RAW_LIMITS
from tidegauge.functions.columns import drift_level, without_record_ids
from tidegauge.operators import alerts, drift, evaluation, explanation, models, policy
from tidegauge.operators.mapping import project_record
from tidegauge.operators.preprocessing import FlowPreprocessorModel
from tidegauge.operators.versioning import RunVersion
from tidegauge.session import scratch_path
from tidegauge.sources import history, readers, sinks
from workload import common as c
from workload.drift_queries import REPORT_SQL, listed
from workload.explain_queries import IMPACTS_SQL, explanations
from workload.scoring_queries import FOLDS_SQL, ORACLE as SCORING_ORACLE, RULES, RULES_SQL, _metrics_ctes, fitted, holed, order_parts

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


# --- CSV -------------------------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, o_orderstatus, o_totalprice, NULL::VARCHAR AS o_orderpriority FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, NULL::VARCHAR, NULL::DOUBLE, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'"""
)
def merge_csv_union(spark, sf_dir):
    """Two CSV sets with different headers become one table."""
    orders = c.table(spark, sf_dir, "orders")
    done = orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rest = orders.where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderpriority")
    paths = [scratch_path(spark, "csv") for _ in range(2)]
    for part, path in zip((done, rest), paths):
        part.write.option("header", True).csv(path)
    return readers.merge_csv(spark, paths, {paths[0]: done.schema, paths[1]: rest.schema})


NAMED = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


def _numbered_csv(spark, sf_dir):
    """Orders as data_<n>.csv tables without header, one per first digit of the priority (0: none), next to a file of column names."""
    folder = scratch_path(spark, "numbered")
    orders = c.table(spark, sf_dir, "orders").select(*NAMED)
    number = F.coalesce(F.substring("o_orderpriority", 1, 1).try_cast("int"), F.lit(0))
    for n in range(10):
        orders.where(number == n).write.csv(f"{folder}/data_{n}.csv")
    names = readers.small_names(spark, NAMED)
    names.coalesce(1).write.text(f"{folder}/data_names_fixed.csv")
    return folder


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def headerless_csv(spark, sf_dir):
    folder = _numbered_csv(spark, sf_dir)
    names = readers.column_names(spark, f"{folder}/data_names_fixed.csv")
    paths = [r["path"] for r in readers.numbered_files(spark, folder).collect()]
    return readers.read_headerless(spark, paths, names)


@query("SELECT coalesce(try_cast(substr(o_orderpriority, 1, 1) AS INTEGER), 0) AS number, count(*) AS rows FROM orders GROUP BY 1")
def numbered_files(spark, sf_dir):
    folder = _numbered_csv(spark, sf_dir)
    files = readers.numbered_files(spark, folder).collect()
    rows = readers.read_headerless(spark, [r["path"] for r in files], NAMED)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/data_(\d+)\.", 1).cast("int")
    return rows.groupBy(number.alias("number")).agg(F.count("*").alias("rows"))


# --- tables and models -----------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS rows, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1, 2")
def written_table(spark, sf_dir):
    """Orders written as a table partitioned by status, and read back."""
    path = scratch_path(spark, "table")
    sinks.write_table(c.table(spark, sf_dir, "orders"), path, ("o_orderstatus",))
    table = readers.read_parquet(spark, path).groupBy("o_orderstatus", "o_orderpriority")
    return table.agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("SELECT l_returnflag, count(*) AS rows, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1")
def compact_parts(spark, sf_dir):
    parts, whole = scratch_path(spark, "parts"), scratch_path(spark, "whole")
    sinks.write_parts(c.table(spark, sf_dir, "lineitem"), parts)
    sinks.compact(spark, parts, whole)
    table = spark.read.parquet(whole).groupBy("l_returnflag")
    return table.agg(F.count("*").alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT o_orderstatus, count(*) AS rows FROM orders GROUP BY 1")
def dataset_lookup(spark, sf_dir):
    catalog = readers.Catalog.parquet_folder(sf_dir, ["orders", "lineitem", "events"])
    return catalog.load(spark, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("rows"))


@query(f"WITH {c.RAW_DRIFT_SQL} {REPORT_SQL} WHERE feature <> 'l_returnflag'")
def profile_store(spark, sf_dir):
    """A saved baseline profile reports the same drift."""
    path = scratch_path(spark, "profile")
    c.lineitem_profile(spark, sf_dir).save(spark, path)
    return listed(drift.drift_report(c.lineitem_sides(spark, sf_dir)[1], drift.BaselineProfile.load(spark, path)))


@query(SCORING_ORACLE["feature_matrix"])
def preprocessor_store(spark, sf_dir):
    path = scratch_path(spark, "preprocessor")
    fitted(spark, sf_dir).save(path)
    matrix = FlowPreprocessorModel.load(path).transform(holed(spark, sf_dir))
    return matrix.select(*[(F.round(n, 6) + 0.0).alias(n) for n in matrix.columns])


@query("SELECT true AS same, count(*) AS rows FROM orders")
def model_store(spark, sf_dir):
    """A saved and loaded model agrees with the original on every order."""
    fit, _, vectors = order_parts(spark, sf_dir)
    model, path = models.train(models.random_forest(), fit), scratch_path(spark, "model")
    sinks.save_model(model, path)
    mine = model.transform(vectors).withColumnRenamed("prediction", "original").select("features", "original")
    both = sinks.load_model(spark, path).transform(mine)
    return both.groupBy((F.col("original") == F.col("prediction")).alias("same")).agg(F.count("*").alias("rows"))


# --- records ---------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_metrics_ctes("label", "prediction", f"({RULES_SQL})", "model")}
    SELECT 'orders' AS dataset, model, round(f1, 6) AS f1 FROM per_class WHERE class = 1"""
)
def metrics_log(spark, sf_dir):
    path, scored = scratch_path(spark, "metrics"), c.scored_orders(spark, sf_dir)
    for model, column in RULES.items():
        f1 = evaluation.binary_f1(evaluation.confusion_counts(scored, "label", column))
        sinks.append_metrics(f1, path, "orders", model)
    log = spark.read.schema("dataset string, model string, timestamp timestamp, f1 double").json(path)
    return log.select("dataset", "model", F.round("f1", 6).alias("f1"))


@query(
    f"""WITH {FOLDS_SQL}, {_metrics_ctes("label", "prediction", "folds", "fold")},
    cv AS (SELECT 'loose' AS model, avg(accuracy) AS accuracy_mean, stddev_pop(f1) AS f1_std FROM totals),
    test AS (SELECT 'loose' AS model, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM folds)
    SELECT 'orders' AS dataset, model, round(accuracy, 6) AS accuracy, round(accuracy_mean, 6) AS accuracy_mean,
           round(f1_std, 6) AS f1_std FROM test JOIN cv USING (model)"""
)
def metrics_payload(spark, sf_dir):
    from tidegauge.operators.sampling import stratified_folds

    path, scored = scratch_path(spark, "payload"), c.scored_orders(spark, sf_dir)
    folds = stratified_folds(scored, "label", "o_orderkey").withColumn("model", F.lit("loose"))
    summary = evaluation.cross_validation_summary(folds, "label", "prediction", by=["model"])
    compared = evaluation.compare_models(scored, "label", {"loose": "prediction"})
    sinks.write_payload(sinks.metrics_payload(compared, summary, "orders"), path)
    return spark.read.json(path).select(
        "dataset",
        "model",
        F.round("test_metrics.accuracy", 6).alias("accuracy"),
        F.round("cv_metrics.accuracy_mean", 6).alias("accuracy_mean"),
        F.round("cv_metrics.f1_std", 6).alias("f1_std"),
    )


@query(
    f"""SELECT 'explanation' AS event_type, 'ORDERS-' || o_orderkey AS alert_id, prediction::VARCHAR AS prediction,
    round(confidence, 4) AS confidence, '{c.NOON}' AS logged FROM ({c.ORDER_FEATURES_SQL})"""
)
def event_log(spark, sf_dir):
    path = scratch_path(spark, "events")
    payload = explanations(spark, sf_dir).select("alert_id", "prediction", "confidence")
    sinks.log_events(payload, "explanation", path, c.at_noon())
    schema = "timestamp timestamp, event_type string, payload struct<alert_id:string,prediction:string,confidence:double>"
    log = spark.read.schema(schema).json(path)
    return log.select("event_type", "payload.*", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("logged"))


@query(
    f"""WITH {IMPACTS_SQL} SELECT 'linear_20240101_120000_ORDERS-' || o_orderkey || '.json' AS artifact, 'orders' AS dataset,
    'local' AS scope, '20240101_120000' AS created_at, string_agg(feature, ',' ORDER BY rank) AS features FROM top GROUP BY o_orderkey"""
)
def artifact_store(spark, sf_dir):
    path = scratch_path(spark, "artifacts")
    rows = sinks.artifacts(explanations(spark, sf_dir), "orders", "local", "linear", c.at_noon(), F.col("alert_id"))
    sinks.write_artifacts(rows, path)
    stored = spark.read.json(path)
    names = F.array_join("top_contributors.feature", ",").alias("features")
    return stored.select("artifact", "dataset", "scope", F.col("_meta.created_at").alias("created_at"), names)


# --- history: events stand in for drift, health and alert records ------------------------------------------------------


def drift_records(spark, sf_dir):
    events = c.table(spark, sf_dir, "events")
    psi = F.col("value") / 100
    return events.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("dataset"),
        psi.alias("psi"),
        drift_level(psi, RAW_LIMITS).alias("drift_level"),
        F.array(F.col("user_id").cast("string")).alias("features"),
        F.col("event_id").alias("_id"),
    )


DRIFT_RECORDS_SQL = """SELECT ts AS timestamp, event_type AS dataset, value / 100 AS psi,
    CASE WHEN value / 100 > 0.25 THEN 'high' WHEN value / 100 > 0.1 THEN 'medium' ELSE 'low' END AS drift_level,
    user_id::VARCHAR AS features FROM events"""


def flat(rows):
    return rows.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        "dataset",
        "psi",
        "drift_level",
        F.array_join("features", ",").alias("features"),
    )


FLAT_SQL = "SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, dataset, psi, drift_level, features"


@query(f"{FLAT_SQL} FROM ({DRIFT_RECORDS_SQL} ORDER BY ts DESC LIMIT 20)")
def history_latest(spark, sf_dir):
    return flat(history.newest_first(drift_records(spark, sf_dir), history.TIES["drift"]))


@query(f"{FLAT_SQL} FROM ({DRIFT_RECORDS_SQL} ORDER BY ts DESC LIMIT 50)")
def history_store(spark, sf_dir):
    """Appended in two runs, read back newest first."""
    store = history.HistoryStore(spark, scratch_path(spark, "history"))
    records = drift_records(spark, sf_dir)
    for part in (F.col("psi") > 0.1, F.col("psi") <= 0.1):
        store.append("drift", records.where(part))
    return flat(store.latest("drift", 50))


@query(
    f"""SELECT count(*) AS count, string_agg(dataset, ',' ORDER BY timestamp DESC) AS datasets
    FROM ({DRIFT_RECORDS_SQL} ORDER BY ts DESC LIMIT 20)"""
)
def history_envelope(spark, sf_dir):
    body = history.envelope(history.newest_first(drift_records(spark, sf_dir), history.TIES["drift"]))
    return body.select("count", F.array_join(F.reverse(F.array_sort("data"))["dataset"], ",").alias("datasets"))


@query(DRIFT_RECORDS_SQL.replace("ts AS timestamp", "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp"))
def record_projection(spark, sf_dir):
    return flat(project_record(drift_records(spark, sf_dir), history.DRIFT_RECORD))


@query("SELECT event_id, user_id, event_type FROM events")
def strip_ids(spark, sf_dir):
    inner = F.struct("user_id", F.col("event_id").alias("_id"))
    nested = c.table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_id").alias("_id"),
        F.struct(F.array(inner).alias("items"), "event_type", F.lit("x").alias("_id")).alias("body"),
    )
    clean = without_record_ids(nested)
    assert '"_id"' not in clean.schema.json()
    return clean.select("event_id", F.col("body.items")[0]["user_id"].alias("user_id"), "body.event_type")


def state_events(spark, sf_dir):
    """One alert per user; purchases schedule a retraining."""
    state = F.when(F.col("event_type") == "purchase", history.RETRAINING).otherwise(F.col("event_type"))
    return c.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("alert_id"),
        state.alias("state"),
        F.col("ts").cast("timestamp").alias("updated_at"),
        F.col("event_id"),
    )


STATES_SQL = """states AS (SELECT user_id::VARCHAR AS alert_id, event_id, ts,
    CASE WHEN event_type = 'purchase' THEN 'retrain_scheduled' ELSE event_type END AS state FROM events),
    latest AS (SELECT alert_id, state, event_id FROM states QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY event_id DESC) = 1)"""


@query("""
SELECT user_id, day::VARCHAR AS day, event_type, event_id FROM (
  SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, event_type DESC, event_id DESC) AS place FROM events
) WHERE place = 1
""")
def latest_with_ties(spark, sf_dir):
    """The newest event of every user by day; ties are settled by the other columns."""
    events = c.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("day"), "event_type", "event_id")
    return alerts.latest_states(events, "user_id", "day")


@query(f"WITH {STATES_SQL} SELECT alert_id, state, event_id FROM latest")
def alert_latest_state(spark, sf_dir):
    return alerts.latest_states(state_events(spark, sf_dir), order="event_id").select("alert_id", "state", "event_id")


@query(f"WITH {STATES_SQL} SELECT alert_id, event_id FROM latest WHERE state = 'error'")
def alerts_by_state(spark, sf_dir):
    current = alerts.latest_states(state_events(spark, sf_dir), order="event_id")
    return alerts.alerts_in_state(current, "error").select("alert_id", "event_id")


@query(f"WITH {STATES_SQL} SELECT alert_id, event_id FROM states WHERE state = 'retrain_scheduled' ORDER BY ts DESC LIMIT 20")
def retraining_history(spark, sf_dir):
    records = state_events(spark, sf_dir).withColumnRenamed("updated_at", "created_at")
    return history.retraining(records).select("alert_id", "event_id")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS alert_id, o_orderstatus AS state FROM orders
    WHERE o_custkey NOT IN (SELECT user_id FROM events)"""
)
def unknown_alerts(spark, sf_dir):
    """State changes whose alert was never created (orders of customers without events)."""
    known = c.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("alert_id"))
    changes = c.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("alert_id"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("state")
    )
    return alerts.unknown_alerts(known, changes).select(F.col("key").alias("alert_id"), "state")


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS alert_id, o_orderstatus AS state, CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM orders
    WHERE o_custkey IN (SELECT user_id FROM events)"""
)
def state_changes(spark, sf_dir):
    """Changes of alerts that exist become events; orders of customers without events are left out."""
    known = c.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("alert_id"))
    changes = c.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("alert_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at")
    )
    return alerts.state_changes(known, changes, check=False)


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS healthy,
    CASE WHEN event_type = 'purchase' THEN 'Retrain Scheduled' ELSE event_type END AS reason FROM events"""
)
def health_timeline(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "view", "healthy").otherwise("critical")
    reason = F.nullif(kind, F.lit("purchase"))
    return c.table(spark, sf_dir, "events").select(
        "event_id", policy.health_flag(status).alias("healthy"), policy.retraining_reason(reason).alias("reason")
    )


@query(f"SELECT event_id, '{c.MODEL}' AS model_version, 'events_v1' AS dataset_version, '{c.RUN}' AS run_id, '{c.NOON}' AS timestamp FROM events")
def version_stamp(spark, sf_dir):
    return RunVersion(c.MODEL, "events_v1", c.RUN, c.NOON).stamp(c.table(spark, sf_dir, "events").select("event_id"))
