"""Sources, sinks, history, alerts, streaming."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidegauge.contract import Contract
from tidegauge.errors import DatasetNotFoundError, SchemaError, SharedFolderError, UnknownAlertError
from tidegauge.functions.columns import without_record_ids
from tidegauge.operators import alerts, drift
from tidegauge.operators.versioning import RunVersion
from tidegauge.plans.drift_run import run_drift
from tidegauge.session import scratch_path, shared_folder
from tidegauge.sources import history, readers, sinks
from tidegauge.streaming import alert_state, contract_load, window_drift


def test_merge_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    (tmp_path / "b.csv").write_text("y,z\nc,0.5\n")
    (tmp_path / "c.csv").write_text("x,y\n3,d\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")]
    rows = {tuple(r) for r in readers.merge_csv(spark, paths).collect()}
    assert rows == {(1, "a", None), (2, "b", None), (3, "d", None), (None, "c", 0.5)}
    with pytest.raises(DatasetNotFoundError):
        readers.merge_csv(spark, [])


def test_numbered_headerless_files(spark, tmp_path):
    folder = tmp_path / "names of raw files"  # "names" above the folder does not matter
    folder.mkdir()
    for number in (10, 2, 1):
        (folder / f"data_{number}.csv").write_text(f"{number},\n")
    (folder / "data_names_fixed.csv").write_text("first\nsecond\n")
    (folder / "data_3_Names.csv").write_text("x\n")
    (folder / "other.csv").write_text("x\n")
    files = readers.numbered_files(spark, str(folder)).collect()
    assert [r["number"] for r in files] == [1, 2, 10]
    names = readers.column_names(spark, str(folder / "data_names_fixed.csv"))
    table = readers.read_headerless(spark, [r["path"] for r in files], names)
    assert names == ["first", "second"]
    assert {tuple(r) for r in table.collect()} == {("1", None), ("2", None), ("10", None)}


def test_catalog(spark, sf_dir):
    catalog = readers.Catalog.parquet_folder(sf_dir, ["orders", "gone"])
    assert readers.shape(catalog.load(spark, "orders")) == (1500, 6)
    for name in ("gone", "unknown"):
        with pytest.raises(DatasetNotFoundError):
            catalog.load(spark, name)


def test_typed_csv_read(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert readers.read_csv(spark, str(tmp_path / "t.csv"), schema).first() == (1, "x")


def test_parts_and_compaction(spark, tmp_path):
    parts, whole = str(tmp_path / "parts"), str(tmp_path / "whole")
    sinks.write_parts(spark.range(1000).coalesce(1), parts, 100)
    assert readers.table_parts(spark.read.parquet(parts)).count() == 10
    assert sinks.compact(spark, parts, whole) == 1
    profile = readers.table_profile(spark.read.parquet(whole), "ids").first()
    assert (profile["parts"], profile["total_rows"], profile["column_names"]) == (1, 1000, "id")


def test_payload_replaces_only_its_dataset(spark, tmp_path):
    def payload(dataset, value):
        test = spark.createDataFrame([("m", value, value, value, value)], "model string, accuracy double, precision double, recall double, f1 double")
        folds = spark.createDataFrame([("m", 0.1, 0.2, 0.3, 0.4)], "model string, accuracy_mean double, accuracy_std double, f1_mean double, f1_std double")
        return sinks.metrics_payload(test, folds, dataset)

    path = str(tmp_path / "payload")
    for dataset, value in (("a", 0.5), ("b", 0.6), ("a", 0.7)):
        sinks.write_payload(payload(dataset, value), path)
    assert {(r["dataset"], r["test_metrics"]["f1"]) for r in spark.read.json(path).collect()} == {("a", 0.7), ("b", 0.6)}


def test_artifact_names(spark, tmp_path):
    rows = spark.createDataFrame([("A-1",)], "alert_id string")
    at = F.lit("2025-12-25 09:29:25").cast("timestamp")
    local = sinks.artifacts(rows, "flows", "local", "rf", at, F.col("alert_id"))
    assert local.first()["artifact"] == "rf_20251225_092925_A-1.json"
    assert sinks.artifacts(rows, "flows", "global", "rf", at).first()["artifact"] == "rf_20251225_092925.json"
    sinks.write_artifacts(local, str(tmp_path))
    stored = spark.read.json(str(tmp_path)).first()
    assert stored["_meta"]["scope"] == stored["scope"] == "local"


def test_event_log_lines(spark, tmp_path):
    sinks.log_events(spark.createDataFrame([(1, "x")], "a int, b string"), "explanation", str(tmp_path / "log"))
    line = json.loads(spark.read.text(str(tmp_path / "log")).first()[0])
    assert line["event_type"] == "explanation" and line["payload"] == {"a": 1, "b": "x"}


def test_history(spark, tmp_path):
    store = history.HistoryStore(spark, str(tmp_path))
    schema = "timestamp timestamp, dataset string, psi double, drift_level string, features array<string>, _id string"
    rows = [(datetime(2024, 1, d), "flows", d / 10, "low", ["a"], "id") for d in range(1, 31)]
    store.append("drift", spark.createDataFrame(rows[:15], schema))
    store.append("drift", spark.createDataFrame(rows[15:], schema))
    latest = [r["timestamp"].day for r in store.latest("drift").collect()]
    assert latest == list(range(30, 10, -1))
    body = history.envelope(store.latest("drift", 3)).first()
    assert body["count"] == 3 and [r["timestamp"].day for r in body["data"]] == [30, 29, 28]
    with pytest.raises(SchemaError, match="drift_level"):
        store.append("drift", spark.createDataFrame(rows, schema).drop("drift_level"))


def test_record_ids_are_stripped_everywhere(spark):
    rows = spark.sql(
        "select 1 _id, named_struct('_id', 2, 'x', array(named_struct('_id', 3, 'y', 4))) s, "
        "map('k', named_struct('_id', 5, 'z', 6), '_id', null) m, cast(null as struct<_id:int,q:int>) n"
    )
    clean = without_record_ids(rows)
    assert '"_id"' not in clean.schema.json()
    row = clean.first().asDict(True)
    assert row == {"s": {"x": [{"y": 4}]}, "m": {"k": {"z": 6}}, "n": None}


def test_alert_lifecycle(spark):
    payload = spark.createDataFrame([("critical", "f1", "flows"), ("warning", "f2", "flows")], "type string, feature string, dataset string")
    opened = alerts.create_alerts(payload, "run", F.lit("2024-01-01").cast("timestamp"))
    ids = {r["feature"]: r["alert_id"] for r in opened.collect()}
    assert ids == {r["feature"]: r["alert_id"] for r in alerts.create_alerts(payload, "run").collect()}
    changes = spark.createDataFrame(
        [(ids["f1"], "acknowledged", datetime(2024, 1, 2)), (ids["f1"], "resolved", datetime(2024, 1, 3))],
        "alert_id string, state string, updated_at timestamp",
    )
    events = opened.select("alert_id", "state", "updated_at").unionByName(alerts.state_changes(opened, changes))
    current = alerts.latest_states(events)
    assert {r["alert_id"]: r["state"] for r in current.collect()} == {ids["f1"]: "resolved", ids["f2"]: "open"}
    assert alerts.alerts_in_state(current, "open").count() == 1 and alerts.alerts_in_state(current).count() == 2
    stranger = changes.withColumn("alert_id", F.lit("nobody"))
    assert alerts.unknown_alerts(opened, stranger).count() == 2
    with pytest.raises(UnknownAlertError, match="nobody"):
        alerts.state_changes(opened, stranger)


def test_drift_run_is_recorded(spark, tmp_path):
    baseline = spark.range(1000).select((F.col("id") % 50).cast("double").alias("v"), F.rand(1).alias("w"))
    version = RunVersion("rf_v1", "flows_v1")
    run = run_drift(drift.perturb(baseline, cols=1, factor=3.0), drift.fit_profile(baseline), "flows", version, F.lit(0.9))
    store = history.HistoryStore(spark, str(tmp_path))
    run.record(store)
    outcome = run.outcome.first()
    assert (outcome["drift_level"], outcome["status"], outcome["retrain_required"]) == ("high", "critical", True)
    assert outcome["alert_index"] == 1.0 and outcome["risk_band"] == "red"
    assert store.read("alerts").first()["feature"] == "v" and store.read("performance").first()["action"] == "retrain_required"
    assert store.read("drift").first()["features"] == ["v"]
    run.report.unpersist()


def test_shared_folder_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == configured and scratch_path(spark, "x").startswith(configured)


def test_cluster_needs_a_shared_folder():
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "yarn", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(SharedFolderError):
        shared_folder(Cluster)


# --- streams ---------------------------------------------------------------------------------------------------------

CONTRACT = Contract("y", {"x": "flow_duration"}, {"ok": 0}, 0.3, numeric_features=("flow_duration",))


def test_stream_load_rejects_batch_by_batch(spark, tmp_path):
    source, accepted, rejected = (str(tmp_path / n) for n in ("in", "ok", "bad"))
    spark.createDataFrame([("1", "ok"), ("2", "no")], "x string, y string").coalesce(1).write.parquet(source)
    spark.createDataFrame([("a", "ok"), ("b", "no")], "x string, y string").coalesce(1).write.mode("append").parquet(source)
    contract = Contract("y", {"x": "flow_duration"}, {"ok": 0}, 0.1, numeric_features=("flow_duration",))
    stream = spark.readStream.schema("x string, y string").option("maxFilesPerTrigger", 1).parquet(source)
    contract_load.stream_flows(stream, contract, accepted, rejected, str(tmp_path / "progress")).awaitTermination()
    good, bad = spark.read.parquet(accepted), spark.read.parquet(rejected)
    assert sorted(r["flow_duration"] for r in good.collect()) == [1.0, 2.0]
    assert {r["reason"] for r in bad.collect()} == {"share of missing values is 0.20, above the contract's limit"} and bad.count() == 2


def test_stream_windows_equal_batch_on_closed_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    profile = drift.fit_profile(events, ["value", "user_id"])
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    target = str(tmp_path / "out")
    window_drift.stream_window_drift(stream, profile, "events", target, str(tmp_path / "progress"), "ts").awaitTermination()
    streamed = spark.read.parquet(target).drop("batch")
    batch = window_drift.window_snapshots(
        window_drift.window_report(window_drift.window_counts(events, profile, "ts"), profile), "events"
    )
    last = events.agg(F.max("ts")).first()[0]
    closed = batch.where(F.col("timestamp") <= F.lit(last).cast("timestamp") - F.expr("interval 1 hour"))
    assert streamed.count() == closed.count() == 29
    assert streamed.exceptAll(closed).isEmpty()


def test_stream_alert_state_over_restarts(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "alert_id string, state string, updated_at long"
    for rows in ([("a", "open", 1), ("b", "open", 1)], [("a", "resolved", 3), ("a", "acknowledged", 2)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        alert_state.stream_alert_state(stream, target, progress).awaitTermination()
    current = alerts.latest_states(spark.read.parquet(target).drop("batch"))
    assert {r["alert_id"]: r["state"] for r in current.collect()} == {"a": "resolved", "b": "open"}


def test_compaction_keeps_states_and_can_be_run_again(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "alert_id string, state string, updated_at long"
    batches = [[("a", "open", 1), ("b", "open", 1)], [("a", "resolved", 3), ("a", "acknowledged", 2)], [("c", "open", 4), ("b", "late", 0)]]
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        alert_state.stream_alert_state(stream, target, progress).awaitTermination()
        if number == 1:
            assert alert_state.compact_states(spark, target) == 2
            assert spark.read.parquet(target).count() == 2
    assert {r["alert_id"]: r["state"] for r in alert_state.current_states(spark, target).collect()} == {"a": "resolved", "b": "open", "c": "open"}
    assert alert_state.compact_states(spark, target) == 2 and alert_state.compact_states(spark, target) == 0  # the compacted batch and a new one
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(target).select("alert_id", "state").collect()) == [("a", "resolved"), ("b", "open"), ("c", "open")]


def test_folders_are_moved_once(spark, tmp_path):
    from tidegauge.session import move_folder

    old, new = str(tmp_path / "old"), str(tmp_path / "deep" / "new")
    spark.range(3).write.parquet(old)
    move_folder(spark, old, new)
    move_folder(spark, old, new)  # a retry after the move
    assert spark.read.parquet(new).count() == 3
    with pytest.raises(Exception):  # noqa: B017 - neither folder is there
        move_folder(spark, old, str(tmp_path / "other"))
