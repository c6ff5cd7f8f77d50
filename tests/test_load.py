"""Contracts, mapping, coercion, validation."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from tidegauge.contract import FLOW_SCHEMA, Contract, UniversalSchema
from tidegauge.errors import ContractError, QualityError, SchemaError
from tidegauge.operators import mapping, quality
from tidegauge.plans.load import load_flows, to_flows

CONTRACT = Contract(
    label_column="Label",
    column_aliases={"dur": "flow_duration", "sbytes": "src_bytes", "proto": "protocol"},
    label_mapping={"BENIGN": 0, "DoS": 1},
    max_missing_pct=0.5,
    categorical_features=("protocol",),
    numeric_features=("flow_duration", "src_bytes", "dst_bytes"),
)


@pytest.fixture()
def raw(spark):
    rows = [("1.5", 10, "tcp", "BENIGN"), ("bad", None, None, "DoS"), (" 2e3 ", 30, "udp", None), ("1d", 40, "tcp", "New")]
    return spark.createDataFrame(rows, "dur string, sbytes int, proto string, Label string")


def test_flows(raw):
    rows = [tuple(r) for r in load_flows(raw, CONTRACT).collect()]
    assert rows == [
        (1.5, 10.0, 0.0, "tcp", 0.0),
        (None, None, 0.0, None, 1.0),
        (2000.0, 30.0, 0.0, "udp", 1.0),
        (None, 40.0, 0.0, "tcp", 1.0),
    ]


def test_logical_types_stay_in_the_schema(raw):
    fields = to_flows(raw, CONTRACT).schema.fields
    assert [f.metadata["logical_type"] for f in fields] == ["float", "int", "int", "category", "binary"]
    assert [f.name for f in fields] == FLOW_SCHEMA.struct().fieldNames()


@pytest.mark.parametrize(
    "text,number",
    [("12", 12.0), ("-.5", -0.5), ("1e-3", 0.001), ("inf", float("inf")), ("1f", None), ("", None), ("0x10", None), ("1_0", None)],
)
def test_coercion(spark, text, number):
    frame = spark.createDataFrame([(text,)], "v string")
    assert frame.select(mapping.to_number(F.col("v"), frame.schema["v"].dataType)).first()[0] == number


def test_numeric_labels_match_text_keys(spark):
    frame = spark.createDataFrame([(0,), (1,), (None,)], "Label int")
    mapped = mapping.map_columns(frame, Contract("Label", label_mapping={"0": 0, "1": 1}))
    assert [r["label"] for r in mapped.collect()] == [0, 1, 1]


def test_contract_errors(spark, raw):
    with pytest.raises(ContractError, match="has no column"):
        mapping.map_columns(raw.drop("Label"), CONTRACT)
    with pytest.raises(ContractError, match="benign"):
        mapping.map_columns(raw, replace(CONTRACT, label_mapping={"DoS": 1}))
    with pytest.raises(ContractError, match="same name"):
        mapping.map_columns(raw, replace(CONTRACT, column_aliases={"dur": "x", "sbytes": "x"}))
    with pytest.raises(SchemaError, match="label"):
        mapping.enforce_schema(raw.drop("Label"), FLOW_SCHEMA)


def test_last_benign_label_wins():
    assert Contract("l", label_mapping={"a": 0, "b": 1, "c": 0}).benign_label == "c"


def test_label_without_mapping_is_kept(raw):
    mapped = mapping.map_columns(raw, Contract("Label"))
    assert mapped.columns == ["dur", "sbytes", "proto", "label"]
    assert [r["label"] for r in mapped.collect()] == ["BENIGN", "DoS", None, "New"]


def test_strict_schema(spark):
    schema = UniversalSchema({"a": "float", "c": "category"}, "y")
    frame = spark.createDataFrame([(1.0, 0)], "a double, y int")
    assert mapping.validate_schema(frame, schema).first() == (1.0, "unknown")
    assert mapping.validate_schema(frame, schema, require_label=True).columns == ["a", "c", "y"]
    with pytest.raises(SchemaError, match=r"\['a'\]"):
        mapping.validate_schema(frame.drop("a"), schema)
    with pytest.raises(SchemaError, match="'y' is no column"):
        mapping.validate_schema(frame.drop("y"), schema, require_label=True)
    with pytest.raises(SchemaError, match="logical types"):
        UniversalSchema.from_dict({"features": {"a": "date"}, "label": {"name": "y"}})


def test_schema_and_contract_files(tmp_path):
    spec = {"schema_version": "v1", "features": dict(FLOW_SCHEMA.features), "label": {"name": "label", "type": "binary"}}
    (tmp_path / "schema.json").write_text(json.dumps(spec))
    assert UniversalSchema.from_file(str(tmp_path / "schema.json")) == FLOW_SCHEMA
    assert FLOW_SCHEMA.categories == ["protocol"] and len(FLOW_SCHEMA.numbers) == 3
    (tmp_path / "contract.json").write_text(json.dumps({"label_column": "Label", "label_values": [0, 1], "extra": 1}))
    assert Contract.from_file(str(tmp_path / "contract.json")) == Contract("Label")


def test_alignment(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "a int, b int, k int")
    assert mapping.align_features(frame, ["b", "a"], ["k"]).columns == ["k", "b", "a"]
    with pytest.raises(SchemaError, match="missing at scoring"):
        mapping.align_features(frame, ["z"])


def test_quality_errors(spark):
    flows = spark.createDataFrame(
        [(1.0, 0.0), (float("nan"), 2.0), (None, None)], "flow_duration double, label double"
    )
    contract = Contract("label", max_missing_pct=0.5, numeric_features=("flow_duration",))
    assert quality.missing_ratio(flows).first()["missing_ratio"] == pytest.approx(0.5)
    with pytest.raises(QualityError, match="outside the contract"):
        quality.validate(flows, contract)
    with pytest.raises(QualityError, match="missing values is 0.50"):
        quality.validate(flows, replace(contract, max_missing_pct=0.49, label_values=(0, 2, None)))
    assert quality.validate(flows, replace(contract, label_values=(0, 2, None))) is flows
    with pytest.raises(QualityError, match="needs columns"):
        quality.validate(flows, replace(contract, label_values=(0, 2, None), numeric_features=("gone",)))
    offenders = quality.label_violations(flows, contract).collect()
    assert {(r["label"], r["rows"]) for r in offenders} == {(2.0, 1), (None, 1)}


def test_empty_table_reports_rows(spark):
    flows = spark.createDataFrame([], "flow_duration double, label double")
    contract = Contract("label", numeric_features=("flow_duration",))
    checks = {r["check"]: r["passed"] for r in quality.quality_report(flows, contract).collect()}
    assert checks == {"rows": False, "missing": True, "labels": True, "columns": True}
    assert quality.failures(flows, contract, allow_empty=False) == ["the table is empty"]
