"""PSI against a direct pandas computation, edge frames, and policy limits."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tidegauge.config import RAW_LIMITS
from tidegauge.operators import drift, policy


def plain_psi(expected, actual):
    """Independent formula: share of rows per right-closed quantile bin."""
    expected, actual = (np.asarray(v, dtype=float)[np.isfinite(np.asarray(v, dtype=float))] for v in (expected, actual))
    if len(np.unique(expected)) <= 1 or len(actual) == 0:
        return 0.0
    edges = np.unique(np.percentile(expected, np.linspace(0, 100, 11)))
    if len(edges) < 3:
        return 0.0

    def shares(values):
        bins = np.searchsorted(edges[1:-1], values, side="left")
        return np.bincount(bins, minlength=len(edges) - 1) / len(values)

    e, a = shares(expected), shares(actual)
    return float(np.sum((a - e) * np.log((a + 1e-8) / (e + 1e-8))))


def table(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def report(spark, expected, actual, **options):
    rows = drift.feature_drift(table(spark, **expected), table(spark, **actual), **options).collect()
    return {r["feature"]: r for r in rows}


RNG = np.random.default_rng(7)
CASES = {
    "shifted": (RNG.normal(size=500), RNG.normal(1, 1, 400)),
    "same": (np.arange(100.0), np.arange(100.0)),
    "constant": (np.full(50, 2.0), np.arange(50.0)),
    "two_valued": (np.repeat([0.0, 1.0], 50), np.repeat([0.0, 1.0], [90, 10])),
    "three_valued": (np.repeat([0.0, 1.0, 2.0], 40), np.repeat([0.0, 1.0, 2.0], [10, 10, 100])),
    "with_nan": (np.where(RNG.random(300) < 0.2, np.nan, RNG.normal(size=300)), RNG.normal(size=300)),
    "with_infinite": (np.append(RNG.normal(size=99), np.inf), np.append(RNG.normal(size=99), [-np.inf, np.inf])),
    "outside": (np.arange(100.0), np.arange(100.0) + 1000),
}


@pytest.mark.parametrize("case", CASES)
def test_psi_equals_plain_formula(spark, case):
    expected, actual = CASES[case]
    row = report(spark, {"v": expected}, {"v": actual})["v"]
    assert row["psi_raw"] == pytest.approx(plain_psi(expected, actual), abs=1e-12)
    assert (row["baseline_rows"], row["current_rows"]) == (len(expected), len(actual))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.integers(-50, 50), min_size=3, max_size=60),
    st.lists(st.integers(-60, 60), min_size=1, max_size=60),
)
def test_psi_properties(spark, expected, actual):
    e, a = np.array(expected, dtype=float), np.array(actual, dtype=float)
    rows = report(spark, {"v": e, "doubled": e * 2, "reversed": e[::-1]}, {"v": a, "doubled": a * 2, "reversed": a[::-1]})
    assert rows["v"]["psi_raw"] >= 0
    assert rows["v"]["psi_raw"] == pytest.approx(plain_psi(e, a), abs=1e-12)
    assert rows["doubled"]["psi_raw"] == rows["reversed"]["psi_raw"] == rows["v"]["psi_raw"]


def test_same_table_has_no_drift(spark):
    values = {"a": RNG.normal(size=200), "b": RNG.integers(0, 9, 200)}
    assert all(r["psi"] == 0.0 and r["status"] == "no_drift" for r in report(spark, values, values).values())


def test_text_boolean_and_empty_features(spark):
    baseline = spark.createDataFrame([("x", True, None, 1)] * 5 + [("y", False, None, 2)] * 5, "t string, b boolean, e double, n int")
    rows = {r["feature"]: r for r in drift.feature_drift(baseline, baseline.limit(0)).collect()}
    assert set(rows) == {"t", "b", "e", "n"}
    assert all(r["psi"] == 0.0 and r["current_rows"] == 0 and r["baseline_rows"] == 10 for r in rows.values())


def test_infinite_values_can_be_kept(spark):
    baseline = table(spark, v=np.append(np.arange(100.0), [np.inf] * 10))
    current = table(spark, v=np.append(np.arange(100.0), [np.inf] * 10 + [-np.inf] * 5))
    dropped, kept = drift.fit_profile(baseline), drift.fit_profile(baseline, keep_infinite=True)
    assert sum(dropped.features[0].bin_rows) == 100 and sum(kept.features[0].bin_rows) == 110
    row = drift.drift_report(current, kept).first()
    assert row["psi"] == 0.0 and row["current_rows"] == 115


def test_odd_column_names(spark):
    values = {"Flow Bytes/s": np.arange(50.0), " Fwd.Len": np.arange(50.0), "a`b": np.arange(50.0)}
    assert set(report(spark, values, values)) == set(values)


def test_many_features(spark):
    values = {f"f{i}": np.arange(30.0) * (i + 1) for i in range(90)}
    rows = report(spark, values, {n: v * 3 for n, v in values.items()})
    assert len(rows) == 90 and len({round(r["psi_raw"], 9) for r in rows.values()}) == 1


def test_plan_scans_once_and_prunes(spark, sf_dir):
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    counts = drift.bin_counts(lineitem, drift.fit_profile(lineitem, ["l_tax", "l_discount"]))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<l_discount:double,l_tax:double>" in plan


def test_profile_round_trip(spark, tmp_path):
    profile = drift.fit_profile(table(spark, a=RNG.normal(size=100), b=np.ones(100)))
    profile.save(spark, str(tmp_path / "profile"))
    assert drift.BaselineProfile.load(spark, str(tmp_path / "profile")) == profile


def test_perturbation(spark):
    frame = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    assert drift.perturb(frame).first() == (1.4, 2.8, 3 * 1.4, 4.0)
    scaled = drift.perturb_numeric(frame, 2).first()
    assert 2.5 <= scaled[0] <= 4 and scaled[2:] == (3.0, 4.0)
    assert drift.perturb_numeric(frame, 2).first() == scaled


# --- limits and verdicts -------------------------------------------------------------------------------------------


def made_report(spark, *psis):
    rows = [(f"f{i}", float(p), i) for i, p in enumerate(psis)]
    psi = spark.createDataFrame(rows, "feature string, psi_raw double, position int")
    return drift.report_from_psi(psi.withColumns({"baseline_rows": F.lit(1), "current_rows": F.lit(1)}))


def test_limits_are_strict_and_rounding_matters(spark):
    report = made_report(spark, 0.1, 0.10001, 0.25, 0.25003)
    status = {r["feature"]: r["status"] for r in report.collect()}
    assert status == {"f0": "no_drift", "f1": "moderate_drift", "f2": "moderate_drift", "f3": "severe_drift"}
    kinds = {r["feature"]: r["type"] for r in policy.policy_alerts(report, "d", "m").collect()}
    assert kinds == {"f2": "warning", "f3": "warning"}  # the policy sees the rounded value
    assert not policy.policy_decision(report, "m").first()["retrain_required"]


@pytest.mark.parametrize(
    "psis,level,health",
    [
        ([0.3] * 4 + [0.0] * 6, "high", "critical"),
        ([0.3] * 3 + [0.0] * 7, "medium", "degrading"),
        ([0.3] * 1 + [0.0] * 9, "low", "healthy"),
        ([0.2] * 4 + [0.0] * 6, "medium", "degrading"),
        ([0.2] * 3 + [0.0] * 7, "low", "healthy"),
    ],
)
def test_levels_and_health(spark, psis, level, health):
    report = made_report(spark, *psis)
    summary = policy.drift_summary(report).first()
    assert (summary["drift_level"], policy.model_health(report, "m").first()["status"]) == (level, health)
    assert summary["total_features"] == 10


def test_empty_report_is_an_error(spark):
    with pytest.raises(PySparkException, match="no features"):
        policy.drift_summary(made_report(spark, 0.3).limit(0)).collect()


def test_snapshot_lists_severe_features_in_column_order(spark):
    snapshot = drift.drift_snapshot(made_report(spark, 0.3, 0.1, 0.9), "d").first()
    assert (snapshot["features"], snapshot["psi"], snapshot["drift_level"]) == (["f0", "f2"], 0.9, "high")


def test_risk_index(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    assert value(policy.alert_index(F.lit("high"), F.lit(0.8))) == 0.72
    assert value(policy.combined_risk(F.lit("high"), F.lit(0.8), F.lit(0.6))) == 1.0
    assert [value(policy.risk_band(F.lit(x))) for x in (0.29, 0.3, 0.6)] == ["green", "orange", "red"]
    with pytest.raises(PySparkException, match="unknown drift level"):
        value(policy.alert_index(F.lit("huge"), F.lit(0.8)))
    assert math.isclose(RAW_LIMITS.high, 0.25)
