"""Shapley values against enumeration, explanations, drift context."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F
from tidegauge.errors import UnsupportedModelError
from tidegauge.operators import attribution, explanation, models
from tidegauge.operators.versioning import RunVersion
from tidegauge.plans.explain_run import explain_rows, score_rows

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(rng.normal(size=(400, 4)), columns=FEATURES)
    frame["label"] = ((frame["a"] * frame["b"] > 0) | (frame["c"] > 1)).astype(float)
    frame.insert(0, "key", np.arange(400))
    return spark.createDataFrame(frame).repartition(3).persist()


@pytest.fixture(scope="module")
def forest(flows):
    return models.train(models.random_forest(3, 4), models.assemble(flows, FEATURES, ["label"]))


def expectation(nodes, row, known):
    """Path-dependent expected value of one tree when only some features are known."""

    def walk(i):
        node = nodes.loc[i]
        if node["left"] < 0:
            return node["stats"][1] / sum(node["stats"])
        if node["feature"] in known:
            return walk(node["left"] if row[node["feature"]] <= node["threshold"] else node["right"])
        total = sum(node["stats"])
        return sum(walk(node[s]) * sum(nodes.loc[node[s]]["stats"]) / total for s in ("left", "right"))

    return walk(0)


def enumerated(trees, row):
    n, result = len(row), np.zeros(len(row))
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            weight = factorial(size) * factorial(n - size - 1) / factorial(n)
            for known in combinations(others, size):
                for tree in trees:
                    gain = expectation(tree, row, {*known, i}) - expectation(tree, row, set(known))
                    result[i] += weight * gain / len(trees)
    return result


def test_tree_shapley_equals_enumeration(spark, flows, forest):
    nodes = attribution.tree_nodes(spark, forest).toPandas()
    trees = [t.set_index("id") for _, t in nodes.groupby("tree")]
    rows = flows.orderBy("key").limit(6).toPandas()[FEATURES].to_numpy()
    files = [f.removeprefix("file://") for f in attribution.leaf_table(spark, forest).leaves.inputFiles()]
    mine = sum(attribution.tree_shapley(rows, paths) for paths in attribution.leaf_blocks(files))
    for row, values in zip(rows, mine):
        assert values == pytest.approx(enumerated(trees, row), abs=1e-12)


def test_tree_shapley_adds_up_to_the_probability(flows, forest, monkeypatch):
    monkeypatch.setattr(attribution, "LEAVES_PER_FILE", 7)  # several files
    scored = models.score(forest, models.assemble(flows, FEATURES, ["key", *FEATURES]), ["key", *FEATURES])
    impacts, base = attribution.tree_attribution(scored, forest, FEATURES, ["key", "probability"])
    total = F.aggregate("impacts", F.lit(base), lambda t, i: t + i["impact"])
    assert impacts.select(F.max(F.abs(total - F.col("probability")[1]))).first()[0] < 1e-9
    assert impacts.count() == 400


def test_linear_shapley_adds_up(flows):
    model = models.train(models.logistic_regression(400, 50), models.assemble(flows, FEATURES, ["label"]))
    means = attribution.background_means(flows, FEATURES)
    weights = attribution.linear_weights(model, FEATURES)
    impacts = attribution.linear_attribution(flows, weights, means, ["key", *FEATURES])
    total = F.aggregate("impacts", F.lit(0.0), lambda t, i: t + i["impact"])
    direct = sum(F.lit(weights[f]) * (F.col(f) - means[f]) for f in FEATURES)
    assert impacts.select(F.max(F.abs(total - direct))).first()[0] < 1e-12


def test_unsupported_models(flows):
    boosted = GBTClassifier(maxIter=2).fit(models.assemble(flows, FEATURES, ["label"]))
    with pytest.raises(UnsupportedModelError):
        attribution.attribution(flows, boosted, FEATURES)


def test_small_blocks_and_slabs_give_the_same_impacts(spark, flows, forest, monkeypatch):
    files = [f.removeprefix("file://") for f in attribution.leaf_table(spark, forest).leaves.inputFiles()]
    rows = flows.toPandas()[FEATURES].to_numpy()
    whole = sum(attribution.tree_shapley(rows, paths) for paths in attribution.leaf_blocks(files))
    monkeypatch.setattr(attribution, "PATTERN_SLOTS", 0)  # row by row
    assert sum(attribution.tree_shapley(rows, paths) for paths in attribution.leaf_blocks(files)) == pytest.approx(whole, abs=1e-12)
    monkeypatch.setattr(attribution, "LEAVES_PER_BLOCK", 3)
    monkeypatch.setattr(attribution, "WORK_VALUES", 500)
    blocks = list(attribution.leaf_blocks(files))
    assert len(blocks) > 3
    assert sum(attribution.tree_shapley(rows, paths) for paths in blocks) == pytest.approx(whole, abs=1e-12)
    frames = [pd.DataFrame({"x": range(i, i + 4)}) for i in range(0, 20, 4)]
    assert [len(f) for f in attribution._slabs(iter(frames), 7)] == [8, 8, 4]


def test_tables_by_cell_equal_the_sum_by_leaf(spark, flows, forest, monkeypatch):
    table = attribution.leaf_table(spark, forest)
    files = [p.removeprefix("file:") for p in table.leaves.inputFiles()]
    cuts = attribution.thresholds(files)
    rows = np.random.default_rng(6).normal(size=(300, 4))
    for f, own in cuts.items():
        rows[: len(own), f] = own  # a row on a threshold passes it to the left
    for target in (0, 1):
        by_leaf = sum(attribution.tree_shapley(rows, paths, target) for paths in attribution.leaf_blocks(files))
        by_cell = np.zeros(rows.shape)
        by_cell[:, list(cuts)] = attribution.cell_impacts(files, cuts, target)[attribution.cells(rows, cuts)]
        assert by_cell == pytest.approx(by_leaf, abs=1e-12)
    monkeypatch.setattr(attribution, "GRID_VALUES", 10)
    assert attribution.thresholds(files) is None


def test_rows_of_a_cell_are_scored_once(spark, flows, forest, monkeypatch):
    rows = models.assemble(flows.unionByName(flows.withColumn("key", F.col("key") + 1000)), FEATURES, ["key", *FEATURES])
    asked, scored = [], models._scored
    monkeypatch.setattr(models, "_scored", lambda model, table, keep: asked.append(table.count()) or scored(model, table, keep))
    by_cell = {r["key"]: r for r in models.score(forest, rows, ["key"], by_cell=True).collect()}
    assert asked[0] <= 400 and len(by_cell) == 800
    assert by_cell == {r["key"]: r for r in models.score(forest, rows, ["key"]).collect()}
    monkeypatch.setattr(models, "CELLS", 3)
    assert by_cell == {r["key"]: r for r in models.score(forest, rows, ["key"], by_cell=True).collect()}
    assert asked[1:] == [800, 800]


def test_each_class_adds_up_to_its_probability(flows):
    """Three classes: impacts of the predicted class, for trees and for the linear model's margins."""
    kinds = flows.withColumn("label", F.when(F.col("a") > 0.5, 2.0).when(F.col("b") > 0, 1.0).otherwise(0.0))
    vectors = models.assemble(kinds, FEATURES, ["key", "label", *FEATURES])
    forest = models.train(models.random_forest(4, 5), vectors)
    scored = models.score(forest, vectors, ["key", *FEATURES])
    impacts, base = attribution.tree_attribution(scored, forest, FEATURES, ["key", "prediction", "probability"], target="prediction")
    index = F.col("prediction").cast("int")
    total = F.aggregate("impacts", F.get(F.array(*map(F.lit, base)), index), lambda t, i: t + i["impact"])
    assert len(base) == 3 and sum(base) == pytest.approx(1)
    assert impacts.select(F.max(F.abs(total - F.get("probability", index)))).first()[0] < 1e-9
    assert impacts.select("prediction").distinct().count() == 3
    linear = models.train(models.logistic_regression(400, 50), vectors)
    found = attribution.attribution(models.score(linear, vectors, ["key", *FEATURES]), linear, FEATURES, ["key", "prediction", *FEATURES], background=flows, target="prediction").toPandas()
    means, weights = flows.toPandas()[FEATURES].mean(), linear.coefficientMatrix.toArray()
    for row in found.head(20).itertuples():
        want = weights[int(row.prediction)] * (np.array([getattr(row, f) for f in FEATURES]) - means.to_numpy())
        assert [i["impact"] for i in row.impacts] == pytest.approx(list(want))


def impacts_table(spark, *values):
    items = [(n, float(v)) for n, v in zip("pqrstu", values)]
    return spark.createDataFrame([(items,)], "impacts array<struct<feature:string,impact:double>>")


def explain(table, top_k=5):
    return explanation.local_explanations(table, F.lit(1), F.lit(0.87654321), F.lit("X-1"), top_k).first()


def test_top_contributors(spark):
    row = explain(impacts_table(spark, 0.1, -0.3, 0.0, 0.3, -0.1, 0.05), 4)
    assert [c["feature"] for c in row["top_contributors"]] == ["q", "s", "p", "t"]  # equal ones in feature order
    assert [c["direction"] for c in row["top_contributors"]] == [
        "decrease_risk", "increase_risk", "increase_risk", "decrease_risk"
    ]
    assert (row["confidence"], row["prediction"], row["alert_id"]) == (0.8765, "1", "X-1")
    assert row["summary"] == (
        "High influence from s, p increased attack likelihood. Features like q, t reduced risk score."
    )


def test_zero_impacts(spark):
    row = explain(impacts_table(spark, 0.0, 0.0))
    assert row["summary"] == "." and {c["direction"] for c in row["top_contributors"]} == {"decrease_risk"}
    assert explain(impacts_table(spark, 0.5, 0.0))["summary"] == "High influence from p increased attack likelihood."
    assert explain(impacts_table(spark))["summary"] == "."


def test_drift_context(spark):
    explained = explanation.local_explanations(impacts_table(spark, 3, 2, 1), F.lit(1), F.lit(0.5))
    report = spark.createDataFrame([("q", "severe_drift"), ("p", "no_drift")], "feature string, status string")

    def context(report):
        return explanation.with_drift_context(explained, report).first()["drift_context"].asDict(True)

    found = context(report)
    assert found["drifting_features"] == [{"feature": "q", "impact": 2.0, "drift_status": "severe_drift"}]
    assert found["stable_features"] == ["p", "r"] and found["note"] == explanation.DRIFTING
    assert context(report.where("feature = 'p'"))["note"] == explanation.STABLE
    for nothing in (None, report.limit(0)):
        empty = context(nothing)
        assert empty == {"drifting_features": [], "stable_features": None, "note": explanation.NO_CONTEXT}


def test_global_importance_and_report(spark):
    table = impacts_table(spark, 1, -3, 2).union(impacts_table(spark, -1, 1, 2))
    top = [tuple(r) for r in explanation.global_importance(table, ["p", "q", "r"], 2).collect()]
    assert top == [("q", 2.0), ("r", 2.0)]
    report = explanation.policy_report(table, ["p", "q", "r"], "d", "m").first()
    assert [(e["feature"], e["mean_shap_impact"]) for e in report["top_global_features"]] == [("q", 2.0), ("r", 2.0), ("p", 1.0)]
    assert report["interpretation"].endswith("such as q, r, p")


def test_explain_run(spark, flows, forest, tmp_path):
    version = RunVersion("rf_v1", "flows_v1")
    report = spark.createDataFrame([(f, "severe_drift") for f in FEATURES], "feature string, status string")
    explained = explain_rows(flows, forest, FEATURES, "key", "flows", version, report, log_path=str(tmp_path / "log")).persist()
    assert explained.count() == 400
    row = explained.orderBy("key").first()
    scored = score_rows(flows, forest, FEATURES, "key").where("key = 0").first()
    assert (row["alert_id"], row["prediction"]) == ("FLOWS-0", str(scored["prediction"]))
    assert row["confidence"] == pytest.approx(scored["confidence"], abs=1e-4)
    assert row["metadata"]["run_id"] == version.run_id and row["drift_context"]["note"] == explanation.DRIFTING
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == 400 and set(log.columns) == {"timestamp", "event_type", "payload"}
