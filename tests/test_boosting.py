"""Leaf-wise boosting against a plain best-first booster over the same bins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidegauge.operators import boosting

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    frame = pd.DataFrame(rng.normal(size=(600, 3)).round(1), columns=FEATURES)
    frame["label"] = ((frame["a"] * frame["b"] > 0) ^ (rng.random(600) < 0.1)).astype(float)
    frame.insert(0, "key", np.arange(600))
    frame.loc[::50, "c"] = np.nan
    return spark.createDataFrame(frame).repartition(3).persist()


def by_hand(frame, preset):
    """Margins of a booster that looks at every threshold of every leaf, one split at a time."""
    x, y = frame[FEATURES].to_numpy(float), frame["label"].to_numpy()
    x = np.where(np.isnan(x), -np.inf, x)
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(preset.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        leaves = [np.arange(len(y))]
        score = lambda m: g[m].sum() ** 2 / h[m].sum()
        while len(leaves) < preset.leaves:
            options = []
            for number, m in enumerate(leaves):
                for f in range(3):
                    for cut in np.unique(x[m, f])[:-1]:
                        left, right = m[x[m, f] <= cut], m[x[m, f] > cut]
                        if min(len(left), len(right)) >= preset.min_rows:
                            options.append((score(left) + score(right) - score(m), number, left, right))
            if not options or max(o[0] for o in options) <= 1e-12:
                break
            _, number, left, right = max(options, key=lambda o: o[0])
            leaves[number : number + 1] = [left, right]
        for m in leaves:
            margin[m] -= preset.rate * g[m].sum() / h[m].sum()
    return margin


@pytest.mark.parametrize("rounds, rows_per_task", [(4, 600), (2, 200)])
def test_trees_equal_a_plain_best_first_booster(rows, rounds, rows_per_task):
    preset = boosting.Preset(rounds=rounds, leaves=7, rate=0.3, row_share=1.0, feature_share=1.0)
    model = boosting.fit(rows, FEATURES, "label", "key", preset, rows_per_task)
    found = model.score(rows, ["key"]).orderBy("key").toPandas()
    assert found["margin"].to_numpy() == pytest.approx(by_hand(rows.orderBy("key").toPandas(), preset), abs=1e-9)


def test_preset_grows_bounded_trees_and_learns(spark, rows, tmp_path):
    preset = boosting.Preset(rounds=60)
    model = boosting.fit(rows, FEATURES, "label", "key", preset)
    trees = model.nodes.groupBy("tree").agg(F.count_if(F.col("left") < 0).alias("leaves"), F.max("loss").alias("loss"), F.min("rows").alias("rows"), F.max("rows").alias("root")).orderBy("tree").toPandas()
    assert len(trees) == 60 and trees["leaves"].max() <= 31 and trees["rows"].min() >= 20
    assert 430 < trees["root"].min() and trees["root"].max() < 530 and trees["root"].nunique() > 5  # four fifths of the rows, drawn anew
    assert trees["loss"].iloc[-1] < 0.7 * trees["loss"].iloc[0]
    scored = model.score(rows, ["key", "label"])
    assert scored.where("prediction = label").count() > 500 and scored.agg(F.min("confidence")).first()[0] >= 0.5
    model.save(str(tmp_path / "model"))
    loaded = boosting.BoostedModel.load(spark, str(tmp_path / "model"))
    assert loaded.score(rows, ["key", "label"]).exceptAll(scored).isEmpty()


def test_constant_and_missing_features_and_labels(spark):
    rows = spark.createDataFrame([(i, 1.0, float("nan"), None if i % 5 == 0 else float(i % 2)) for i in range(100)], "key long, a double, b double, label double")
    model = boosting.fit(rows, ["a", "b"], "label", "key", boosting.Preset(rounds=2))
    assert model.nodes.where("left >= 0").isEmpty()
    assert model.score(rows).agg(F.countDistinct("margin")).first()[0] == 1
