"""Splits, folds, metrics, preprocessing and models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidegauge.contract import UniversalSchema
from tidegauge.errors import CategoryLimitError, NotFittedError, SplitKeyError
from tidegauge.operators import evaluation, models, preprocessing, sampling
from tidegauge.sources import sinks


@pytest.fixture(scope="module")
def labelled(spark):
    """1,003 rows; one class holds more than two thirds."""
    label = F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c")
    return spark.range(1003).withColumnRenamed("id", "key").withColumn("id", F.col("key")).select("key", label.alias("label")).persist()


def sizes(df, *columns):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*columns).count().collect()}


def quotas_of(spark, totals, test_size=0.2):
    counts = spark.createDataFrame(list(totals.items()), "class string, rows long")
    return {r["class"]: r["quota"] for r in sampling.class_quotas(counts, test_size).collect()}


def test_quotas_follow_largest_remainder(spark):
    assert quotas_of(spark, {"a": 7, "b": 2, "c": 1}) == {"a": 2, "b": 0, "c": 0}
    assert quotas_of(spark, {"a": 70, "b": 20, "c": 11}) == {"a": 15, "b": 4, "c": 2}
    assert quotas_of(spark, {"a": 10**11 + 1, None: 10**11}) == {"a": 2 * 10**10 + 1, None: 2 * 10**10}


def test_exact_split(labelled):
    parts = sampling.stratified_split(labelled, "label", "key").persist()
    found = sizes(parts, "label", "part")
    totals = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    quotas = quotas_of(labelled.sparkSession, totals)
    assert {c: found[c, "test"] for c in quotas} == quotas
    assert sum(quotas.values()) == 201 and parts.count() == 1003
    assert sampling.stratified_split(labelled.repartition(7), "label", "key").exceptAll(parts).isEmpty()


def test_split_does_not_depend_on_the_buckets(labelled):
    whole = sampling.stratified_split(labelled, "label", "key")
    for bits in (0, 3, 30):
        assert sampling.stratified_split(labelled, "label", "key", bits=bits).exceptAll(whole).isEmpty()


def test_many_classes_and_clashing_columns(spark):
    rows = spark.range(6000).select(F.col("id").alias("class"), (F.col("id") % 2500).alias("cuts"), F.lit("x").alias("cuts_of_part"), F.lit(1).alias("key"))
    parts = sampling.stratified_split(rows, "cuts", "class")
    assert parts.columns == ["class", "cuts", "cuts_of_part", "key", "part"] and sizes(parts, "part") == {("test",): 1200, ("train",): 4800}
    folds = sizes(sampling.stratified_folds(rows, "cuts", "class", 2), "cuts", "fold")
    assert all(folds[k, 0] - folds.get((k, 1), 0) == (3 if k < 1000 else 2) % 2 for k in range(2500))


def test_splits_of_nothing(spark):
    empty = spark.createDataFrame([], "key long, label string")
    assert sampling.stratified_split(empty, "label", "key").count() == sampling.stratified_folds(empty, "label", "key").count() == 0


def test_folds_are_balanced(labelled):
    folds = sampling.stratified_folds(labelled, "label", "key").persist()
    by_class = sizes(folds, "label", "fold")
    for c in "abc":
        counts = [by_class[c, f] for f in range(5)]
        assert max(counts) - min(counts) <= 1
    tiny = sizes(sampling.stratified_folds(labelled.where("key in (0, 1, 9)"), "label", "key"), "label", "fold")
    assert tiny == {("a", 0): 1, ("a", 1): 1, ("c", 0): 1}


def test_repeated_keys_cannot_be_split(spark):
    same = spark.range(100).select(F.lit(1).alias("key"), F.lit("a").alias("label"))
    with pytest.raises(SplitKeyError):
        sampling.stratified_split(same, "label", "key")


def test_shared_hash_values_are_split_by_key(spark, monkeypatch):
    monkeypatch.setattr(sampling, "key_hash", lambda key, seed: (key % 2).cast("double"))
    parts = sampling.stratified_split(spark.range(100).withColumn("label", F.lit(0)), "label", "id", 0.3)
    chosen = sorted(r["id"] for r in parts.where("part = 'test'").collect())
    assert chosen == list(range(0, 60, 2))


def test_null_labels_are_a_class(spark):
    rows = spark.range(20).withColumn("label", F.when(F.col("id") < 10, 1))
    found = sizes(sampling.stratified_split(rows, "label", "id"), "label", "part")
    assert found[None, "test"] == found[1, "test"] == 2


def test_samples(labelled):
    first = sampling.fixed_sample(labelled, 10, "key")
    assert first.count() == 10 and first.exceptAll(sampling.fixed_sample(labelled.repartition(3), 10, "key")).isEmpty()
    share = sampling.fraction_sample(labelled, 0.5, "key").count()
    assert 400 < share < 600
    assert sampling.fraction_sample(labelled, 0.0).count() == 0


# --- metrics ---------------------------------------------------------------------------------------------------------


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, prediction int")


def test_metrics_identities(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 4, (300, 2))]
    counts = evaluation.confusion_counts(scored(spark, pairs))
    row = evaluation.summary_metrics(counts).first()
    right = sum(a == b for a, b in pairs) / 300
    assert row["accuracy"] == pytest.approx(right) and row["recall"] == pytest.approx(right) and row["rows"] == 300
    shares = evaluation.normalized_confusion(counts).groupBy("label").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in shares)


def test_empty_cells_and_denominators(spark):
    counts = evaluation.confusion_counts(scored(spark, [(0, 0), (0, 2), (1, 0)]))
    matrix = {(r["label"], r["prediction"]): r["n"] for r in evaluation.confusion_matrix(counts).collect()}
    assert len(matrix) == 9 and matrix[0, 2] == 1 and matrix[2, 2] == 0
    per_class = {r["class"]: r for r in evaluation.class_metrics(counts).collect()}
    assert per_class[1]["precision"] == 0.0 and per_class[2]["recall"] == 0.0
    assert evaluation.normalized_confusion(counts).where("label = 2").agg(F.max("share")).first()[0] == 0.0
    assert evaluation.binary_f1(counts).first()["f1"] == 0.0


def test_report_order(spark):
    lines = evaluation.classification_report(evaluation.confusion_counts(scored(spark, [(1, 1), (0, 1)]))).collect()
    assert [r["class"] for r in lines] == ["0", "1", "accuracy", "macro avg", "weighted avg"]
    assert lines[2]["f1"] == 0.5 and lines[3]["recall"] == 0.5


def test_balanced_weights(spark):
    rows = scored(spark, [(0, 0)] * 6 + [(1, 0)] * 2)
    weighted = evaluation.with_class_weights(rows, "label")
    assert {r["label"]: r["weight"] for r in weighted.collect()} == {0: 8 / 12, 1: 2.0}
    odd = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "label string, _class int")
    found = evaluation.with_class_weights(odd, "label")
    assert found.columns == ["label", "_class", "weight"] and {r["label"]: r["weight"] for r in found.collect()} == {None: 4 / 6, "a": 4 / 3, "b": 4 / 3}


def test_reports_and_grids_of_many_classes(spark):
    """1,500 classes in two runs, hand-counted."""
    rows = spark.range(6000).select((F.col("id") % 2).alias("run"), (F.col("id") % 1500).alias("label"), F.when(F.col("id") < 3000, F.col("id") % 1500).otherwise(0).alias("prediction"))
    counts = evaluation.confusion_counts(rows, by=["run"])
    grid = evaluation.confusion_matrix(counts, ["run"])
    assert grid.groupBy("run").agg(F.count("*").alias("cells"), F.sum("n").alias("rows")).orderBy("run").collect() == [(0, 750 * 750, 3000), (1, 751 * 751, 3000)]
    report = evaluation.classification_report(counts, ["run"]).collect()
    assert len(report) == 750 + 3 + 751 + 3 and [r["class"] for r in report[750:753]] == ["accuracy", "macro avg", "weighted avg"]
    assert report[750]["f1"] == pytest.approx((1500 + 2) / 3000) and report[750]["support"] == 3000
    assert evaluation.with_class_weights(rows, "label").select("weight").distinct().count() == 1


# --- preprocessing ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1.0, 5.0, "b"), (None, 5.0, "a"), (3.0, 5.0, None), (8.0, 5.0, "a"), (float("nan"), 5.0, "b")]
    return spark.createDataFrame(rows, "x double, same double, c string")


def test_fitted_state(gaps):
    model = preprocessing.FlowPreprocessor(["c"], ["x", "same"]).fit(gaps)
    filled = np.array([1, 3, 3, 8, 3], dtype=float)
    x, same = model.numbers
    assert (x.median, x.mean, x.scale) == (3.0, pytest.approx(filled.mean()), pytest.approx(filled.std()))
    assert same.scale == 1.0
    assert model.categories[0] == preprocessing.CategoryState("c", "a", ("a", "b"))  # the smaller of two equals
    assert model.feature_names == ["c_a", "c_b", "x", "same"]


def test_transform(spark, gaps):
    model = preprocessing.FlowPreprocessor.for_schema(UniversalSchema({"c": "category", "x": "float"})).fit(gaps)
    rows = [tuple(r) for r in model.transform(spark.createDataFrame([(3.6, "z"), (None, None)], "x double, c string")).collect()]
    scale = np.array([1, 3, 3, 8, 3]).std()
    assert rows[0][:2] == (0.0, 0.0) and rows[0][2] == pytest.approx(0.0)
    assert rows[1][:2] == (1.0, 0.0) and rows[1][2] == pytest.approx((3 - 3.6) / scale)
    with pytest.raises(NotFittedError):
        preprocessing.FlowPreprocessorModel().transform(gaps)


def test_state_round_trip(spark, gaps, tmp_path):
    model = preprocessing.FlowPreprocessor(["c"], ["x"], ["same"]).fit(gaps)
    model.save(str(tmp_path / "state"))
    loaded = preprocessing.FlowPreprocessorModel.load(str(tmp_path / "state"))
    assert (loaded.categories, loaded.numbers, loaded.keep, loaded.uid) == (model.categories, model.numbers, model.keep, model.uid)


def test_too_many_categories_for_columns(spark, monkeypatch):
    from pyspark.ml.functions import vector_to_array

    rows = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 != 1, F.col("id").cast("string")).alias("c"), F.lit(1.5).alias("x"))
    other = rows.union(spark.createDataFrame([(-1, "never seen", 0.0)], rows.schema))
    dense = {r["id"]: list(r["features"]) for r in preprocessing.FlowPreprocessor(["c"], ["x"], ["id"]).fit(rows).with_vector(other).select("id", vector_to_array("features").alias("features")).collect()}
    monkeypatch.setattr(preprocessing, "CATEGORY_LIMIT", 10)
    monkeypatch.setattr(preprocessing, "HEAVY", 5)  # the hot value only
    model = preprocessing.FlowPreprocessor(["c"], ["x"], ["id"]).fit(rows)
    with pytest.raises(CategoryLimitError):
        model.transform(rows)
    assert model.categories[0].mode == "hot" and model.imputed()
    found = model.with_vector(other)
    assert {r["id"]: list(r["features"]) for r in found.select("id", vector_to_array("features").alias("features")).collect()} == dense
    assert found.first()["features"].__class__.__name__ == "SparseVector" and sum(dense[-1][:-1]) == 0 and sum(dense[1][:-1]) == 1


def test_infinite_numbers_are_refused(spark):
    from tidegauge.errors import InfiniteValueError

    rows = spark.createDataFrame([(1.0,), (float("inf"),), (3.0,)], "x double")
    with pytest.raises(InfiniteValueError, match="1 infinite"):
        preprocessing.FlowPreprocessor([], ["x"]).fit(rows)
    with pytest.raises(Exception, match="infinite values"):
        preprocessing.FlowPreprocessor([], ["x"]).fit(rows.where("x < 5")).transform(rows).collect()
    lenient = preprocessing.FlowPreprocessor([], ["x"], infinite="missing").fit(rows)
    assert [r.x for r in lenient.transform(rows).collect()] == pytest.approx([-(1.5**0.5), 0.0, 1.5**0.5])


def test_preprocessor_and_model_are_saved_as_one(spark, tmp_path, monkeypatch):
    from pyspark.ml import Pipeline, PipelineModel

    monkeypatch.setattr(preprocessing, "CATEGORY_LIMIT", 3)
    rows = spark.range(200).select("id", (F.col("id") % 7).cast("string").alias("c"), (F.col("id") * 1.0).alias("x"), (F.col("id") % 7 > 3).cast("double").alias("label"))
    pipeline = Pipeline(stages=[preprocessing.FlowPreprocessor(["c"], ["x"], vector="features"), models.logistic_regression(200, 50)])
    pipeline.write().overwrite().save(str(tmp_path / "unfitted"))
    model = Pipeline.load(str(tmp_path / "unfitted")).fit(rows)
    model.write().overwrite().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    shown = ["id", "c", "x", "features", "prediction"]
    assert [tuple(r) for r in loaded.transform(rows.drop("label")).orderBy("id").select(*shown).collect()] == [tuple(r) for r in model.transform(rows).orderBy("id").select(*shown).collect()]
    assert model.transform(rows).where("prediction = label").count() == 200


def test_sparse_encoding_equals_columns(spark, gaps):
    from pyspark.ml.functions import vector_to_array

    known = gaps.where("c is not null")
    columns = preprocessing.FlowPreprocessor(["c"], []).fit(known)
    other = spark.createDataFrame([("b",), ("z",), ("a",)], "c string")
    dense = [tuple(r) for r in columns.transform(other).collect()]
    encoded = preprocessing.sparse_encoder(["c"]).fit(known).transform(other)
    assert [tuple(r[0]) for r in encoded.select(vector_to_array("c_encoded")).collect()] == dense


# --- models ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    label = (x[:, 0] + x[:, 1] > 0).astype(float)
    frame = pd.DataFrame({"key": np.arange(600), "a": x[:, 0], "b": x[:, 1], "noise": x[:, 2], "label": label})
    table = spark.createDataFrame(frame)
    return models.assemble(table, ["a", "b", "noise"], ["key", "label"]).persist()


def test_logistic_regression_solves_the_penalised_problem(separable):
    model = models.train(models.logistic_regression(600), separable)
    rows = separable.toPandas()
    x, y = np.stack([v.toArray() for v in rows["features"]]), rows["label"].to_numpy()
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-2  # gradient of summed loss + |w|^2 / 2
    assert abs((p - y).sum()) < 1e-2


@pytest.mark.parametrize(
    "preset", [lambda: models.random_forest(20, 6), lambda: models.boosted_trees(15), lambda: models.logistic_regression(600)],
    ids=["rf", "gbt", "lr"],
)
def test_models_learn_and_score(separable, preset):
    model = models.train(preset(), separable)
    f1, report = models.evaluate(model, separable)
    assert f1.first()["f1"] > 0.9 and report.count() == 5
    confidences = models.score(model, separable, ["key"]).agg(F.min("confidence"), F.max("confidence")).first()
    assert 0.5 <= confidences[0] <= confidences[1] <= 1


def test_presets(spark):
    forest, boosted = models.random_forest(), models.boosted_trees()
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed()) == (200, 15, 42)
    assert models.random_forest(depth=None).getMaxDepth() == 30
    assert (boosted.getMaxIter(), boosted.getStepSize(), boosted.getSubsamplingRate()) == (300, 0.05, 0.8)


def test_many_models_and_folds(spark, separable, tmp_path):
    chosen = {"lr": models.logistic_regression(600, 50), "rf": models.random_forest(5, 3)}
    fitted = models.train_many(chosen, separable, "flows", str(tmp_path))
    scored_rows = models.score_many(fitted, separable)
    assert sizes(scored_rows, "model") == {("lr",): 600, ("rf",): 600}
    loaded = sinks.load_model(spark, str(tmp_path / "flows_lr"))
    assert loaded.coefficients == fitted["lr"].coefficients
    folded = sampling.stratified_folds(separable, "label", "key", 3)
    predicted = models.cross_validate(chosen["lr"], folded)
    assert predicted.count() == 600
    summary = evaluation.cross_validation_summary(predicted, "label", "prediction").first()
    assert summary["accuracy_mean"] > 0.9 and summary["accuracy_std"] < 0.1


def test_balanced_training_uses_weights(separable):
    skewed = separable.where("label = 0 or key < 60")
    plain, balanced = (models.train(models.random_forest(10, 3), skewed, balanced=b) for b in (False, True))
    recall = [
        evaluation.class_metrics(evaluation.confusion_counts(models.score(m, skewed, ["label"]))).where("class = 1").first()["recall"]
        for m in (plain, balanced)
    ]
    assert recall[1] >= recall[0]


def test_null_classes_are_in_the_grid(spark):
    from tidegauge.operators import evaluation

    scored = spark.createDataFrame([("a", "a"), ("a", None), (None, "b"), (None, None)], "label string, prediction string")
    counts = evaluation.confusion_counts(scored)
    grid = evaluation.confusion_matrix(counts).collect()
    assert len(grid) == 9 and sum(r["n"] for r in grid) == 4


def test_null_split_keys_and_deep_trees_are_errors(spark):
    from tidegauge.errors import SplitKeyError
    from tidegauge.operators import models, sampling

    rows = spark.createDataFrame([(1, "a"), (None, "a")], "k long, label string")
    with pytest.raises(SplitKeyError):
        sampling.stratified_split(rows, "label", "k")
    with pytest.raises(SplitKeyError):
        sampling.stratified_folds(rows, "label", "k")
    with pytest.raises(ValueError, match="50"):
        models.random_forest(depth=50)


def test_large_keys_keep_their_place(spark):
    from tidegauge.operators import mapping

    rows = spark.createDataFrame([(2**53 + k,) for k in range(4)], "k long")
    assert [r.k - 2**53 for p in range(4) for r in mapping.row_at(rows, "k", p).collect()] == [0, 1, 2, 3]


def test_merged_files_of_other_types(spark, tmp_path):
    from pyspark.sql import types as T
    from tidegauge.sources import readers

    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.csv").write_text("x\n1.5\n")
    a, b = (str(tmp_path / n) for n in ("a.csv", "b.csv"))
    kinds = {a: T.StructType([T.StructField("x", T.IntegerType())]), b: T.StructType([T.StructField("x", T.DoubleType())])}
    assert sorted(r.x for r in readers.merge_csv(spark, [a, b], kinds).collect()) == [1.0, 1.5]
