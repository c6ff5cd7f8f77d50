"""Classifier metrics. The table is reduced to confusion counts once; everything else works on those few rows.

``by`` columns (fold, model, dataset) evaluate many runs in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import quoted, ratio
from tidegauge.session import broadcast_if_small, written

CLASS_BYTES = 200  # of a class and its weight, for the check before a broadcast
METRICS = ("accuracy", "precision", "recall", "f1")


def confusion_counts(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """(by, label, prediction, n) for the pairs that occur."""
    return scored.groupBy(*by, quoted(label).alias("label"), quoted(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All (label, prediction) cells, empty ones as 0; NULL is a class like any other."""
    part = lambda c: counts.select(*by, quoted(c).alias("class"))
    classes = part("label").union(part("prediction")).distinct()
    keys, names = [*by, "label", "prediction"], [f"_cell{i}" for i in range(len(by) + 2)]
    rows = classes.select(*[quoted(k).alias(n) for k, n in zip(by, names)], F.col("class").alias(names[-2]), F.lit(0).alias("_one"))
    others = classes.select(*[quoted(k).alias(f"{n}_") for k, n in zip(by, names)], F.col("class").alias(names[-1]), F.lit(0).alias("_other"))
    # the grid itself is the result; its rows are joined by the run, or by a constant where there is one run only
    run = F.col("_one") == F.col("_other")
    for n in names[: len(by)]:
        run &= F.col(n).eqNullSafe(F.col(f"{n}_"))
    grid = rows.join(others, run)
    same = [quoted(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    joined = grid.join(counts.select(*keys, "n"), same, "left")
    return joined.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def normalized_confusion(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix as shares of each true label; a label without rows has shares of 0."""
    labels = Window.partitionBy(*by, "label")
    return confusion_matrix(counts, by).withColumn("share", ratio(F.col("n"), F.sum("n").over(labels)))


def class_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, precision, recall, f1, support, hits) of every class; empty denominators give 0."""
    zero = F.lit(0).cast("bigint")
    hits = F.when(F.col("label").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(zero)
    roles = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hits.alias("hits")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")),
    )
    sums = (
        counts.select(*by, F.inline(roles))
        .groupBy(*by, "class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )
    return sums.select(
        *by,
        "class",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )


def _weighted(name: str) -> Column:
    return ratio(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(name)


def summary_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, accuracy, precision, recall, f1, rows); precision, recall and f1 weighted by support."""
    return (
        class_metrics(counts, by)
        .groupBy(*by)
        .agg(
            ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
            _weighted("precision"),
            _weighted("recall"),
            _weighted("f1"),
            F.sum("support").alias("rows"),
        )
    )


def binary_f1(counts: DataFrame, positive=1, by: Sequence[str] = ()) -> DataFrame:
    """(by, f1, tp, fp, fn) of the positive class."""
    truth, guess = F.col("label") == F.lit(positive), F.col("prediction") == F.lit(positive)
    zero = F.lit(0).cast("bigint")

    def rows(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(zero))

    tp, fp, fn = rows(truth & guess), rows(~truth & guess), rows(truth & ~guess)
    return counts.groupBy(*by).agg(
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")
    )


def classification_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, precision, recall, f1, support): one row per class, then accuracy, macro avg and weighted avg."""
    metrics = class_metrics(counts, by)
    totals = metrics.groupBy(*by).agg(
        F.sum("support").alias("rows"),
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.struct(*[F.avg(m).alias(m) for m in METRICS[1:]]).alias("macro"),
        F.struct(*[_weighted(m) for m in METRICS[1:]]).alias("weighted"),
    )
    none = F.lit(None).cast("double")

    def line(place: int, name: str, *values: Column) -> Column:
        shown = [v.alias(m) for v, m in zip(values, METRICS[1:])]
        return F.struct(F.lit(place).alias("_place"), F.lit(name).alias("class"), *shown, F.col("rows").alias("support"))

    lines = F.array(
        line(1, "accuracy", none, none, F.col("accuracy")),
        line(2, "macro avg", *[F.col(f"macro.{m}") for m in METRICS[1:]]),
        line(3, "weighted avg", *[F.col(f"weighted.{m}") for m in METRICS[1:]]),
    )
    named = metrics.select(*by, F.lit(0).alias("_place"), F.col("class").cast("string").alias("class"), *METRICS[1:], "support")
    return named.union(totals.select(*by, F.inline(lines))).orderBy(*by, "_place", "class").drop("_place")


def cross_validation_summary(scored: DataFrame, label: str, prediction: str, fold: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over the folds of accuracy and weighted f1."""
    per_fold = summary_metrics(confusion_counts(scored, label, prediction, [*by, fold]), [*by, fold])
    return per_fold.groupBy(*by).agg(
        F.avg("accuracy").alias("accuracy_mean"),
        F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("f1").alias("f1_mean"),
        F.stddev_pop("f1").alias("f1_std"),
    )


def compare_models(scored: DataFrame, label: str, predictions: dict[str, str]) -> DataFrame:
    """(model, accuracy, precision, recall, f1, rows) of several prediction columns, in one scan."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), quoted(c).alias("prediction")) for m, c in predictions.items()])
    stacked = scored.select(quoted(label).alias("label"), F.inline(rows))
    return summary_metrics(confusion_counts(stacked, by=["model"]), ["model"])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, rows, weight) with the balanced weight rows / (classes * rows of the class)."""
    sizes = df.groupBy(quoted(label).alias("label")).agg(F.count("*").alias("rows"))
    sizes = written(sizes, "class-sizes")
    total, classes = sizes.agg(F.sum("rows"), F.count("*")).first()
    return sizes.select("label", "rows", (F.lit(total) / (F.lit(classes) * F.col("rows"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Adds the balanced weight of each row's class, joined from a small table.

    Above the size of a broadcast classes are joined by a shuffle, in which Spark splits hot ones.
    """
    name = "_class"
    while name in df.columns:
        name += "_"
    weights = class_weights(df, label).select(F.col("label").alias(name), F.col("weight").alias(weight))
    return df.join(broadcast_if_small(weights, CLASS_BYTES), quoted(label).eqNullSafe(F.col(name))).drop(name)


def confidence(probability: Column) -> Column:
    """Highest class probability of a probability vector."""
    return F.array_max(vector_to_array(probability))
