"""Classifier presets, training, scoring and evaluation on MLlib."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import prod

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import SEED
from tidegauge.errors import UnsupportedModelError
from tidegauge.functions.columns import quoted
from tidegauge.operators.attribution import tree_nodes
from tidegauge.operators.evaluation import (
    binary_f1,
    classification_report,
    confidence,
    confusion_counts,
    summary_metrics,
    with_class_weights,
)
from tidegauge.operators.mapping import align_features
from tidegauge.session import broadcast_if_small, written

MAX_DEPTH = 30  # deepest tree MLlib grows
MAX_CLASSES = 100  # classes that MLlib tells apart
CELLS = 1 << 17  # cells between a forest's thresholds that are scored in place of rows
FOREST_MEMORY_MB = 1024  # for the statistics of a pass; more nodes of deep forests are split per pass


@dataclass(frozen=True)
class LabelDictionary:
    """Classes of a text label in order; their places are the numbers that models learn.

    NULL is no class: such rows have no number and teach nothing. Labels that were not seen have none either.
    """

    names: tuple[str, ...]

    @staticmethod
    def fit(df: DataFrame, label: str) -> LabelDictionary:
        values = df.select(quoted(label).cast("string").alias("name")).where("name is not null").distinct()
        names = sorted(r["name"] for r in values.limit(MAX_CLASSES + 1).collect())
        if len(names) > MAX_CLASSES:
            raise UnsupportedModelError(f"'{label}' has more than {MAX_CLASSES} classes, models tell no more apart")
        return LabelDictionary(tuple(names))

    def encode(self, label: Column) -> Column:
        place = F.array_position(self._names(), label.cast("string")) - 1
        return F.when(place >= 0, place.cast("double"))

    def decode(self, index: Column) -> Column:
        return F.get(self._names(), index.cast("int"))

    def _names(self) -> Column:
        return F.array(*map(F.lit, self.names)).cast("array<string>")

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.names)), "index int, label string")

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_df(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LabelDictionary:
        return LabelDictionary(tuple(r["label"] for r in spark.read.parquet(path).orderBy("index").collect()))


def logistic_regression(rows: int, max_iter: int = 500, label: str = "label") -> LogisticRegression:
    """L2 penalty of weight 1 on the summed loss, i.e. 1/rows on MLlib's mean loss, on features as they are."""
    return LogisticRegression(
        labelCol=label, maxIter=max_iter, regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False
    )


def random_forest(trees: int = 200, depth: int | None = 15, weight: str | None = None, label: str = "label") -> RandomForestClassifier:
    """Bagged trees; ``depth`` None grows as deep as MLlib allows, a larger one is an error."""
    if depth is not None and depth > MAX_DEPTH:
        raise ValueError(f"depth {depth} is above {MAX_DEPTH}, the deepest tree there is")
    forest = RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=MAX_DEPTH if depth is None else depth, seed=SEED, maxMemoryInMB=FOREST_MEMORY_MB
    )
    return forest.setWeightCol(weight) if weight else forest


def boosted_trees(rounds: int = 300, label: str = "label") -> GBTClassifier:
    """Boosted trees with row and column subsampling; depth 5 bounds a tree to 32 leaves. Binary labels only."""
    return GBTClassifier(
        labelCol=label,
        maxIter=rounds,
        stepSize=0.05,
        maxDepth=5,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.8",
        seed=SEED,
    )


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), vector: str = "features") -> DataFrame:
    """Kept columns and a vector of the features, in the given order. Missing values must be filled before."""
    aligned = align_features(df, features, keep)
    return VectorAssembler(inputCols=list(features), outputCol=vector).transform(aligned).select(*keep, vector)


def train(estimator: Estimator, table: DataFrame, label: str = "label", balanced: bool = False) -> Model:
    """Fit on (label, features); ``balanced`` weighs classes by the inverse of their size."""
    if balanced:
        table = with_class_weights(table, label, "class_weight")
        estimator = estimator.copy().setWeightCol("class_weight")
    return estimator.fit(table)


def score(model: Model, table: DataFrame, keep: Sequence[str] = (), by_cell: bool = False) -> DataFrame:
    """Kept columns with prediction, probabilities per class and confidence (the highest of them).

    ``by_cell`` scores one row for all that lie between the same thresholds of a forest, as they meet the same leaves.
    It reads the table twice; models with too many cells, and other models, score each row all the same.
    """
    cuts = split_cuts(model, table.sparkSession) if by_cell else None
    if not cuts:
        return _scored(model, table, keep)
    cell, rows = "__cell", "__x"
    names = [f"{rows}_{i}" for i in range(model.numFeatures)]
    place = F.lit(0).cast("long")
    for f, own in cuts.items():
        place = place * (len(own) + 1) + F.size(_below(own, F.get(rows, F.lit(f))))
    celled = table.withColumn(rows, vector_to_array("features")).withColumn(cell, place)
    firsts = celled.groupBy(cell).agg(*[F.first(F.get(rows, F.lit(i))).alias(n) for i, n in enumerate(names)])
    firsts = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(firsts)
    known = broadcast_if_small(written(_scored(model, firsts, [cell]), "scored-cells"), 64 + 8 * model.numClasses)
    return celled.select(*map(quoted, keep), cell).join(known, cell, "left").select(*map(quoted, keep), "prediction", "probability", "confidence")


def _below(cuts: Sequence[float], value: Column) -> Column:
    return F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < value)


def _scored(model: Model, table: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(table).select(
        *map(quoted, keep),
        "prediction",
        vector_to_array("probability").alias("probability"),
        confidence(F.col("probability")).alias("confidence"),
    )


def split_cuts(model: Model, spark: SparkSession) -> dict[int, list[float]] | None:
    """Ascending thresholds of a forest by feature; None for more than ``CELLS`` cells between them, and for other models."""
    if not isinstance(model, (RandomForestClassificationModel, DecisionTreeClassificationModel)):
        return None
    splits = tree_nodes(spark, model).where("left >= 0").select("feature", "categories", "threshold").distinct()
    found = splits.limit(CELLS + 1).collect()
    cuts: dict[int, list[float]] = {}
    for split in sorted(found, key=lambda s: (s["feature"], s["threshold"])):
        cuts.setdefault(split["feature"], []).append(split["threshold"])
    many = prod(len(own) + 1 for own in cuts.values()) > CELLS
    return None if many or any(s["categories"] > 0 for s in found) else cuts


def evaluate(model: Model, table: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(binary f1, classification report); both read the same confusion counts."""
    counts = confusion_counts(score(model, table, [label]), label)
    return binary_f1(counts, 1.0), classification_report(counts)


def train_many(estimators: Mapping[str, Estimator], table: DataFrame, dataset: str, folder: str | None = None) -> dict[str, Model]:
    """Fit several models on one cached table; with a folder each is saved as ``<dataset>_<name>``."""
    table = table.persist()
    try:
        models = {name: estimator.fit(table) for name, estimator in estimators.items()}
    finally:
        table.unpersist()
    if folder:
        for name, model in models.items():
            model.write().overwrite().save(f"{folder}/{dataset}_{name}")
    return models


def score_many(models: Mapping[str, Model], table: DataFrame, label: str = "label") -> DataFrame:
    """(model, label, prediction) of several models."""
    parts = [score(m, table, [label]).select(F.lit(n).alias("model"), label, "prediction") for n, m in models.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def evaluate_parts(model: Model, table: DataFrame, part: str = "part", label: str = "label") -> DataFrame:
    """(part, accuracy, precision, recall, f1, rows): which part of the split a record's metrics are of."""
    counts = confusion_counts(score(model, table, [part, label]), label, by=[part])
    return summary_metrics(counts, [part])


def cross_validate(estimator: Estimator, folded: DataFrame, label: str = "label", fold: str = "fold", jobs: int = 4) -> DataFrame:
    """(fold, label, prediction) of every row by the model that did not see its fold; persist the table before.

    A ``Pipeline`` with the preprocessor is fitted anew on each training part, so that nothing is learnt from the held-out
    fold. Folds are fitted ``jobs`` at a time.
    """
    folds = sorted(r[0] for r in folded.select(fold).distinct().collect())

    def held_out(number) -> DataFrame:
        model = estimator.copy().fit(folded.where(F.col(fold) != number))
        return model.transform(folded.where(F.col(fold) == number)).select(fold, label, "prediction")

    with ThreadPoolExecutor(jobs) as pool:
        parts = list(pool.map(inheritable_thread_target(held_out), folds))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
