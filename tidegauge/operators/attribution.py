"""Shapley values of linear models and tree ensembles.

Linear models need one expression per feature. Trees use the path-dependent definition: the Shapley sum over feature
subsets of one leaf equals the integral over t of a product with one factor per feature on the leaf's path (Owen's
multilinear extension). The integrand is a polynomial, so a short Gauss-Legendre rule gives the exact value.

A forest is a table of leaf paths, derived from its nodes by tree in executors. Leaves add up independently, so workers
read the table block by block from the executor's own disk: neither the driver nor a worker holds the forest.

Rows between the same thresholds have the same impacts. MLlib chooses few thresholds for a feature (31 by default), so a
forest on few features has a table of impacts by cell, and each row looks its cell up. Other forests are summed by leaf.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from math import comb, prod

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.errors import UnsupportedModelError
from tidegauge.functions.columns import quoted
from tidegauge.session import scratch_path

LEAVES_PER_FILE = 200_000
LEAVES_PER_BLOCK = 10_000  # leaves that a worker holds at a time
SLAB_VALUES = 2_000_000  # feature values of the rows that meet the blocks together
WORK_VALUES = 1_000_000  # doubles per intermediate array in a task
PATTERN_SLOTS = 6  # slots of leaves that are evaluated once per pattern, 64 at most
GRID_FEATURES = 6  # features that a forest with a table by cell splits on
GRID_VALUES = 1 << 22  # doubles in these tables of a task: four features of 31 thresholds


# --- linear ----------------------------------------------------------------------------------------------------------


def background_means(background: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = background.agg(*[F.avg(quoted(f)).alias(str(i)) for i, f in enumerate(features)]).first()
    return {f: row[i] for i, f in enumerate(features)}


def linear_attribution(
    df: DataFrame,
    weights: Mapping[str, float | Sequence[float]],
    background: Mapping[str, float],
    keep: Sequence[str] = (),
    output: str = "impacts",
    target: str | None = None,
) -> DataFrame:
    """Adds an array (feature, impact) in feature order, impact = weight * (value - background mean).

    With a ``target`` column of class indexes, weights are lists by class and each row gets those of its class.
    """

    def weight(w) -> Column:
        return F.lit(float(w)) if target is None else F.get(F.array(*[F.lit(float(x)) for x in w]), quoted(target).cast("int"))

    terms = [
        F.struct(F.lit(f).alias("feature"), (weight(w) * (quoted(f).cast("double") - F.lit(background[f]))).alias("impact"))
        for f, w in weights.items()
    ]
    return df.select(*map(quoted, keep), F.array(*terms).alias(output))


def linear_weights(model: LogisticRegressionModel, features: Sequence[str]) -> dict[str, float]:
    """Weights of the positive class of a binary model."""
    return dict(zip(features, map(float, model.coefficients)))


def linear_class_weights(model: LogisticRegressionModel, features: Sequence[str]) -> dict[str, list[float]]:
    """Weights by class; those of a binary model are half the positive class's, with both signs."""
    rows = model.coefficientMatrix.toArray()
    if len(rows) == 1:
        rows = np.concatenate([-rows / 2, rows / 2])
    return {f: [float(x) for x in rows[:, i]] for i, f in enumerate(features)}


# --- trees -----------------------------------------------------------------------------------------------------------

LEAF_SCHEMA = "tree int, feature array<int>, low array<double>, high array<double>, share array<double>, value array<double>"


@dataclass(frozen=True)
class LeafPaths:
    """Root-to-leaf paths, padded with neutral slots.

    A slot is one distinct feature on the path: the row passes it when low < value <= high (low is NaN when there is no
    lower bound), and ``share`` is the fraction of training rows that follow the path at the feature's splits. ``value``
    (leaves x classes) holds the class shares in the leaf, divided by the number of trees.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> LeafPaths:
        """Leaves as stored: one list of slots per leaf."""
        lists = {name: batch.column(name) for name in ("feature", "low", "high", "share", "value")}
        lengths = np.diff(lists["feature"].offsets.to_numpy())
        width = max(1, int(lengths.max()))
        here = np.arange(width) < lengths[:, None]

        def padded(name: str, empty, dtype) -> np.ndarray:
            table = np.full((len(lengths), width), empty, dtype)
            table[here] = lists[name].flatten().to_numpy(zero_copy_only=False)
            return table

        values = lists["value"].flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1)
        return LeafPaths(padded("feature", 0, np.int32), padded("low", np.nan, float), padded("high", np.inf, float), padded("share", 1.0, float), values)


@dataclass(frozen=True)
class LeafTable:
    """Written leaf paths of a model, its expected value by class, and the files that executors fetch."""

    leaves: DataFrame
    base: tuple[float, ...]

    def files(self) -> list[str]:
        """Names of the table's files, registered so that each executor fetches them once to its own disk."""
        paths = self.leaves.inputFiles()
        for path in paths:
            self.leaves.sparkSession.sparkContext.addFile(path)
        return [path.rsplit("/", 1)[-1] for path in paths]


def tree_nodes(spark: SparkSession, model: Model) -> DataFrame:
    """Node table of a tree model: tree, id, left, right, feature, categories, threshold, class counts."""
    path = scratch_path(spark, "tree-nodes")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    node = "nodeData." if "nodeData" in data.columns else ""
    tree = F.col("treeID") if "treeID" in data.columns else F.lit(0)
    return data.select(
        tree.alias("tree"),
        F.col(f"{node}id").alias("id"),
        F.col(f"{node}leftChild").alias("left"),
        F.col(f"{node}rightChild").alias("right"),
        F.col(f"{node}split.featureIndex").alias("feature"),
        F.col(f"{node}split.numCategories").alias("categories"),
        F.get(F.col(f"{node}split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
        F.col(f"{node}impurityStats").alias("stats"),
    )


def leaf_table(spark: SparkSession, model: Model) -> LeafTable:
    """Leaf paths of all trees, each tree walked in one task and the leaves written in files of bounded size."""
    nodes = tree_nodes(spark, model)
    if not nodes.where("categories > 0").isEmpty():
        raise UnsupportedModelError("attribution of trees with categorical splits is not supported")
    trees = model.getNumTrees if hasattr(model, "getNumTrees") else 1

    def walk(tree: pd.DataFrame) -> pd.DataFrame:
        return tree_leaves(tree, trees)

    path = scratch_path(spark, "leaf-paths")
    nodes.groupBy("tree").applyInPandas(walk, LEAF_SCHEMA).write.option("maxRecordsPerFile", LEAVES_PER_FILE).parquet(path)
    leaves = spark.read.schema(LEAF_SCHEMA).parquet(path)
    reached = F.aggregate("share", F.lit(1.0), lambda product, share: product * share)
    base = leaves.agg(*[F.sum(reached * F.get("value", F.lit(k))) for k in range(model.numClasses)]).first()
    return LeafTable(leaves, tuple(base))


def tree_leaves(tree: pd.DataFrame, trees: int) -> pd.DataFrame:
    """Rows of ``LEAF_SCHEMA`` for one tree's nodes; leaf values are the class shares, divided by the number of trees."""
    tree = tree.set_index("id")
    stats = {i: np.asarray(s, dtype=float) for i, s in tree["stats"].items()}
    size = {i: s.sum() for i, s in stats.items()}
    left, right = tree["left"].to_dict(), tree["right"].to_dict()
    feature, threshold = tree["feature"].to_dict(), tree["threshold"].to_dict()
    leaves, pending = [], [(0, {})]
    while pending:
        node, slots = pending.pop()
        if left[node] < 0:
            low, high, share = zip(*slots.values()) if slots else ((), (), ())
            leaves.append((int(tree["tree"].iat[0]), list(slots), list(low), list(high), list(share), list(stats[node] / size[node] / trees)))
            continue
        low, high, share = slots.get(feature[node], (np.nan, np.inf, 1.0))
        cut = threshold[node]
        for child, bounds in ((left[node], (low, min(high, cut))), (right[node], (np.fmax(low, cut), high))):
            pending.append((child, {**slots, feature[node]: (*bounds, share * size[child] / size[node])}))
    return pd.DataFrame(leaves, columns=["tree", "feature", "low", "high", "share", "value"])


def leaf_blocks(paths: Sequence[str]) -> Iterator[LeafPaths]:
    """The leaves of local files, a bounded number at a time."""
    for path in paths:
        with pq.ParquetFile(path) as file:
            for batch in file.iter_batches(LEAVES_PER_BLOCK):
                yield LeafPaths.of(batch)


def tree_shapley(rows: np.ndarray, paths: LeafPaths, target: int = 1) -> np.ndarray:
    """Shapley values (rows x features) of some leaves for one class.

    A leaf treats rows alike that pass the same slots. Narrow leaves are evaluated once per pattern of passed slots, and
    rows look their pattern up; wide ones are evaluated for each row.
    """
    result = np.zeros(rows.shape)
    leaves, width = paths.feature.shape
    columns = np.ascontiguousarray(rows.T)
    step = max(1, WORK_VALUES // (leaves * width))
    if width <= PATTERN_SLOTS:
        patterns = (np.arange(2**width) >> np.arange(width)[:, None]) & 1 == 1
        terms = _terms(paths, np.broadcast_to(patterns, (leaves, *patterns.shape)), target)
        used = np.unique(paths.feature)
        # by feature: what a leaf gives to it under each pattern
        table = np.stack([np.where((paths.feature == f)[:, :, None], terms, 0.0).sum(axis=1) for f in used])
        first = np.arange(leaves)[:, None] * 2**width
        for begin in range(0, len(rows), step):
            code = np.zeros((leaves, min(step, len(rows) - begin)), np.int64)
            for slot in range(width):
                x = columns[:, begin : begin + step][paths.feature[:, slot]]
                code |= (~(x <= paths.low[:, slot, None]) & (x <= paths.high[:, slot, None])).astype(np.int64) << slot
            code += first
            for f, gives in zip(used, table):
                result[begin : begin + step, f] += gives.ravel()[code].sum(axis=0)
        return result
    for begin in range(0, len(rows), step):
        x = columns[:, begin : begin + step][paths.feature]
        terms = _terms(paths, ~(x <= paths.low[:, :, None]) & (x <= paths.high[:, :, None]), target)
        for index in np.unique(paths.feature):
            result[begin : begin + step, index] += terms[paths.feature == index].sum(axis=0)
    return result


def _terms(paths: LeafPaths, passed: np.ndarray, target: int) -> np.ndarray:
    """What each slot of each leaf gives its feature, for columns of passed slots (leaves x slots x columns).

    At a point t of the rule a passed slot contributes the factor share * (1 - t) + t, a failed one share * (1 - t).
    Logarithms turn the product over the slots of a leaf into a matrix product with the passed slots.
    """
    points, weights = np.polynomial.legendre.leggauss((paths.feature.shape[1] + 1) // 2)
    points, weights = (points + 1) / 2, weights / 2
    failed = paths.share[:, :, None] * (1 - points)
    gain = (np.log(failed + points) - np.log(failed)).transpose(0, 2, 1)
    start = np.log(failed).sum(axis=1) + np.log(weights)
    value = paths.value[:, target, None, None]
    if_passed = value * (1 - paths.share[:, :, None]) / (failed + points)
    if_failed = -value * paths.share[:, :, None] / failed
    product = np.exp(start[:, :, None] + gain @ passed.astype(float))
    return np.where(passed, if_passed @ product, if_failed @ product)


def thresholds(paths: Sequence[str], classes: int = 1) -> dict[int, np.ndarray] | None:
    """Ascending thresholds by feature; None if the leaves need too large a table by cell, or have no split."""
    cuts: dict[int, np.ndarray] = {}
    for block in leaf_blocks(paths):
        for bound, given in ((block.low, ~np.isnan(block.low)), (block.high, block.high < np.inf)):
            for f in np.unique(block.feature[given]).tolist():
                cuts[f] = np.union1d(cuts.get(f, np.empty(0)), bound[given & (block.feature == f)])
        values = prod(len(c) + 1 for c in cuts.values()) * len(cuts) * classes
        if len(cuts) > GRID_FEATURES or values > GRID_VALUES:
            return None
    return dict(sorted(cuts.items())) or None


def cell_impacts(paths: Sequence[str], cuts: Mapping[int, np.ndarray], target: int = 1) -> np.ndarray:
    """Shapley values (cells x split features) for one class, cells in the order of ``cells``.

    With some features known, a leaf counts in a box of the cells of these features. The boxes of all leaves are summed
    from their corners, and the impacts follow from the sums of all sets of features.
    """
    sizes, count = [len(c) + 1 for c in cuts.values()], len(cuts)
    members = [[k for k in range(count) if known >> k & 1] for known in range(2**count)]
    expected = [np.zeros([n + 1 if k in own else 1 for k, n in enumerate(sizes)]) for own in members]
    for block in leaf_blocks(paths):
        leaves = len(block.value)
        first, end, share = np.zeros((count, leaves), int), np.tile(np.array(sizes)[:, None], leaves), np.ones((count, leaves))
        for k, (f, own) in enumerate(cuts.items()):
            leaf, slot = np.nonzero((block.feature == f) & (~np.isnan(block.low) | (block.high < np.inf)))
            low, high = block.low[leaf, slot], block.high[leaf, slot]
            first[k, leaf] = np.where(np.isnan(low), 0, np.searchsorted(own, low) + 1)
            end[k, leaf] = np.maximum(first[k, leaf], np.searchsorted(own, high) + 1)
            share[k, leaf] = block.share[leaf, slot]
        for own, table in zip(members, expected):
            others = [k for k in range(count) if k not in own]
            weight = block.value[:, target] * share[others].prod(axis=0)
            steps = np.array(table.strides) // table.itemsize
            for corner in range(2 ** len(own)):
                ends = [corner >> j & 1 for j in range(len(own))]
                at = sum(((end if e else first)[k] * steps[k] for k, e in zip(own, ends)), np.zeros(leaves, int))
                np.add.at(table.reshape(-1), at, weight * (-1) ** sum(ends))
    for known, own in enumerate(members):
        for k in own:
            expected[known] = np.cumsum(expected[known], axis=k).take(range(sizes[k]), axis=k)
    impact = np.zeros((count, *sizes))
    for known, own in enumerate(members):
        for k in set(range(count)).difference(own):
            impact[k] += (expected[known | 1 << k] - expected[known]) / (count * comb(count - 1, len(own)))
    return np.ascontiguousarray(impact.reshape(count, -1).T)


def cells(rows: np.ndarray, cuts: Mapping[int, np.ndarray]) -> np.ndarray:
    """The cell of each row: by feature, how many thresholds its value is above."""
    found = np.zeros(len(rows), np.int64)
    for f, own in cuts.items():
        found *= len(own) + 1
        found += np.searchsorted(own, rows[:, f])
    return found


def _slabs(batches: Iterator, rows: int, joined=partial(pd.concat, ignore_index=True)) -> Iterator:
    """The batches joined to batches of about ``rows`` rows, so that a block is read once for many rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= rows:
            yield joined(held)
            held, size = [], 0
    if size:
        yield joined(held)


def tree_attribution(
    df: DataFrame,
    model: Model,
    features: Sequence[str],
    keep: Sequence[str] = (),
    positive: int = 1,
    output: str = "impacts",
    target: str | None = None,
) -> tuple[DataFrame, float | tuple[float, ...]]:
    """(kept columns with an array (feature, impact), base value). Impacts and base add up to the model's probability.

    Explained is the class ``positive``, or the class index in the column ``target``; the base values of all classes are
    returned then. Rows stay where they are and meet the forest a block of leaves at a time.
    """
    table = leaf_table(df.sparkSession, model)
    files, table_base = table.files(), table.base
    names, kept = list(features), list(keep)
    inputs = [f"x{i}" for i in range(len(names))]
    rows_at_once = max(1, SLAB_VALUES // max(1, len(names)))

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [SparkFiles.get(name) for name in files]
        cuts, tables = thresholds(paths, len(table_base) if target else 1), {}
        for slab in _slabs(batches, rows_at_once, pa.concat_batches):
            rows = np.stack([pc.fill_null(slab.column(x), np.nan).to_numpy() for x in inputs], axis=1)
            impact = np.zeros(rows.shape)
            classes = slab.column("_target").to_numpy(zero_copy_only=False) if target else np.full(len(rows), positive)
            members = {int(k): np.flatnonzero(classes == k) for k in np.unique(classes)}
            if cuts:
                known = ~np.isnan(rows).any(axis=1)
                for k, at in members.items():
                    if k not in tables:
                        tables[k] = cell_impacts(paths, cuts, k)
                    at = at[known[at]]
                    impact[np.ix_(at, list(cuts))] = tables[k][cells(rows[at], cuts)]
                members = {k: at[~known[at]] for k, at in members.items()}
            if any(map(len, members.values())):
                for block in leaf_blocks(paths):
                    for k, at in members.items():
                        impact[at] += tree_shapley(rows[at], block, k)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(inputs))
            impacts = pa.ListArray.from_arrays(offsets, pa.array(impact.ravel()))
            yield pa.RecordBatch.from_arrays([*(slab.column(c) for c in kept), impacts], names=[*kept, "_impact"])

    chosen = [quoted(target).cast("int").alias("_target")] if target else []
    rows = df.select(*map(quoted, kept), *chosen, *[quoted(n).cast("double").alias(x) for n, x in zip(names, inputs)])
    schema = T.StructType([*[rows.schema[k] for k in kept], T.StructField("_impact", T.ArrayType(T.DoubleType()))])
    named = [F.struct(F.lit(n).alias("feature"), F.col("_impact")[i].alias("impact")) for i, n in enumerate(names)]
    attributed = rows.mapInArrow(attribute, schema)
    return attributed.select(*map(quoted, kept), F.array(*named).alias(output)), table.base if target else table.base[positive]


def attribution(
    df: DataFrame,
    model: Model,
    features: Sequence[str],
    keep: Sequence[str] = (),
    background: DataFrame | None = None,
    target: str | None = None,
) -> DataFrame:
    """Kept columns and impacts for a logistic regression (needs a background table) or a tree classifier.

    Explained is the positive class, or the class whose index the column ``target`` holds.
    """
    if isinstance(model, LogisticRegressionModel):
        means = background_means(df if background is None else background, features)
        weights = linear_class_weights(model, features) if target else linear_weights(model, features)
        return linear_attribution(df, weights, means, keep, target=target)
    if isinstance(model, (RandomForestClassificationModel, DecisionTreeClassificationModel)):
        return tree_attribution(df, model, features, keep, target=target)[0]
    raise UnsupportedModelError(f"unsupported model type: {type(model).__name__}")


def impact_column(impacts: Column, feature: str) -> Column:
    """Impact of one feature out of an impacts array."""
    return F.get(F.filter(impacts, lambda item: item["feature"] == feature), F.lit(0))["impact"]
