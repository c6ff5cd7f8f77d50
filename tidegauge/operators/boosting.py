"""Gradient-boosted trees that grow by leaf, fitted in one stage.

Each task of the stage holds its share of the training rows, in bins. Per step all tasks add up their histograms of the
nodes in question (an all-gather of sums, whose size depends on features and bins only), so each comes to the same splits
without rows moving. Rows up to ``ROWS_PER_TASK`` make one task, which has nobody to wait for; more make a barrier stage, in
which Spark takes about a second for each step. The model is a table of nodes. A lost executor makes Spark start the stage again.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import SEED
from tidegauge.functions.columns import key_hash, quoted
from tidegauge.session import written

#: Training rows that a task holds, at 24 bytes and 8 bytes per feature.
ROWS_PER_TASK = 500_000

NODE_SCHEMA = "tree int, id int, left int, right int, feature int, threshold double, value double, rows long, hessian double, gain double, loss double"


@dataclass(frozen=True)
class Preset:
    """Rounds of trees with at most ``leaves`` leaves; shares of rows and features drawn anew for each of them."""

    rounds: int = 300
    rate: float = 0.05
    leaves: int = 31
    row_share: float = 0.8
    feature_share: float = 0.8
    bins: int = 255
    min_rows: int = 20
    min_hessian: float = 1e-3
    seed: int = SEED


@dataclass(frozen=True)
class BoostedModel:
    """Written nodes, the log odds before the first tree, and the features in order."""

    nodes: DataFrame
    start: float
    features: tuple[str, ...]

    def save(self, path: str) -> None:
        facts = {"start": F.lit(self.start), "features": F.array(*map(F.lit, self.features))}
        self.nodes.withColumns(facts).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        table = spark.read.parquet(path)
        start, features = table.select("start", "features").first()
        return BoostedModel(table.drop("start", "features"), start, tuple(features))

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Kept columns with margin, probability of class 1, prediction and confidence; missing values go left.

        The nodes are at most ``rounds * (2 * leaves - 1)`` rows, which go to the workers with the code.
        """
        trees = [t.sort_values("id") for _, t in self.nodes.toPandas().groupby("tree", sort=True)]
        trees = [tuple(t[c].to_numpy() for c in ("left", "right", "feature", "threshold", "value")) for t in trees]
        start, kept, inputs = self.start, list(keep), [f"_x{i}" for i in range(len(self.features))]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows, margin = batch[inputs].to_numpy(float), np.full(len(batch), start)
                for tree in trees:
                    margin += leaf_values(rows, *tree)
                yield batch[kept].assign(margin=margin)

        table = df.select(*map(quoted, kept), *[quoted(f).cast("double").alias(x) for f, x in zip(self.features, inputs)])
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema[: len(kept)])
        scored = table.mapInPandas(run, f"{fields}, margin double" if kept else "margin double")
        p = 1 / (1 + F.exp(-F.col("margin")))
        shown = scored.withColumn("probability", p).withColumn("prediction", (F.col("probability") > 0.5).cast("double"))
        return shown.withColumn("confidence", F.greatest("probability", 1 - F.col("probability")))


def leaf_values(rows: np.ndarray, left, right, feature, threshold, value) -> np.ndarray:
    """The value of the leaf that each row reaches."""
    node = np.zeros(len(rows), int)
    while True:
        inner = np.flatnonzero(left[node] >= 0)
        if not len(inner):
            return value[node]
        at = node[inner]
        x = rows[inner, feature[at]]
        node[inner] = np.where(np.isnan(x) | (x <= threshold[at]), left[at], right[at])


def fit(df: DataFrame, features: Sequence[str], label: str, key: str, preset: Preset = Preset(), rows_per_task: int = ROWS_PER_TASK) -> BoostedModel:
    """Fit on rows with a label of 0 or 1, drawn by a hash of the key; rows without a label teach nothing."""
    spark = df.sparkSession
    inputs = [f"x{i}" for i in range(len(features))]
    columns = [quoted(f).cast("double").alias(x) for f, x in zip(features, inputs)]
    rows = df.where(quoted(label).isNotNull()).select(key_hash(quoted(key), preset.seed).alias("draw"), quoted(label).cast("double").alias("y"), *columns)
    rows = written(rows, "boosting-rows")
    places = [float(q) for q in np.arange(1, preset.bins - 1) / (preset.bins - 1)]
    wanted = [F.percentile_approx(F.when(~F.isnan(x), F.col(x)), places, 10 * preset.bins).alias(x) for x in inputs]
    facts = rows.agg(F.sum("y").alias("ones"), F.count("*").alias("n"), *wanted).first()
    cuts = [np.unique(np.array(facts[x] or [], float)) for x in inputs]
    share = min(max((facts["ones"] or 0) / max(facts["n"], 1), 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))

    tasks = max(1, -(-facts["n"] // rows_per_task))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        table = pd.concat(frames) if frames else pd.DataFrame(columns=["draw", "y", *inputs], dtype=float)
        if tasks == 1:
            yield _grow(table, inputs, cuts, start, preset, lambda mine: mine)
            return
        context = BarrierTaskContext.get()
        nodes = _grow(table, inputs, cuts, start, preset, lambda mine: _added_up(context, mine))
        if context.partitionId() == 0:
            yield nodes

    # in key order, so that sums of one task are the same bits every time
    dealt = rows.repartition(tasks, "draw").sortWithinPartitions("draw", "y", *inputs)
    nodes = dealt.mapInPandas(run, NODE_SCHEMA, barrier=tasks > 1)
    return BoostedModel(written(nodes, "boosted-nodes"), start, tuple(features))


def _added_up(context: BarrierTaskContext, mine: np.ndarray) -> np.ndarray:
    """The sum over all tasks, the same bits in each of them."""
    parts = context.allGather(base64.b64encode(np.ascontiguousarray(mine, float).tobytes()).decode())
    return np.sum([np.frombuffer(base64.b64decode(p)) for p in parts], axis=0).reshape(mine.shape)


def _grow(table: pd.DataFrame, inputs: list[str], cuts: list[np.ndarray], start: float, preset: Preset, total: Callable) -> pd.DataFrame:
    """All trees, from this task's rows and the sums over all tasks."""
    width = preset.bins + 1
    bins = np.zeros((len(inputs), len(table)), np.int64)  # 0 is missing, k + 1 the cell up to cut k
    for i, x in enumerate(inputs):
        value = table[x].to_numpy(float)
        bins[i] = np.where(np.isnan(value), 0, np.searchsorted(cuts[i], value, side="left") + 1)
    y, draw = table["y"].to_numpy(float), table["draw"].to_numpy(float)
    margin, found = np.full(len(table), start), []
    for tree in range(preset.rounds):
        chance = np.random.default_rng([preset.seed, tree])
        chosen = np.sort(chance.permutation(len(inputs))[: max(1, round(preset.feature_share * len(inputs)))])
        odd = int(chance.integers(1, 2**31)) * 2 + 1
        drawn = (draw % 2**31 * odd % 2**31) / 2**31 < preset.row_share if preset.row_share < 1 else np.ones(len(table), bool)
        p = 1 / (1 + np.exp(-margin))
        loss = -np.sum(np.where(y > 0, np.log(np.maximum(p, 1e-300)), np.log(np.maximum(1 - p, 1e-300))))
        weights = np.stack([p - y, p * (1 - p), np.ones(len(y))]) * drawn
        node, nodes = _tree(bins[chosen], weights, width, preset, total, loss)
        value = np.array([n["value"] for n in nodes])
        margin += value[node]
        for i, n in enumerate(nodes):
            inner = n["left"] >= 0
            feature = int(chosen[n["feature"]]) if inner else -1
            cut = -np.inf if inner and n["bin"] == 0 else (cuts[feature][n["bin"] - 1] if inner else np.nan)
            found.append((tree, i, n["left"], n["right"], feature, cut, 0.0 if inner else n["value"], int(round(n["sums"][2])), n["sums"][1], n["gain"] if inner else 0.0, n["loss"]))
    names = [part.split()[0] for part in NODE_SCHEMA.split(", ")]
    return pd.DataFrame(found, columns=names)


def _tree(bins: np.ndarray, weights: np.ndarray, width: int, preset: Preset, total: Callable, loss: float) -> tuple[np.ndarray, list[dict]]:
    """(node of each row, nodes) of the tree that splits the leaf with the largest gain again and again.

    Splits are tried ahead: all leaves that best-first growth would take by the gains known so far are split in one step.
    What it takes in the end has all its gains known, so tries that it leaves out change nothing.
    """
    features, rows = bins.shape
    place = np.zeros(rows, int)

    def histograms(members: Sequence[int]) -> np.ndarray:
        """(node, sum, feature, bin) of this task's rows in some nodes."""
        slot = np.full(len(tried), -1)
        slot[list(members)] = np.arange(len(members))
        here = slot[place]
        inside = np.flatnonzero(here >= 0)
        result = np.zeros((len(members), 3, features, width))
        for f in range(features):
            cell = here[inside] * width + bins[f, inside]
            for k in range(3):
                result[:, k, f] = np.bincount(cell, weights[k, inside], len(members) * width).reshape(-1, width)
        return result

    def node(sums: np.ndarray) -> dict:
        below = np.cumsum(sums, axis=2)
        whole = below[:, 0, -1]
        above = whole[:, None, None] - below
        score = lambda s: s[0] ** 2 / np.maximum(s[1], 1e-12)
        gain = score(below) + score(above) - score(whole)
        fits = (np.minimum(below[2], above[2]) >= preset.min_rows) & (np.minimum(below[1], above[1]) >= preset.min_hessian)
        gain = np.where(fits, gain, -np.inf)
        f, b = divmod(int(np.argmax(gain)), width)
        return {"histogram": sums, "sums": whole, "gain": float(gain[f, b]), "feature": f, "bin": b, "left": -1, "right": -1,
                "value": float(-whole[0] / max(whole[1], 1e-12) * preset.rate)}

    def best_first() -> list[int]:
        """The nodes to split, in order, as far as gains are known."""
        taken, leaves = [], [0]
        while len(taken) < preset.leaves - 1:
            open_ = [i for i in leaves if tried[i]["gain"] > 1e-12]
            if not open_:
                break
            best = max(open_, key=lambda i: (tried[i]["gain"], -i))
            taken.append(best)
            leaves.remove(best)
            leaves += [i for i in (tried[best]["left"], tried[best]["right"]) if i >= 0]
        return taken

    tried: list[dict] = [{}]
    first = total(np.append(histograms([0]).ravel(), loss))
    loss, tried = first[-1], [node(first[:-1].reshape(3, features, width))]
    while True:
        taken = best_first()
        new = [i for i in taken if tried[i]["left"] < 0]
        if not new:
            break
        for i in new:
            tried[i]["left"], tried[i]["right"] = len(tried), len(tried) + 1
            here = np.flatnonzero(place == i)
            place[here] = np.where(bins[tried[i]["feature"], here] <= tried[i]["bin"], len(tried), len(tried) + 1)
            tried += [{}, {}]
        sums = total(histograms([tried[i]["left"] for i in new]))
        for i, left in zip(new, sums):
            tried[tried[i]["left"]], tried[tried[i]["right"]] = node(left), node(tried[i]["histogram"] - left)
    kept, number, leaf_of = [0], {0: 0}, {}
    for i in taken:
        for child in (tried[i]["left"], tried[i]["right"]):
            number[child] = len(kept)
            kept.append(child)
    for i, n in enumerate(tried):
        leaf_of[i] = number[i] if i in number else leaf_of.get(i)
        for child in (n["left"], n["right"]):
            if child >= 0 and child not in number:
                leaf_of[child] = leaf_of[i]
    inner = set(taken)
    nodes = [tried[i] | {"left": number[tried[i]["left"]] if i in inner else -1, "right": number[tried[i]["right"]] if i in inner else -1, "loss": loss} for i in kept]
    return np.array([leaf_of[i] for i in range(len(tried))])[place], nodes
