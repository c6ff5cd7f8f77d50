"""Connected components of a link table by contraction, entirely in written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import mapped, saved

FOREST = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links (a, b): pairs (member, smallest member) without the smallest itself."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[member], nodes[root[member]]


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) of the same components: each batch is reduced to stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return mapped(links.select("a", "b"), run, FOREST)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows these hooks to their ends by doubling, and replaces
    the links by links between the ends, distinct ones only. A round at least halves the nodes of each component. Nodes
    of a component that no longer has links take no part in later rounds.
    """
    links = saved(thinned(links).distinct(), "links")
    steps = []
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        hooks = saved(hooks.select("node", F.least("node", "low").alias("root")), "hooks")
        while True:
            ends = hooks.select(F.col("node").alias("root"), F.col("root").alias("end"))
            jumped = hooks.join(ends, "root").select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved"))
            jumped = saved(jumped, "hooks")
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        steps.append(hooks)
        left = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = links.join(left, "a").join(right, "b").where("ra != rb")
        links = saved(across.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "links")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0]
    for later in steps[1:]:
        later = later.select(F.col("node").alias("root"), F.col("root").alias("end"))
        found = found.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return found
