"""Embedding near-duplicates by an inverted multi-index.

Vectors are cut in halves, each half has a codebook of its own, and the product of both codebooks is a grid of cells. A
vector is stored in its nearest cell; as a query it visits cells in the order of a multi-sequence traversal (ascending
sum of the two halves' distances) until the target recall, and the pairs met there are verified in double precision.

Equal vectors are one representative. Codebooks and the length of the traversal are fitted on a bounded sample
(``SAMPLE`` vectors): the traversal is as long as needed to find ``RECALL`` of the neighbours planted at exactly the
limit, the hardest ones. Every vector is indexed and every vector is a query. Vectors meet in blocks of bounded size,
so a hot cell is many small products; a block reports link counts per vector and a star per group of linked vectors,
never the pairs. A pair found from either side counts on both.

Vectors of different lengths never link; each length is indexed by itself.

Defined cases: null and empty vectors, vectors with null or non-finite components, zero vectors, and vectors with a null
key link with nothing; repeated keys are rows of their own; equal vectors link with each other; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import mapped, saved
from tidegauge.llm.graph import components, forest

LIMIT = 0.95
SAMPLE, CENTERS, ROUNDS = 8192, 32, 12
RECALL = 0.995
BLOCK = 1024


@dataclass(frozen=True)
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        return _squares(x[:, :half], self.first), _squares(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """The nearest ``visits`` cells of each row, nearest first."""
        a, b = self.distances(x)
        return traversal(a, b, self.visits)


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :]


def traversal(a: np.ndarray, b: np.ndarray, visits: int) -> np.ndarray:
    """Cells in ascending order of the sum of both distances.

    Cell (i, j), by rank in each half, has (i + 1)(j + 1) - 1 cells before it, so only ranks with a product of at most
    ``visits`` can be among the first ``visits``.
    """
    order_a, order_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
    sorted_a, sorted_b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
    ranks = [(i, j) for i in range(a.shape[1]) for j in range(b.shape[1]) if (i + 1) * (j + 1) <= visits]
    i, j = np.array(ranks).T
    best = np.argsort(sorted_a[:, i] + sorted_b[:, j], axis=1, kind="stable")[:, :visits]
    return order_a[np.arange(len(a))[:, None], i[best]] * b.shape[1] + order_b[np.arange(len(a))[:, None], j[best]]


def codebook(x: np.ndarray, centers: int, random: np.random.Generator) -> np.ndarray:
    """k-means of the sample."""
    chosen = x[random.choice(len(x), min(centers, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = _squares(x, chosen).argmin(axis=1)
        sizes = np.bincount(nearest, minlength=len(chosen))
        sums = np.zeros_like(chosen)
        np.add.at(sums, nearest, x)
        filled = sizes > 0
        chosen[filled] = sums[filled] / sizes[filled][:, None]
    return chosen


def fit(sample: np.ndarray, limit: float = LIMIT, recall: float = RECALL, centers: int = CENTERS, seed: int = 0) -> MultiIndex:
    """Codebooks, and the visits that find ``recall`` of neighbours at exactly ``limit``."""
    random = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    index = MultiIndex(codebook(sample[:, :half], centers, random), codebook(sample[:, half:], centers, random), 0)
    if sample.shape[1] < 2:
        return MultiIndex(index.first, index.second, 1)
    noise = random.normal(size=sample.shape)
    noise -= (noise * sample).sum(axis=1)[:, None] * sample
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    planted = limit * sample + np.sqrt(1 - limit * limit) * noise
    a, b = index.distances(sample)
    cell = index.cells(planted)
    sums = a[:, :, None] + b[:, None, :]
    own = sums.reshape(len(sample), -1)[np.arange(len(sample)), cell]
    before = (sums.reshape(len(sample), -1) <= own[:, None]).sum(axis=1)
    return MultiIndex(index.first, index.second, int(np.quantile(before, recall, method="higher")))


def representatives(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Usable vectors, equal ones once: rep, key (the smallest), copies, v (array<double>)."""
    usable = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(
        "key is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x != 0)"
    )
    grouped = usable.groupBy("v").agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    return saved(grouped, "vectors").withColumn("rep", F.monotonically_increasing_id())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    x = x / np.abs(x).max(axis=1)[:, None]  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1)[:, None]


BLOCKS = "cell int, ids binary, copies binary, homes binary, data binary"


def _blocks(cells: np.ndarray, rows: np.ndarray, ids, copies, homes, x) -> Iterator[pa.RecordBatch]:
    """Rows grouped by cell in blocks of at most ``BLOCK`` vectors."""
    order = np.argsort(cells, kind="stable")
    cells, rows = cells[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else []
    out = []
    for start, stop in zip(starts, [*starts[1:], len(cells)]):
        for k in range(start, stop, BLOCK):
            part = rows[k : min(k + BLOCK, stop)]
            out.append((int(cells[start]), ids[part].tobytes(), copies[part].tobytes(), homes[part].tobytes(), x[part].tobytes()))
            if len(out) == 64:
                yield _block_batch(out)
                out = []
    if out:
        yield _block_batch(out)


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])


def one_cell(width: int) -> MultiIndex:
    """The index of a vector length too rare to need cells: all its vectors meet."""
    return MultiIndex(np.zeros((1, width // 2)), np.zeros((1, width - width // 2)), 1)


def near_links(reps: DataFrame, limit: float = LIMIT, recall: float = RECALL, centers: int = CENTERS) -> DataFrame:
    """Rows (rep, n, a, b): link counts to add up per representative, or links (a, b) of stars.

    Every length has an index of its own: the most frequent one and those of over ``SAMPLE`` vectors a fitted one, the
    others a single cell each.
    """
    size = F.size("v")
    widths = reps.groupBy(size.alias("width")).count()
    most = widths.orderBy(F.desc("count"), "width").first()
    indexed = sorted({r["width"] for r in [most, *widths.where(F.col("count") > SAMPLE).collect()] if r})
    found = []
    for width in indexed:
        own = reps.where(size == width)
        picked = own.orderBy(F.xxhash64("key", "v"), "rep").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
        found.append(_links(own, fit(_matrix(picked, width), limit, recall, centers), limit))
    rare = ~size.isin(indexed)
    if not indexed or not widths.where(~F.col("width").isin(indexed)).isEmpty():
        found.append(_links(reps.where(rare), None, limit))
    return reduce(DataFrame.unionByName, found)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = pc.list_value_length(batch.column("v"))
    for width in sorted(pc.unique(widths).to_pylist()):
        yield width, batch.filter(pc.equal(widths, width))


def _links(reps: DataFrame, index: MultiIndex | None, limit: float) -> DataFrame:
    """``near_links`` of vectors of one length by an index, or of any lengths with one cell for each."""
    shared = reps.sparkSession.sparkContext.broadcast(index)  # 2 x CENTERS half vectors

    def spread(batches: Iterator[pa.RecordBatch], stored: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8 * BLOCK):
                for width, part in _by_width(batch.slice(k, 8 * BLOCK)):
                    index = shared.value or one_cell(width)
                    x = _matrix(part.column("v"), width)
                    ids, copies = (part.column(c).to_numpy() for c in ("rep", "copies"))
                    homes = index.cells(x)
                    cells = homes[:, None] if stored else index.visited(x)
                    rows = np.repeat(np.arange(len(x)), cells.shape[1])
                    place = cells.ravel() if shared.value else np.full(cells.size, width)
                    yield from _blocks(place, rows, ids, copies, homes, x)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda data, kind: np.frombuffer(data, kind)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                q_ids, s_ids = read(row["q_ids"], np.int64), read(row["ids"], np.int64)
                q, s = (read(row[c], np.float64).reshape(len(n), -1) for c, n in (("q_data", q_ids), ("data", s_ids)))
                index = shared.value or one_cell(s.shape[1])
                near = q @ s.T >= limit
                near &= q_ids[:, None] != s_ids[None, :]
                some_q, some_s = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(some_q):
                    continue
                near = near[np.ix_(some_q, some_s)]
                homes = read(row["q_homes"], np.int64)[some_q]
                back = (index.visited(s[some_s])[:, :, None] == np.unique(homes)[None, None, :]).any(axis=1)
                back = back[:, np.searchsorted(np.unique(homes), homes)].T  # does the stored one visit the query's cell?
                own = near @ read(row["copies"], np.int64)[some_s]
                other = (near & ~back).T @ read(row["q_copies"], np.int64)[some_q]
                i, j = np.nonzero(near)
                a, b = forest(q_ids[some_q][i], s_ids[some_s][j])
                reps = np.concatenate([q_ids[some_q], s_ids[some_s]])
                n = np.concatenate([own, other])
                pad = np.zeros(len(a), np.int64)
                columns = [np.concatenate([reps, pad]), np.concatenate([n, pad])]
                star = [pa.array(np.concatenate([np.zeros(len(reps), np.int64), y]), mask=np.arange(len(reps) + len(a)) < len(reps)) for y in (a, b)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *star], names=["rep", "n", "a", "b"])

    stored = mapped(reps.select("rep", "copies", "v"), lambda x: spread(x, True), BLOCKS)
    asking = mapped(reps.select("rep", "copies", "v"), lambda x: spread(x, False), BLOCKS)
    asking = asking.select("cell", *[F.col(c).alias(f"q_{c}") for c in ("ids", "copies", "homes", "data")])
    met = asking.join(stored.hint("merge"), "cell").select("q_ids", "q_copies", "q_homes", "q_data", "ids", "copies", "data")
    return mapped(met, verify, "rep long, n long, a long, b long")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", limit: float = LIMIT, recall: float = RECALL, centers: int = CENTERS) -> DataFrame:
    """(key, n_links, group) per row; group is the smallest key reachable by links, the row's own if it has none."""
    reps = saved(representatives(vectors, key, vector), "representatives")
    met = saved(near_links(reps, limit, recall, centers), "vector-links")
    degrees = met.where("a is null").groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(met.where("a is not null").select("a", "b"))
    parts = saved(parts.select(F.col("node").alias("rep"), "root"), "vector-parts")
    lows = reps.join(parts, "rep").groupBy("root").agg(F.min("key").alias("low"))
    known = reps.join(degrees, "rep", "left").join(parts.join(lows, "root"), "rep", "left")
    known = saved(
        known.select("v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("low", "key").alias("group")),
        "vector-groups",
    )
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    found = F.col("key").isNotNull()
    return rows.join(known, "v", "left").select(
        "key", F.coalesce(F.when(found, F.col("n_links")), F.lit(0).cast("long")).alias("n_links"), F.coalesce(F.when(found, F.col("group")), "key").alias("group")
    )
