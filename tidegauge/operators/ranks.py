"""Exact order statistics of many columns, by the same steps at any table size.

``percentile`` keeps every distinct value of a column in one task and ``percentile_approx`` is approximate.
Here a bounded sample only proposes cut points around the wanted ranks, as a range partitioner does. A counting job with
a map side then says exactly where every rank lies: at a cut, which settles it, or in the gap between two cuts. Gaps are
read once their counted rows are within the budget and are narrowed by further rounds before, so the result is exact and
neither a task nor the driver ever holds a whole column.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import count as numbers_from

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import bisected, quoted, sql_double
from tidegauge.session import written

COLUMNS_PER_SCAN = 40  # keeps generated code small; every scan reads only its own columns

Wanted = Callable[[str, int], Iterable[int]]


@dataclass(frozen=True)
class Budget:
    """What the driver may hold: rows and values of a sample, and the rows of the gaps that are read in the end.

    Results do not depend on it; a smaller one takes more rounds.
    """

    sample_rows: int = 100_000
    sample_values: int = 1_000_000
    read: int = 1_000_000


@dataclass(frozen=True)
class RankedColumn:
    """Values at the wanted ranks (0-based), with the number of values below and up to each."""

    count: int
    values: dict[int, float]
    below: dict[int, int]
    through: dict[int, int]

    def settle(self, rank: int, value: float, below: int, through: int) -> None:
        self.values[rank], self.below[rank], self.through[rank] = value, below, through


def long_rows(df: DataFrame, keep: Sequence[str], columns: Sequence[str], value: str) -> DataFrame:
    """One row per input row and column, as (kept columns, number of the column, value).

    Many columns are spread over several scans; a scan then reads only its own columns.
    """
    parts = []
    for start in range(0, len(columns), COLUMNS_PER_SCAN):
        block = list(columns[start : start + COLUMNS_PER_SCAN])
        part = df.select(*keep, *[quoted(c).alias(str(start + k)) for k, c in enumerate(block)])
        parts.append(part.unpivot(list(keep), [str(start + k) for k in range(len(block))], "number", value))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def order_statistics(
    df: DataFrame,
    columns: Mapping[str, Column],
    wanted: Wanted,
    rows: int | None = None,
    budget: Budget = Budget(),
) -> dict[str, RankedColumn]:
    """Values at the ranks ``wanted(name, count)`` of every column. NULLs do not count; values must be finite."""
    names = list(columns)
    if not names:
        return {}
    table = df.select(*[columns[name].cast("double").alias(f"c{i}") for i, name in enumerate(names)])
    rows = df.count() if rows is None else rows
    cuts = _propose(table, names, wanted, max(rows, 1), budget)
    found = {name: RankedColumn(0, {}, {}, {}) for name in names}
    for round_ in numbers_from(2):
        starts = _cell_starts(table, cuts)
        places = {}
        for i, cut in cuts.items():
            size, name = int(starts[i][-1]), names[i]
            if not found[name].count:
                found[name] = RankedColumn(size, {}, {}, {})
            for rank in set(wanted(name, size)) - set(found[name].values):
                cell = int(np.searchsorted(starts[i], rank, side="right")) - 1
                if cell % 2:
                    found[name].settle(rank, cut.points[cell // 2], int(starts[i][cell]), int(starts[i][cell + 1]))
                else:
                    places.setdefault((i, cell), []).append(rank)
        if not places:
            return found
        sizes = {(i, cell): int(starts[i][cell + 1] - starts[i][cell]) for i, cell in places}
        gaps = {(i, cell): cuts[i].bounds(cell // 2) for i, cell in places}
        open_ = {i: Cuts.around([g for (k, _), g in gaps.items() if k == i]) for i, _ in places}
        live = sum(sizes.values())
        if live <= budget.read:
            for (i, cell), (value, through) in _read(table, open_, gaps).items():
                for rank in places[i, cell]:
                    start = int(starts[i][cell])
                    at = bisect_left(through, rank - start + 1)
                    below = int(through[at - 1]) if at else 0
                    found[names[i]].settle(rank, float(value[at]), start + below, start + int(through[at]))
            return found
        cuts = _narrow(table, open_, gaps, sizes, places, starts, min(1.0, budget.sample_values / live), round_)


@dataclass(frozen=True)
class Cuts:
    """Cut points of one column: cell 2k is the open gap below cut k, cell 2k+1 the cut itself.

    ``live`` are the gaps, by k, whose values are still of interest.
    """

    points: list[float]
    live: set[int]

    def cell(self, name: str) -> Column:
        """Cell number of a column's values."""
        tests = [f"{name} {test} {sql_double(p)}" for p in self.points for test in ("<", "<=")]
        return F.expr(f"IF({name} IS NULL, NULL, {bisected(tests, [str(k) for k in range(len(tests) + 1)])})")

    def only_live(self, name: str) -> Column:
        """The values inside live gaps, else NULL."""
        inside = [
            f"({name} > {sql_double(low)} AND {name} < {sql_double(high)})"
            for low, high in map(self.bounds, sorted(self.live))
        ]
        return F.expr(f"IF({' OR '.join(inside) or 'false'}, {name}, NULL)")

    def bounds(self, gap: int) -> tuple[float, float]:
        low = self.points[gap - 1] if gap > 0 else -math.inf
        high = self.points[gap] if gap < len(self.points) else math.inf
        return low, high

    @staticmethod
    def around(gaps: Iterable[tuple[float, float]], solved: Iterable[float] = ()) -> Cuts:
        """Cuts at the ends of the given open gaps (which become live) and at solved values."""
        gaps = list(gaps)
        points = sorted({p for gap in gaps for p in gap if not math.isinf(p)} | set(solved))
        live = set()
        for low, high in gaps:
            first = 0 if math.isinf(low) else bisect_left(points, low) + 1
            last = len(points) if math.isinf(high) else bisect_left(points, high)
            live.update(range(first, last + 1))
        return Cuts(points, live)


def _around(sample: np.ndarray, fraction: float, share: float, low: float, high: float) -> tuple[float, float]:
    """Ends of a gap inside (low, high) that should hold the value at ``share``: four standard errors to either side.

    The error of a sample without replacement vanishes as the sample becomes the whole; then both ends are the value.
    """
    size = len(sample)
    if not size:
        return low, high
    position, slack = share * size, 2 * math.sqrt(size * (1 - fraction))
    first, last = math.floor(position - slack + 1e-6), math.ceil(position + slack - 1e-6)
    return float(sample[min(first, size - 1)]) if first >= 0 else low, float(sample[last]) if last < size else high


def _cut(gaps: Iterable[tuple[float, float]]) -> Cuts:
    """Cuts at the ends of the gaps; a gap whose ends meet is a cut."""
    gaps = set(gaps)
    return Cuts.around([g for g in gaps if g[0] != g[1]], [low for low, high in gaps if low == high])


def _propose(table, names, wanted, rows, budget) -> dict[int, Cuts]:
    """First cuts, from a sample of the whole table."""
    fraction = min(1.0, budget.sample_rows / rows, budget.sample_values / (rows * len(names)))
    sample = table.sample(fraction=fraction, seed=1).toArrow()
    proposed = {}
    for i, name in enumerate(names):
        values = np.sort(sample[f"c{i}"].drop_null().to_numpy())
        estimate = max(1, round(len(values) / fraction))
        proposed[i] = _cut(_around(values, fraction, rank / estimate, -math.inf, math.inf) for rank in wanted(name, estimate))
    return proposed


def _cell_starts(table, cuts: dict[int, Cuts]) -> dict[int, np.ndarray]:
    """For every column the number of values before each cell, and of all values last."""
    numbers = list(cuts)
    cells = table.select(*[cuts[i].cell(f"c{i}").alias(f"c{i}") for i in numbers])
    cells = long_rows(cells, [], [f"c{i}" for i in numbers], "cell").where(F.col("cell").isNotNull())
    sizes = {i: np.zeros(2 * len(cuts[i].points) + 1, np.int64) for i in numbers}
    for r in cells.groupBy("number", "cell").count().collect():
        sizes[numbers[int(r["number"])]][r["cell"]] = r["count"]
    return {i: np.concatenate([[0], np.cumsum(s)]) for i, s in sizes.items()}


def _live_values(table, open_: dict[int, Cuts]) -> DataFrame:
    """(place of the column in ``open_``, value) of the values in live gaps."""
    live = table.select(*[cut.only_live(f"c{i}").alias(f"c{i}") for i, cut in open_.items()])
    return long_rows(live, [], [f"c{i}" for i in open_], "value").where(F.col("value").isNotNull())


def _inside(values: np.ndarray, gap: tuple[float, float]) -> slice:
    return slice(np.searchsorted(values, gap[0], side="right"), np.searchsorted(values, gap[1], side="left"))


def _narrow(table, open_, gaps, sizes, places, starts, fraction, seed) -> dict[int, Cuts]:
    """Cut the open gaps around their ranks, guided by a sample of their values."""
    read = _live_values(table.sample(fraction=fraction, seed=seed), open_).toArrow()
    number, value = read["number"].to_numpy(zero_copy_only=False).astype(int), read["value"].to_numpy()
    own = {i: np.sort(value[number == k]) for k, i in enumerate(open_)}
    found = {i: [] for i in open_}
    for (i, cell), ranks in places.items():
        low, high = gaps[i, cell]
        sample = own[i][_inside(own[i], (low, high))]
        for rank in ranks:
            found[i].append(_around(sample, fraction, (rank - int(starts[i][cell])) / sizes[i, cell], low, high))
    return {i: Cuts.around([], set(open_[i].points) | set(_cut(narrow).points)) for i, narrow in found.items()}


def _read(table, open_, gaps) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For every gap its distinct values in order, and the number of its rows up to each."""
    read = _live_values(table, open_).groupBy("number", "value").agg(F.count("*").alias("n")).toArrow()
    number, value = read["number"].to_numpy(zero_copy_only=False).astype(int), read["value"].to_numpy()
    n, found = read["n"].to_numpy(), {}
    for k, i in enumerate(open_):
        own = np.flatnonzero(number == k)
        own = own[np.argsort(value[own])]
        for (column, cell), gap in gaps.items():
            if column == i:
                part = own[_inside(value[own], gap)]
                found[i, cell] = value[part], np.cumsum(n[part])
    return found


# --- linear-interpolated quantiles --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Quantile:
    """An interpolated quantile and how many values lie below it and up to it."""

    value: float
    below: int
    through: int


def quantile_ranks(count: int, shares: Sequence[float]) -> set[int]:
    ranks: set[int] = set()
    for share in shares if count else ():
        low = math.floor((count - 1) * share)
        ranks.update((low, min(low + 1, count - 1)))
    return ranks


def interpolate(ranked: RankedColumn, share: float) -> Quantile:
    position = (ranked.count - 1) * share
    low = math.floor(position)
    high = min(low + 1, ranked.count - 1)
    part, a, b = position - low, ranked.values[low], ranked.values[high]
    value = a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part)
    if value >= b:
        below = ranked.below[high]
        return Quantile(value, below, ranked.through[high])
    below = ranked.below[low] if value == a else ranked.through[low]
    return Quantile(value, below, ranked.through[low])


def exact_quantiles(
    df: DataFrame, columns: Mapping[str, Column], shares: Sequence[float], rows: int | None = None, budget: Budget = Budget()
) -> dict[str, tuple[int, list[Quantile]]]:
    """(number of values, quantiles) of every column."""
    found = order_statistics(df, columns, lambda _name, count: quantile_ranks(count, shares), rows, budget)
    return {
        name: (ranked.count, [interpolate(ranked, share) for share in shares] if ranked.count else [])
        for name, ranked in found.items()
    }


PLACE_BITS = 33  # bits of ``monotonically_increasing_id`` below the number of the partition


def numbered(df: DataFrame, order: str, output: str = "position") -> DataFrame:
    """``df`` with its rows' places from 0 in ``order`` (distinct values, NULL first), without sorting in one task.

    A range sort writes the place in each partition; the counts of the partitions, one row each, say where it starts.
    """
    by = quoted(order).asc_nulls_first()
    dealt = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_place", F.monotonically_increasing_id())
    dealt = written(dealt, "numbered")
    task = F.shiftright("_place", PLACE_BITS)
    sizes = dealt.groupBy(task.alias("_task")).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    place = F.col("_place").bitwiseAND(F.lit(2**PLACE_BITS - 1)) + F.col("_start")
    return dealt.join(starts, task == F.col("_task")).withColumn(output, place).drop("_place", "_task", "_start")
