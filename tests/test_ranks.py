"""Exact order statistics against NumPy, also when every limit forces sampling and narrowing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidegauge.operators import ranks

SHARES = [float(s) for s in np.linspace(0, 100, 11)[1:-1] / 100]


def make(kind, n, rng):
    return {
        "normal": rng.normal(size=n),
        "few_values": rng.integers(0, 5, n).astype(float),
        "third_in_one_value": np.where(rng.random(n) < 0.34, 7.0, rng.normal(size=n) * 100),
        "heavy_tail": np.exp(rng.normal(size=n) * 5),
        "constant": np.full(n, 3.5),
        "sorted": np.arange(n, dtype=float),
    }[kind]


KINDS = ["normal", "few_values", "third_in_one_value", "heavy_tail", "constant", "sorted"]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({k: make(k, 20_000, rng) for k in KINDS})
    return frame, spark.createDataFrame(frame).repartition(4).persist()


@pytest.mark.parametrize("read_limit,sample", [(10**6, 10**5), (30_000, 5_000), (3_000, 2_000)])
def test_equals_numpy(wide, read_limit, sample):
    frame, table = wide
    budget = ranks.Budget(sample_rows=sample, read=read_limit)
    found = ranks.exact_quantiles(table, {k: F.col(k) for k in KINDS}, SHARES, budget=budget)
    for kind in KINDS:
        count, quantiles = found[kind]
        assert count == len(frame)
        assert np.array_equal([q.value for q in quantiles], np.percentile(frame[kind], np.linspace(0, 100, 11)[1:-1]))
        for q in quantiles:
            assert q.through == (frame[kind] <= q.value).sum()
            assert q.below == (frame[kind] < q.value).sum()


def test_nulls_and_empty_columns(spark):
    table = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    found = ranks.exact_quantiles(table, {"a": F.col("a"), "b": F.col("b")}, [0.5])
    assert found["a"][0] == 2 and found["a"][1][0].value == 2.0
    assert found["b"] == (0, [])


def test_misleading_sample_is_corrected(spark, monkeypatch):
    """Cuts proposed from a useless sample still lead to the exact value."""
    table = spark.range(5000).select(F.col("id").cast("double").alias("v")).repartition(4)
    monkeypatch.setattr(ranks, "_propose", lambda *_: {0: ranks.Cuts.around([(10.0, 20.0)])})
    budget = ranks.Budget(sample_values=700, read=500)
    found = ranks.order_statistics(table, {"v": F.col("v")}, lambda _n, _c: [0, 2500, 4999], budget=budget)
    assert found["v"].values == {0: 0.0, 2500: 2500.0, 4999: 4999.0}


def test_many_columns_are_spread_over_scans(spark):
    table = spark.range(50).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(95)])
    found = ranks.exact_quantiles(table, {c: F.col(c) for c in table.columns}, [0.5])
    assert [found[f"c{i}"][1][0].value for i in range(95)] == [24.5 * (i + 1) for i in range(95)]


@pytest.mark.parametrize("read", [1, 50, 400])
def test_read_bound_holds_for_sparse_columns(spark, monkeypatch, read):
    """A column that the sample misses is narrowed like any other; no read holds more rows than the budget says."""
    table = spark.range(20_000).repartition(4).select(
        F.when(F.col("id") % 40 == 0, F.col("id").cast("double")).alias("sparse"), F.col("id").cast("double").alias("full")
    )
    sizes, read_gaps = [], ranks._read

    def watched(*args):
        found = read_gaps(*args)
        sizes.append(sum(int(through[-1]) for _, through in found.values()))
        return found

    monkeypatch.setattr(ranks, "_read", watched)
    budget = ranks.Budget(sample_rows=20, sample_values=200, read=read)
    found = ranks.exact_quantiles(table, {c: F.col(c) for c in table.columns}, [0.25, 0.5], budget=budget)
    assert [q.value for q in found["sparse"][1]] == [4990.0, 9980.0] and found["sparse"][0] == 500
    assert [q.value for q in found["full"][1]] == [4999.75, 9999.5]
    assert all(size <= read for size in sizes)
