"""Exact medians by counting against sorting."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.operators import selection as sel
from posegrid.operators import tracks as trk


def values(kind: str, n: int, seed: int) -> list:
    r = np.random.default_rng(seed)
    if kind == "ties":
        return r.integers(-3, 4, n).astype(float).tolist()
    if kind == "wide":
        return (r.normal(size=n) * 10.0 ** r.integers(-300, 300, n)).tolist()
    if kind == "odd":
        return [[None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1.5][k] for k in r.integers(0, 9, n)]
    return r.normal(size=n).tolist()


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(f"{kind}{n}", None if n == 7 else n, v) for kind in ("ties", "wide", "odd", "plain") for n in (1, 2, 7, 100, 101, 3000) for v in values(kind, n, n)]
    rows += [("none", 1, None)] * 3 + [(None, 1, float(v)) for v in range(50)]
    return spark.createDataFrame(rows, "a string, b int, v double").repartition(5).cache()


def shown(df):
    return sorted((str(r["a"]), str(r["b"]), str(r["percentile"] + 0.0 if r["percentile"] is not None else None)) for r in df.collect())


@pytest.mark.parametrize("small", [0, 99, 1 << 20])
@pytest.mark.parametrize("share,discrete", [(0.5, False), (0.5, True), (0.0, False), (1.0, False), (0.3, False), (0.75, True)])
def test_counting_is_sorting(spark, groups, small, share, discrete):
    want = F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY v)") if discrete else F.percentile("v", share)
    assert shown(sel.percentile(groups, ["a", "b"], "v", share, discrete, small)) == shown(groups.groupBy("a", "b").agg(want.alias("percentile")))


def test_bits_sort_as_numbers():
    import pyarrow as pa

    v = np.array([float("-inf"), -1e308, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e308, float("inf"), float("nan")])
    bits = sel.ordered_bits.func(pa.array(v)).to_numpy()
    assert (np.diff(bits) > 0).all() and np.array_equal(sel.number_of.func(pa.array(bits)).to_numpy(), v, equal_nan=True)
    assert sel.ordered_bits.func(pa.array([-0.0]))[0] == sel.ordered_bits.func(pa.array([0.0]))[0]


def test_large_groups_are_never_gathered(spark):
    """Two groups of distinct values; no aggregate that keeps values, and no task with more counts than there are."""
    n = 400_000
    df = spark.range(2 * n).select((F.col("id") % 2).alias("k"), (F.sin(F.col("id").cast("double")) * F.exp(F.col("id") % 50)).alias("v"))
    found = sel.percentile(df, ["k"], "v", small=1000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    large = plan[plan.index("LeftSemi") :] if "LeftSemi" in plan else plan
    assert "collect_" not in large
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r["k"]: r["percentile"] for r in found.collect()} == want


def test_statistics_of_large_groups(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [("a", float(v)) for v in r.integers(0, 50, 5001)] + [("b", 1.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "metric string, value double")
    before = sorted(map(str, trk.six_statistics(df, ["metric"], "value").collect()))
    monkeypatch.setattr(sel.medians, "__defaults__", (100,))
    assert sorted(map(str, trk.six_statistics(df, ["metric"], "value").collect())) == before
    got = {x["metric"]: x for x in trk.six_statistics(df, ["metric"], "value").collect()}
    own = np.array([v for m, v in rows if m == "a"])
    assert got["a"]["median"] == np.median(own) and math.isclose(got["a"]["std"], own.std()) and got["c"]["median"] is None and got["c"]["n"] == 0


def test_medians_of_several_values(spark):
    df = spark.createDataFrame([(k % 3, float(k), float(-k), None if k % 2 else 1.0 * k) for k in range(900)], "g int, x double, y double, z double")
    rows = lambda d: sorted(tuple(r) for r in d.select("g", "x", "y", "z").collect())
    assert rows(sel.medians(df, ["g"], ["x", "y", "z"], small=10)) == rows(df.groupBy("g").agg(*[F.median(c).alias(c) for c in "xyz"]))
