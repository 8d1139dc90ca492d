"""Banded attention against a plain softmax over all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from posegrid.operators import attention as at


def plain(frames, q, k, v, reach, heads, conf=None):
    """Each query and head by itself; None where no key is seen."""
    n, size, width = len(frames), k.shape[1] // heads, v.shape[1] // heads
    out = []
    for a in range(n):
        seen = [b for b in range(n) if abs(frames[a] - frames[b]) <= reach]
        row = []
        for h in range(heads):
            s = np.array([q[a, h * size : (h + 1) * size] @ k[b, h * size : (h + 1) * size] / np.sqrt(size) + (0 if conf is None else np.log(conf[a] * conf[b] + 1e-6)) for b in seen])
            e = np.exp(s - s.max())
            row += (e[:, None] * v[seen][:, h * width : (h + 1) * width]).sum(0).tolist()
            row[-width:] = (np.array(row[-width:]) / e.sum()).tolist()
        out.append(row)
    return np.array(out)


@pytest.mark.parametrize("block", [1, 3, 512])
@pytest.mark.parametrize("heads,reach", [(1, 0), (2, 4), (3, 100)])
def test_blocks_are_the_softmax(block, heads, reach):
    r = np.random.default_rng(block)
    frames = np.sort(r.integers(0, 40, 50))  # gaps, and frames that repeat
    q, k, v = 9 * r.normal(size=(50, 6)), 9 * r.normal(size=(50, 6)), r.normal(size=(50, 12))
    for conf in (None, r.random(50)):
        got, there = at.attend(frames, q, frames, k, v, reach, heads, None if conf is None else (conf, conf), block)
        assert there.all() and np.allclose(got, plain(frames, q, k, v, reach, heads, conf), rtol=1e-11, atol=1e-12)


def test_merging_is_in_any_order():
    r = np.random.default_rng(1)
    scores, values = 300 * r.normal(size=(4, 2, 30)), r.normal(size=(30, 2, 3))
    whole = at.Running.of(scores, values).result()[0]
    cuts = [slice(0, 7), slice(7, 8), slice(8, 30)]
    for order in ([0, 1, 2], [2, 0, 1], [1, 2, 0]):
        run = at.Running(4, 2, 3)
        for c in order:
            run.merge(at.Running.of(scores[:, :, cuts[c]], values[cuts[c]]))
        assert np.allclose(run.result()[0], whole)
    none = at.Running(2, 1, 1).merge(at.Running.of(np.full((2, 1, 3), -np.inf), np.ones((3, 1, 1))))
    assert not none.result()[1].any()


@pytest.mark.parametrize("tile", [5, 2048])
def test_tables(spark, tile):
    r = np.random.default_rng(2)
    n = 60
    frames = r.integers(-30, 30, n)
    q, k, v, conf = r.normal(size=(n, 4)), r.normal(size=(n, 4)), r.normal(size=(n, 2)), r.random(n)
    rows = [("a" if i % 2 else "b", int(frames[i]), i, q[i].tolist(), k[i].tolist(), v[i].tolist(), float(conf[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, f int, i int, q array<double>, k array<double>, v array<double>, conf double")
    got = sorted((x["g"], x["f"], [round(o, 9) for o in x["out"]]) for x in at.temporal_attention(df, ["g"], "f", 6, 2, "conf", tile).collect())
    want = []
    for g in "ab":
        own = [i for i in range(n) if rows[i][0] == g]
        out = plain(frames[own], q[own], k[own], v[own], 6, 2, conf[own])
        want += [(g, int(frames[i]), [round(o, 9) for o in row]) for i, row in zip(own, out.tolist())]
    assert got == sorted(want)
    plan = at.temporal_attention(df, ["g"], "f", 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_odd_rows(spark):
    rows = [("a", 0, [1.0], [1.0], [2.0], None), ("a", 1, None, [1.0], [4.0], 1.0), ("a", 2, [1.0], None, [9.0], 1.0), ("a", 50, [1.0], None, None, 1.0), ("a", None, [1.0], [1.0], [1.0], 1.0), (None, 3, [0.0], [0.0], [7.0], 1.0), ("a", 3, [None], [1.0], [6.0], 1.0)]
    df = spark.createDataFrame(rows, "g string, f int, q array<double>, k array<double>, v array<double>, conf double")
    got = {(r["g"], r["f"]): r["out"] for r in at.temporal_attention(df, ["g"], "f", 1).collect()}
    assert got == {("a", 0): [3.0], ("a", 1): None, ("a", 2): [5.0], ("a", 50): None, (None, 3): [7.0], ("a", 3): None}
    # a confidence of 0 still leaves its logarithm of 1e-6
    assert {r["f"]: r["out"] for r in at.temporal_attention(df, ["g"], "f", 0, conf="conf").collect()}[0] == [2.0]
    with pytest.raises(Exception, match="heads"):
        at.temporal_attention(df, ["g"], "f", 1, heads=2).collect()
