"""Dynamic time warping in little memory against the whole matrix."""

from __future__ import annotations

import resource
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from posegrid.operators import sync as sy
from posegrid.operators import warping as wp


def whole(cost: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    total = sy.accumulate(cost)
    return total[-1, -1], sy.path(total)


def of(cost: np.ndarray) -> wp.Costs:
    return lambda k, a, b: cost[np.arange(a, b + 1) - 1, k - np.arange(a, b + 1) - 1]


@pytest.mark.parametrize("every", [1, 2, 3, 7, 50, None])
def test_path_is_that_of_the_whole_matrix(every):
    r = np.random.default_rng(every or 0)
    for n, m in [(1, 1), (1, 9), (9, 1), (2, 2), (5, 40), (40, 5), (31, 33), (80, 80), (120, 70)]:
        walk = lambda t: np.cumsum(r.normal(size=t))  # noqa: B023, E731
        for cost in (
            (walk(n)[:, None] - walk(m)[None]) ** 2,
            r.integers(0, 3, (n, m)).astype(float),  # many ties
            np.zeros((n, m)),
            np.round(np.abs(walk(n)[:, None] - walk(m)[None])),
        ):
            total, rows, cols = wp.warp(n, m, of(cost), every)
            want, path = whole(cost)
            assert total == want and [*zip(rows.tolist(), cols.tolist())] == path


def test_costs_of_a_diagonal_are_those_of_the_matrix():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(13, 5, 4)), r.normal(size=(17, 5, 4))
    x[..., 3], y[..., 3] = np.abs(x[..., 3]), 0
    matrix = wp.joint_costs(x[:, None], y[None], 2.0)
    costs = wp.pose_costs(x, y, 2.0)
    for k in range(2, 31):
        a, b = max(1, k - 17), min(13, k - 1)
        assert np.array_equal(costs(k, a, b), of(matrix)(k, a, b))
    u, v = r.normal(size=13), r.normal(size=17)
    assert np.array_equal(wp.value_costs(u, v)(12, 1, 11), of((u[:, None] - v[None]) ** 2)(12, 1, 11))


def test_empty_recordings():
    assert wp.warp(0, 5, of(np.zeros((0, 5))))[0] == float("inf") and len(wp.warp(5, 0, of(np.zeros((5, 0))))[1]) == 0


def test_memory_of_long_recordings():
    """3,000 frames of 70 joints each, in a process of its own that says how far it grew."""
    code = """
import resource, numpy as np
from posegrid.operators import warping as wp
r = np.random.default_rng(1)
x = np.cumsum(r.normal(0, .05, (3020, 70, 4)), 0); x[..., 3] = 1
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
total, i, j = wp.warp(3000, 3000, wp.pose_costs(x[:3000], x[20:], 2.0))
print(wp.most_common(j - i), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parent.parent, check=True).stdout.split()
    assert int(out[0]) == -20 and float(out[1]) < 100
    assert resource.RUSAGE_SELF == 0


def test_rows_with_gaps(spark):
    """Missing joints, null numbers, frames that share no joint, recordings of one person only."""
    rows = [("s", 1, v, f, j, float(f + j), 0.5 * f, 1.0, c) for v in ("a", "b") for f in range(4) for j, c in ((0, 1.0), (1, 0.5)) if (v, f, j) != ("a", 2, 1)]
    rows += [("s", 1, "a", 4, 7, 0.0, 0.0, 0.0, 1.0), ("s", 1, "b", 4, 0, None, 0.0, 0.0, 1.0), ("s", 2, "a", 0, 0, 0.0, 0.0, 0.0, 1.0), ("t", 1, "c", 0, 0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "scene_id string, person_id long, video_id string, frame_idx int, joint int, x double, y double, z double, conf double")
    got = {(r["frame_a"], r["frame_b"]): r["cost"] for r in sy.cost_matrix(df).collect()}
    seen = {(v, f, j): (x, y, z, c) for _, p, v, f, j, x, y, z, c in rows if p == 1 and x is not None}
    want = {}
    for f in range(5):
        for g in range(5):
            both = [(seen["a", f, j], seen["b", g, j]) for j in (0, 1, 7) if ("a", f, j) in seen and ("b", g, j) in seen]
            if both:
                w = [p[3] * q[3] for p, q in both]
                want[f, g] = (sum(u * np.linalg.norm(np.subtract(p[:3], q[:3])) for u, (p, q) in zip(w, both)) / (sum(w) + 1e-8)) ** 2
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    found = sy.warp_sequences(df).collect()
    assert [(r["scene_id"], r["person_id"], r["video_a"], r["video_b"], r["offset"]) for r in found] == [("s", 1, "a", "b", 0)]
    assert sy.cost_matrix(df.limit(0)).count() == 0 == sy.warp_sequences(df.where("scene_id = 't'")).count()
