"""Start times from pairs: the matrix, and conjugate gradients as joins, against lstsq."""

from __future__ import annotations

import numpy as np
import pytest

from posegrid.operators import starts

SCHEMA = "scene_id string, i int, j int, off double"


def graph(seed: int, cams: int, pairs: int, parts: int = 1, noise: float = 0.5) -> list[tuple]:
    """Each part is connected; offsets do not quite agree."""
    r = np.random.default_rng(seed)
    true, part = r.normal(0, 30, cams), np.arange(cams) % parts
    rows = [(k, k + parts) for k in range(cams - parts)] + [(int(a), int(b)) for a, b in r.integers(0, cams, (pairs, 2)) if part[a] == part[b]]
    return [(f"s{seed}", a, b, float(true[b] - true[a] + noise * r.normal())) for a, b in rows]


def dense(rows: list[tuple]) -> dict:
    out = {}
    for scene in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == scene and None not in r and r[1] != r[2]]
        cams = sorted({c for _, i, j, _ in own for c in (i, j)})
        at = {c: k for k, c in enumerate(cams)}
        a = np.zeros((len(own), len(cams)))
        for n, (_, i, j, _) in enumerate(own):
            a[n, at[i]], a[n, at[j]] = -1, 1
        t = np.linalg.lstsq(a, np.array([r[3] for r in own]), rcond=None)[0] if own else np.zeros(0)
        part = list(range(len(cams)))
        for _, i, j, _ in own:
            low, high = sorted((part[at[i]], part[at[j]]))
            part = [low if p == high else p for p in part]
        t = t - t[part] if own else t
        out |= {(scene, c): v - min(0, t.min()) for c, v in zip(cams, t)}
    return out


@pytest.mark.parametrize("small", [1024, 0])
def test_both_ways_are_least_squares(spark, small):
    rows = graph(1, 12, 30) + graph(2, 13, 20, parts=3) + graph(3, 2, 0) + graph(4, 6, 0, noise=0) + [("s1", 3, 3, 9.0), ("s1", None, 4, 1.0), ("s2", 5, 8, None), ("s5", 1, 1, 2.0)]
    got = {(r["scene_id"], r["cam"]): r["start"] for r in starts.start_times(spark.createDataFrame(rows, SCHEMA), ["scene_id"], small=small).collect()}
    want = dense(rows)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert starts.start_times(spark.createDataFrame([], SCHEMA), ["scene_id"], small=small).count() == 0


def test_many_cameras(spark):
    """No matrix: scenes above the limit go by joins; the residual is that of a solution."""
    cams, n = 2000, 60_000
    rows = graph(7, cams, n, parts=2)
    got = {r["cam"]: r["start"] for r in starts.start_times(spark.createDataFrame(rows, SCHEMA), ["scene_id"]).collect()}
    i, j, off = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    t = np.array([got[c] for c in range(cams)])
    slope = np.zeros(cams)
    own = i != j
    np.add.at(slope, j[own], (t[j] - t[i] - off)[own])
    np.add.at(slope, i[own], -(t[j] - t[i] - off)[own])
    assert np.abs(slope).max() < 1e-4 and abs(t[0] - t[1]) < 1e-9 and t.min() == 0


def test_too_few_steps_are_an_error(spark):
    with pytest.raises(ArithmeticError):
        starts.start_times(spark.createDataFrame(graph(1, 30, 20), SCHEMA), ["scene_id"], small=0, steps=2)
