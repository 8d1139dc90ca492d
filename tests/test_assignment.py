"""Assignments that begin with bids, and cameras matched without rows for pairs."""

from __future__ import annotations

from dataclasses import replace
from itertools import permutations

import numpy as np
import pytest

from posegrid.config import DEFAULT
from posegrid.operators import assignment as asg
from posegrid.operators import reid

SCHEMA = "scene_id string, video_id int, person_id long, descriptor array<double>"


@pytest.mark.parametrize("bids", [0, 1, 8])
@pytest.mark.parametrize("ties", [False, True])
def test_best_total(monkeypatch, bids, ties):
    monkeypatch.setattr(asg, "BIDS", bids)
    r = np.random.default_rng(bids)
    for n, m in [(1, 1), (1, 4), (4, 1), (2, 5), (5, 5), (6, 4), (6, 6)] * 8:
        s = r.integers(-2, 3, (n, m)).astype(float) if ties else r.normal(size=(n, m))
        i, j = asg.assign(s)
        assert len(set(i)) == len(set(j)) == min(n, m)
        t = s if n <= m else s.T
        want = max(sum(t[k, p] for k, p in enumerate(own)) for own in permutations(range(t.shape[1]), len(t)))
        assert abs(s[i, j].sum() - want) < 1e-9


def test_matrix_not_held():
    r = np.random.default_rng(5)
    for n, m in ((40, 60), (60, 40), (50, 50)):
        x, y = r.normal(size=(n, 8)), r.normal(size=(m, 8))
        assert [k.tolist() for k in asg.assign_vectors(x, y, 0)] == [k.tolist() for k in asg.assign(x @ y.T)]


def test_galleries_match_as_pairs_do(spark, monkeypatch):
    r = np.random.default_rng(9)
    rows = [(s, v, p, r.normal(size=6).tolist()) for s in "st" for v in range(3) for p in range(5 + 4 * v)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    cfg = replace(DEFAULT, cross_view_threshold=0.1)
    seen = lambda df: sorted((*x[:-1], round(x[-1], 9)) for x in df.select("scene_id", "video_a", "video_b", "person_a", "person_b", "sim").collect())
    assert seen(reid.match_galleries(df, cfg)) == seen(reid.match_cameras(reid.cosine_pairs(df), cfg))


def test_no_pair_rows_and_odd_vectors(spark):
    rows = [("s", 0, 1, [1.0, 0.0]), ("s", 0, 2, None), ("s", 0, 3, [float("nan"), 1.0]), ("s", 1, 4, [1.0, 0.1]), ("s", 1, 5, [1.0, None]), ("s", 1, 6, [1.0, 0.0, 0.0]), ("t", 0, 1, [1.0, 0.0])]
    df = reid.match_galleries(spark.createDataFrame(rows, SCHEMA), replace(DEFAULT, cross_view_threshold=0.0))
    assert [(x.scene_id, x.person_a, x.person_b) for x in df.collect()] == [("s", 1, 4)]


def test_ids_without_pair_rows(spark, monkeypatch):
    """Descriptors become ids without a pass over pairs."""
    monkeypatch.setattr(reid, "cosine_pairs", None)
    rows = [("s", v, p, [1.0, float(p)]) for v in range(3) for p in range(4)]
    got = {(x.video_id, x.person_id): x.global_id for x in reid.match_across_views(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(v, p): p for v in range(3) for p in range(4)}
