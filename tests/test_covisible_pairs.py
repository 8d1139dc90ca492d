"""Pairs seen together by blocks against a plain count."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from posegrid.operators import covisible
from posegrid.operators.tracks import covisible_pairs


def plain(rows: list[tuple], least: int) -> list[tuple]:
    frames: dict = {}
    for v, f, p in rows:
        if None not in (v, f, p):
            frames.setdefault((v, f), set()).add(p)
    count = Counter((v, a, b) for (v, _), own in frames.items() for a, b in combinations(sorted(own), 2))
    return sorted((*k, n) for k, n in count.items() if n >= least)


@pytest.mark.parametrize("rows,block,step", [(1 << 17, 2048, 1 << 22), (40, 4, 3), (7, 1, 1), (300, 3, 50)])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_counts(spark, rows, block, step, kind):
    r = np.random.default_rng(4)
    own = [(v, int(r.integers(-9, 12)), p if kind == "long" else f"p{p}") for v in "xyz" for p in r.integers(-5, 20, 110).tolist()]
    own += [("x", None, own[0][2]), (None, 1, own[0][2]), ("x", 1, None)]
    df = spark.createDataFrame(own, f"video_id string, frame_idx int, person_id {kind}").repartition(3)
    got = covisible_pairs(df, rows=rows, block=block, step=step)
    assert sorted(map(tuple, got.collect())) == plain(own, 3)


def test_no_rows_for_pairs(spark):
    """A crowd of 400 in one frame has 79,800 pairs: none of them leaves a task."""
    df = spark.range(400).selectExpr("'v' AS video_id", "1 AS frame_idx", "id AS person_id")
    got = covisible_pairs(df, rows=100, block=32)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 0
    assert covisible_pairs(df.where("id < 0")).count() == 0


def test_steps_do_not_matter():
    r = np.random.default_rng(2)
    side = covisible.Side(r.integers(0, 8, 60), r.integers(0, 9, 60), 8)
    a = side.blocks[0]
    assert (covisible.together(a, a, 8, 1) == covisible.together(a, a, 8, 1000)).all()
