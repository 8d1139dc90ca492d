"""Queries over whole views, and operators without SQL against brute force."""

from __future__ import annotations

import math
from dataclasses import replace
from itertools import permutations

import numpy as np
import pytest

from posegrid.config import DEFAULT
from posegrid.operators import losses as lo
from posegrid.operators import reid
from posegrid.plans import catalogue
from posegrid.sources import adapters as ad


@pytest.mark.parametrize("name", ["quat_to_matrix_all", "camera_centres_all", "sixd_roundtrip_all", "axis_angle_roundtrip_all", "softplus_focal_all", "vector_attention_all"])
def test_a_row_for_each_vector(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() == ad.table(spark, sf_dir, "embeddings").count()


def test_windows_read_every_frame(spark, sf_dir):
    windows = {(r["video_id"], r["window_start"]) for r in catalogue.queries()["window_counts_all"](spark, sf_dir).collect()}
    seen = {(v, k) for v, s in windows for k in range(s, s + 128)}
    assert {(r["video_id"], r["frame_idx"]) for r in ad.detections(spark, sf_dir).collect()} <= seen


def matrix(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_epipolar_loss_of_all_points(spark, sf_dir):
    points, want = {}, {}
    for r in ad.joints(spark, sf_dir).collect():
        points.setdefault(r["scene_id"], []).append((r["x"], r["y"], r["z"] + 3))
    cameras: dict = {}
    for r in ad.cameras(spark, sf_dir).orderBy("cam").collect():
        f = math.log1p(math.exp(-abs(r["focal_raw"]))) + max(r["focal_raw"], 0)
        k = np.array([[f, 0, 320.0], [0, f, 240.0], [0, 0, 1]])
        cameras.setdefault(r["scene_id"], []).append((matrix([r[c] for c in ("qw", "qx", "qy", "qz")]), np.array([r["tx"], r["ty"], r["tz"]]), k))
    for scene, own in cameras.items():
        x, found = np.array(points[scene]), []
        for i, (ri, ti, ki) in enumerate(own):
            for rj, tj, kj in own[i + 1 :]:
                rel = rj @ ri.T
                t = tj - rel @ ti
                skew = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])
                fund = np.linalg.inv(kj).T @ skew @ rel @ np.linalg.inv(ki)
                ci, cj = x @ ri.T + ti, x @ rj.T + tj
                image = lambda c, k: np.stack([k[0, 0] * c[:, 0] / (c[:, 2] + 1e-8) + 320, k[1, 1] * c[:, 1] / (c[:, 2] + 1e-8) + 240, np.ones(len(c))], 1)
                residual = np.abs(np.einsum("pi,ij,pj->p", image(cj, kj), fund, image(ci, ki)))
                found.append(residual[(ci[:, 2] > 0) & (cj[:, 2] > 0)])
        found = np.concatenate(found)
        if len(found):
            want[scene] = (found.mean(), len(found))
    got = {r["scene_id"]: (r["loss"], r["n"]) for r in catalogue.queries()["epipolar_loss"](spark, sf_dir).collect()}
    assert {k: n for k, (_, n) in got.items()} == {k: n for k, (_, n) in want.items()}
    # residuals of exact projections are rounding errors, so they are compared in size only
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 for k in got)


def test_epipolar_loss_by_hand(spark):
    """Unit focal length, the second camera moved by (1, 0, 0): no residual for exact projections."""
    names = "scene_id int, cam int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, focal_raw double"
    one = math.log(math.e - 1)
    cameras = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, one), (0, 1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, one)], names)
    points = spark.createDataFrame([(0, 1.0, 2.0, 4.0), (0, -1.0, 1.0, 2.0), (0, 0.0, 0.0, -1.0)], "scene_id int, x double, y double, z double")
    r = lo.epipolar_loss(points, cameras, 0.0, 0.0).first()
    assert r["n"] == 2 and r["loss"] < 1e-8


@pytest.mark.parametrize("na,nb", [(3, 3), (4, 5), (5, 2), (1, 4)])
def test_assignment_is_the_best_of_all(spark, na, nb):
    sims = np.random.default_rng(10 * na + nb).uniform(-1, 1, (na, nb))
    rows = [(0, 0, a, 1, b, float(sims[a, b])) for a in range(na) for b in range(nb)]
    df = spark.createDataFrame(rows, "scene_id int, video_a int, person_a long, video_b int, person_b long, sim double")
    wide = sims if na <= nb else sims.T
    best = max(permutations(range(wide.shape[1]), wide.shape[0]), key=lambda p: sum(wide[k, x] for k, x in enumerate(p)))
    pairs = {(k, x) if na <= nb else (x, k) for k, x in enumerate(best)}
    for least in (-1.0, 0.25):
        got = {(r["person_a"], r["person_b"]) for r in reid.match_cameras(df, replace(DEFAULT, cross_view_threshold=least)).collect()}
        assert got == {(a, b) for a, b in pairs if sims[a, b] >= least}


def test_attention_by_brute_force(spark):
    r = np.random.default_rng(4)
    q, k, v = r.normal(0, 3, (2, 5, 8)), r.normal(0, 3, (2, 7, 8)), r.normal(0, 1, (2, 7, 3))
    queries = spark.createDataFrame([(g, i, q[g, i].tolist()) for g in range(2) for i in range(5)], "scene_id int, q_id int, q array<double>")
    keys = spark.createDataFrame([(g, k[g, i].tolist(), v[g, i].tolist()) for g in range(2) for i in range(7)], "scene_id int, k array<double>, v array<double>")
    got = {(x["scene_id"], x["q_id"]): x["out"] for x in lo.vector_attention(queries, keys, ["scene_id"]).collect()}
    assert len(got) == 10
    for (g, i), out in got.items():
        e = np.exp(k[g] @ q[g, i] / math.sqrt(8))
        assert np.allclose(out, (e / e.sum()) @ v[g])
