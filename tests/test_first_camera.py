"""Orientations and truths in the first camera's frame, and the loss terms, against numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from posegrid.operators import alignment as al
from posegrid.operators import losses as lo


def turn(v) -> np.ndarray:
    a = np.linalg.norm(v)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + (k if a < 1e-8 else np.sin(a) / a * k + (1 - np.cos(a)) / a**2 * k @ k)


def quat(w, x, y, z) -> np.ndarray:
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def cameras(r, n):
    out = []
    for c in range(n):
        q = r.normal(size=4)
        out.append(("s", c, *map(float, q / np.linalg.norm(q)), *map(float, r.normal(size=3)), 3.0))
    return out


CAMERAS = "scene_id string, cam int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, focal_raw double"


def test_orientations(spark):
    r = np.random.default_rng(1)
    cams = cameras(r, 4)
    rows = [("s", c, k, r.normal(size=3).tolist()) for c in range(4) for k in range(5)] + [("s", 1, 9, None), ("s", 1, 10, [0.0, 0.0, 0.0]), ("t", 0, 1, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "scene_id string, cam int, k int, global_orient array<double>")
    poses = {c[1]: quat(*c[2:6]) for c in cams}
    got = {(x["cam"], x["k"]): x["global_orient"] for x in al.orientations_to_first_camera(df, spark.createDataFrame(cams, CAMERAS)).collect()}
    assert len(got) == 22 and got[1, 9] is None  # a scene without cameras drops out
    for _, c, k, v in rows[:-1]:
        if v is not None:
            assert np.allclose(turn(got[c, k]), poses[0] @ poses[c].T @ turn(v), atol=1e-9)


def test_truth(spark):
    r = np.random.default_rng(2)
    cams = cameras(r, 2)
    rows = [("s", k, r.normal(size=3).tolist(), r.normal(size=3).tolist()) for k in range(4)] + [("s", 9, None, None)]
    got = {x["k"]: x for x in al.truth_to_first_camera(spark.createDataFrame(rows, "scene_id string, k int, global_orient array<double>, transl array<double>"), spark.createDataFrame(cams, CAMERAS)).collect()}
    pose, t = quat(*cams[0][2:6]), np.array(cams[0][6:9])
    for _, k, v, p in rows[:-1]:
        assert np.allclose(turn(got[k]["global_orient"]), pose @ turn(v), atol=1e-9) and np.allclose(got[k]["transl"], pose @ np.array(p) + t)
    assert got[9]["global_orient"] is None and got[9]["transl"] is None


def test_loss_terms(spark):
    r = np.random.default_rng(3)
    pred, gt = r.normal(size=(3, 2, 4)), r.normal(size=(3, 2, 4))
    rows = [("s", c, p, d, float(pred[c, p, d]), float(gt[c, p, d])) for c in range(3) for p in range(2) for d in range(4)]
    got = {x["name"]: x["loss"] for x in lo.shape_losses(spark.createDataFrame(rows, "scene_id string, cam int, person_id int, dim int, pred double, gt double")).collect()}
    assert math.isclose(got["shape"], ((pred.mean(0) - gt.mean(0)) ** 2).mean()) and math.isclose(got["beta"], ((pred - pred.mean(0)) ** 2).mean())
    points = spark.createDataFrame([("s", 0.1 * k, 0.2, 5.0) for k in range(5)], "scene_id string, x double, y double, z double")
    one = spark.createDataFrame(cameras(r, 1), CAMERAS)
    assert lo.epipolar_term(points, one, 320.0, 240.0).count() == 0  # a single camera has no pair
    still = [("s", c, 1.0, 0.0, 0.0, 0.0, 0.3 * c, 0.0, 0.0, 3.0) for c in range(3)]
    found = lo.epipolar_term(points, spark.createDataFrame(still, CAMERAS), 320.0, 240.0).first()
    assert found["name"] == "epipolar" and abs(found["loss"]) < 1e-6  # exact cameras fulfil the constraint
    samples = spark.createDataFrame([("k", s, float(s), 0.0) for s in range(3) for _ in range(4)], "g string, s int, mu double, logvar double")
    assert math.isclose(lo.kl_loss(samples, "mu", "logvar", ["s"], ["g"]).first()["kl"], 0.5 * 4 * np.mean([0, 1, 4]))
    assert lo.kl_loss(samples.where(F.lit(False)), "mu", "logvar", ["s"]).first()["kl"] is None


def test_evaluation_points(spark):
    """Keypoints with roots, vertices where a person has none at all, no filtering, as many points as both have."""
    nan = float("nan")
    rows = [
        ("s", "a", 1, 0, [0.0, 0.0, 0.0, 1.0, 2.0, 3.0, nan, 0.0, 0.0], [1.0, 1.0, 1.0], [9.0] * 6),
        ("s", "a", 1, 1, None, [1.0, 1.0, 1.0], [9.0] * 6),  # it has keypoints elsewhere
        ("s", "b", 1, 0, None, None, [5.0, 5.0, 5.0, 6.0, 6.0, 6.0]),
        ("s", "b", 1, 1, None, None, [5.0, 5.0, 5.0]),
        ("s", "b", 2, 0, [7.0, 8.0, 9.0], None, None),
        ("s", "b", 3, 0, None, None, None),
        ("s", "b", 3, 1, [], None, []),
    ]
    df = spark.createDataFrame(rows, "scene_id string, video_id string, person_id long, frame_idx int, pred_keypoints_3d array<double>, pred_cam_t array<double>, vertices array<double>")
    points = al.evaluation_points(df)
    got = sorted((r["video_id"], r["person_id"], r["frame_idx"], r["joint"], str(r["x"]), r["y"], r["z"]) for r in points.collect())
    assert got == [("a", 1, 0, 0, "1.0", 1.0, 1.0), ("a", 1, 0, 1, "2.0", 3.0, 4.0), ("a", 1, 0, 2, "nan", 1.0, 1.0), ("b", 1, 0, 0, "5.0", 5.0, 5.0), ("b", 1, 0, 1, "6.0", 6.0, 6.0), ("b", 1, 1, 0, "5.0", 5.0, 5.0), ("b", 2, 0, 0, "7.0", 8.0, 9.0)]
    pairs = al.correspondences(points).collect()
    assert sorted((r["joint"], r["ax"], r["bx"]) for r in pairs) == [(0, 1.0, 5.0), (1, 2.0, 6.0)]
    assert al.evaluation_points(df.drop("vertices", "pred_cam_t")).count() == 4
