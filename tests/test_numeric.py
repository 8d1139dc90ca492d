"""Operators that SQL cannot express, against plain numpy versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.config import DEFAULT
from posegrid.functions import rot, vec
from posegrid.operators import alignment as al
from posegrid.operators import metrics as me
from posegrid.operators import reid, windows
from posegrid.operators import sync as sy


def horn(a: np.ndarray, b: np.ndarray, with_scale: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """Best rotation, translation and scale from a to b by the greatest eigenvector of a 4 x 4 matrix."""
    ca, cb = a - a.mean(0), b - b.mean(0)
    s = ca.T @ cb
    z = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
    n = np.block([[np.array([[np.trace(s)]]), z[None]], [z[:, None], s + s.T - np.trace(s) * np.eye(3)]])
    w, x, y, q = np.linalg.eigh(n)[1][:, -1]
    r = np.array([[1 - 2 * (y * y + q * q), 2 * (x * y - w * q), 2 * (x * q + w * y)], [2 * (x * y + w * q), 1 - 2 * (x * x + q * q), 2 * (y * q - w * x)], [2 * (x * q - w * y), 2 * (y * q + w * x), 1 - 2 * (x * x + y * y)]])
    scale = float((cb * (ca @ r.T)).sum() / (ca**2).sum()) if with_scale else 1.0
    return r, b.mean(0) - scale * r @ a.mean(0), scale


def turned(r: np.random.Generator) -> np.ndarray:
    q, _ = np.linalg.qr(r.normal(0, 1, (3, 3)))
    return q * np.sign(np.linalg.det(q))


def groups(seed: int, n: int = 40) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    r = np.random.default_rng(seed)
    out = {}
    for g in range(6):
        a = r.normal(0, 2, (n, 3)) + r.normal(0, 50, 3)
        b = r.uniform(0.5, 2) * a @ turned(r).T + r.normal(0, 5, 3) + r.normal(0, 0.2, (n, 3))
        if g == 5:  # a reflection: the best rotation is far from fitting
            b = a * np.array([1, 1, -1])
        out[g] = a, b
    return out


def table(spark, found: dict, per: int = 10):
    rows = [(g, i // per, i % per, *map(float, a), *map(float, b)) for g, (x, y) in found.items() for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "scene_id int, person_id int, joint int, ax double, ay double, az double, bx double, by double, bz double")


@pytest.mark.parametrize("with_scale", [False, True])
def test_rigid_and_similarity_alignment(spark, with_scale):
    found = groups(3)
    fits = al.poses(al.sums(table(spark, found), ["scene_id"]), with_scale)
    assert fits.columns == ["scene_id", "n", "rotation", "translation", "scale"]
    for f in fits.collect():
        r, t, s = horn(*found[f["scene_id"]], with_scale)
        assert np.allclose(np.array(f["rotation"]).reshape(3, 3), r, atol=1e-6) and np.allclose(f["translation"], t, atol=1e-4) and math.isclose(f["scale"], s, rel_tol=1e-7)
        assert np.linalg.det(np.array(f["rotation"]).reshape(3, 3)) > 0


def test_sums_of_small_groups_make_those_of_large_ones(spark):
    points = table(spark, groups(3))
    whole = {r["scene_id"]: r.asDict() for r in al.sums(points, ["scene_id"]).collect()}
    got = {r["scene_id"]: r.asDict() for r in al.merged(al.sums(points, ["scene_id", "person_id"]), ["scene_id"]).collect()}
    assert got.keys() == whole.keys()
    for g, row in whole.items():
        assert row["n"] == got[g]["n"] and all(math.isclose(row[c], got[g][c], rel_tol=1e-9, abs_tol=1e-9) for c in row if c != "scene_id")


def test_group_keys_keep_their_names(spark):
    """Keys that begin like the names of sums stay."""
    rows = table(spark, groups(4)).withColumnsRenamed({"scene_id": "video_id", "person_id": "model"})
    fits = al.poses(al.sums(rows, ["video_id", "model"]), least=3)
    assert fits.columns[:2] == ["video_id", "model"] and fits.count() == 24


def test_reports_of_pairs(spark):
    found = groups(5)
    points = table(spark, {**found, 9: tuple(x[:20] for x in found[0])}).withColumnsRenamed({"person_id": "p"}).withColumns({"video_a": F.lit(0), "video_b": F.lit(1)})
    report = {r["scene_id"]: r for r in al.pair_report(points).collect()}
    assert report[9]["n"] == 20 and report[9]["rmse"] is None and report[9]["t_length"] is None
    assert 9 not in {r["scene_id"] for r in al.pair_report(points, keep_small=False).collect()}
    for g, (a, b) in found.items():
        r, t, _ = horn(a, b, False)
        far = ((b - a @ r.T - t) ** 2).sum(1)
        assert math.isclose(report[g]["rmse"], math.sqrt(far.mean()), rel_tol=1e-6) and math.isclose(report[g]["t_length"], np.linalg.norm(t), rel_tol=1e-6)


def distances(a, b, fit_a, fit_b, with_scale):
    r, t, s = horn(fit_a, fit_b, with_scale)
    return np.linalg.norm(b - s * a @ r.T - t, axis=1)


def test_position_metrics(spark):
    joints, centres = groups(6), {g: (a[:6], b[:6]) for g, (a, b) in groups(7).items()}
    points, cams = table(spark, joints), table(spark, centres)
    value = lambda df: {r["scene_id"]: r["value"] for r in df.collect()}
    got = {
        "w": value(me.w_mpjpe(points, cams)), "ga": value(me.ga_mpjpe(points)), "pa": value(me.pa_mpjpe(points)), "te": value(me.translation_error(cams, False)),
        "s_te": value(me.translation_error(cams, True)), "cca": value(me.centre_accuracy(cams, False)), "s_cca": value(me.centre_accuracy(cams, True)),
    }
    together = {n: value(df) for n, df in me.position_metrics(points, cams).items()}
    for n in ("w", "ga", "pa"):
        assert together[f"{n}_mpjpe"].keys() == got[n].keys() and all(math.isclose(together[f"{n}_mpjpe"][g], v, rel_tol=1e-9) for g, v in got[n].items())
    for g, (a, b) in joints.items():
        ca, cb = centres[g]
        scale = np.linalg.norm(cb - cb.mean(0), axis=1).max()
        want = {
            "w": distances(a, b, ca, cb, False).mean(), "ga": distances(a, b, a, b, True).mean(),
            "pa": np.mean([distances(a[k : k + 10], b[k : k + 10], a[k : k + 10], b[k : k + 10], True).mean() for k in range(0, 40, 10)]),
            "te": distances(ca, cb, ca, cb, False).mean(), "s_te": distances(ca, cb, ca, cb, True).mean(),
            "cca": (distances(ca, cb, ca, cb, False) <= 0.15 * scale).mean(), "s_cca": (distances(ca, cb, ca, cb, True) <= 0.15 * scale).mean(),
        }
        for name, w in want.items():
            assert math.isclose(got[name][g], w, rel_tol=1e-5, abs_tol=1e-7), (name, g)


def angle(a: np.ndarray, b: np.ndarray) -> float:
    return math.degrees(math.acos(max(-1.0, min(1.0, (np.trace(a.T @ b) - 1) / 2))))


def test_rotation_metrics(spark):
    r = np.random.default_rng(8)
    data = {(s, p, f, j): (turned(r), turned(r)) for s in range(2) for p in range(2) for f in range(2) for j in range(3)}
    df = spark.createDataFrame([(*k, x.ravel().tolist(), y.ravel().tolist()) for k, (x, y) in data.items()], "scene_id int, person_id int, frame_idx int, joint int, pred array<double>, gt array<double>")
    correction = {s: turned(r) for s in range(2)}
    c = spark.createDataFrame([(s, m.ravel().tolist()) for s, m in correction.items()], "scene_id int, rotation array<double>")

    def mean(s, fix):
        return np.mean([angle(fix(k) @ x if k[3] == 0 else x, y) for k, (x, y) in data.items() if k[0] == s])

    for row in me.w_mpjre(df, c).collect():
        assert math.isclose(row["value"], mean(row["scene_id"], lambda k: correction[k[0]]), rel_tol=1e-9)

    def nearest(s):
        u, _, vt = np.linalg.svd(sum(y @ x.T for k, (x, y) in data.items() if k[0] == s and k[3] == 0))
        return u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt

    for row in me.ga_mpjre(df).collect():
        assert math.isclose(row["value"], mean(row["scene_id"], lambda k: nearest(k[0])), rel_tol=1e-9)
    for row in me.pa_mpjre(df).collect():
        per = [np.mean([0.0 if k[3] == 0 else angle(x, y) for k, (x, y) in data.items() if k[:2] == (row["scene_id"], p)]) for p in range(2)]
        assert math.isclose(row["value"], np.mean(per), rel_tol=1e-6, abs_tol=1e-6)


def test_rotation_conventions(spark):
    """A quarter turn about z: matrix by rows, six numbers as two columns, quaternion with w first."""
    h = math.pi / 2
    m = rot.axis_angle_to_matrix([F.lit(0.0), F.lit(0.0), F.lit(h)])
    r = spark.range(1).select(F.array(*m).alias("m"), F.array(*rot.matrix_to_sixd(m)).alias("six")).first()
    assert np.allclose(r["m"], [0, -1, 0, 1, 0, 0, 0, 0, 1], atol=1e-12)
    assert np.allclose(r["six"], [0, 1, 0, -1, 0, 0], atol=1e-12)


def test_moving_descriptor(spark):
    r = np.random.default_rng(9)
    x = r.normal(0, 1, (12, 5))
    df = spark.createDataFrame([(k % 2, k, v.tolist()) for k, v in enumerate(x)], "p int, t int, v array<double>")
    for row in reid.moving_descriptor(df, ["p"], "t", "v").collect():
        g = None
        for v in x[row["p"] :: 2]:
            g = v / np.linalg.norm(v) if g is None else (lambda y: y / np.linalg.norm(y))(DEFAULT.ema_alpha * g + (1 - DEFAULT.ema_alpha) * v)
        assert np.allclose(row["descriptor"], g)


def test_random_crops_stay_inside(spark):
    rows = windows.random_crop(spark.range(1, 400).selectExpr("id AS video_id", "CAST(id % 90 AS INT) AS num_frames")).collect()
    assert len(rows) == len([k for k in range(1, 400) if k % 90])
    for r in rows:
        n = r["num_frames"]
        assert 0 <= r["crop_start"] <= min(30, n - 1) and max(n - 30, r["crop_start"] + 1) <= r["crop_stop"] <= n
    assert len({r["crop_start"] for r in rows}) > 20


def test_fold_by_scenes():
    x, y = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    f = reid.Fold(set())
    assert f.frame([(1, x), (2, y)]) == [1, 2]
    for _ in range(DEFAULT.retry_window):
        f.frame([(1, x), (2, y)])
    assert sorted(f.gallery) == [1, 2]
    # person 1 comes back as 7 and takes its old id, at once and from then on
    assert f.frame([(2, y), (7, x)]) == [2, 1] and f.frame([(7, x)]) == [1]
    # one who is in the frame cannot be taken; nor one who was seen together with the newcomer
    assert f.frame([(7, x), (8, x)]) == [1, 8]
    g = reid.Fold({frozenset((1, 9))})
    g.frame([(1, x)])
    assert g.frame([(9, x)]) == [9]
    # without a feature an id stays as it is, and someone unlike all is tried again before he is kept
    h = reid.Fold(set())
    h.frame([(1, x)])
    for k in range(DEFAULT.retry_window):
        assert 5 not in h.gallery
        assert h.frame([(5, y)]) == [5]
    assert 5 in h.gallery and h.frame([(6, None)]) == [6]


def test_conflicts_are_resolved():
    nodes = [(v, p) for v in range(3) for p in range(3)]
    r = np.random.default_rng(2)
    for _ in range(60):
        edges = [(float(r.random()), a, b) for a in nodes for b in nodes if a[0] < b[0] and r.random() < 0.3]
        roots = reid.resolve(nodes, edges)
        members: dict = {}
        for n, root in roots.items():
            members.setdefault(root, []).append(n)
        for root, own in members.items():
            assert root == min(own) and len({v for v, _ in own}) == len(own)
    # the weakest edge at a clash goes: 0.9 and 0.8 stay, so 1:0 and 2:0 belong to 0:0
    roots = reid.resolve(nodes[:1] + [(1, 0), (1, 1), (2, 0)], [(0.9, (0, 0), (1, 0)), (0.8, (1, 0), (2, 0)), (0.3, (1, 1), (2, 0))])
    assert roots == {(0, 0): (0, 0), (1, 0): (0, 0), (2, 0): (0, 0), (1, 1): (1, 1)}


def walk(r: np.random.Generator, n: int, noise: float = 0.0) -> np.ndarray:
    t = np.arange(n) / 30
    base = np.stack([np.stack([np.sin(2 * t + k), np.cos(3 * t + k * k), t * 0.3 + 0.1 * k], 1) for k in range(5)], 1)
    return base + noise * r.normal(0, 1, base.shape)


def test_offsets_of_synthetic_walks(spark):
    r = np.random.default_rng(4)
    shifts, full = {0: 0, 1: 7, 2: -4}, walk(r, 160)
    rows = []
    for cam, s in shifts.items():
        own = full[20 - s : 140 - s] + 0.01 * r.normal(0, 1, (120, 5, 3))
        rows += [("s", cam, f, p, j, *map(float, own[f, j] + p), 1.0) for f in range(120) for j in range(5) for p in (3, 4)]
    df = spark.createDataFrame(rows, "scene_id string, video_id int, frame_idx int, person_id int, joint int, x double, y double, z double, conf double")
    by_person = sy.warp_sequences(df)
    got = {(x["video_a"], x["video_b"]): x["offset"] for x in sy.pair_offsets(by_person, ["scene_id", "video_a", "video_b"]).collect()}
    assert got.keys() == {(0, 1), (0, 2), (1, 2)}
    assert all(abs(got[a, b] - (shifts[b] - shifts[a])) <= 2 for a, b in got)
    # the same by the cost table and the path over it
    other = sy.warp(sy.cost_matrix(df), ["scene_id", "person_id", "video_a", "video_b"])
    same = lambda x: sorted((*r[:4], round(r["distance"], 6), r["path_length"], r["offset"]) for r in x.select("scene_id", "person_id", "video_a", "video_b", "distance", "path_length", "offset").collect())
    assert same(other) == same(by_person)


def test_starts_of_a_sparse_graph(spark):
    true = {"a": 0.0, "b": 5.0, "c": -3.0, "d": 2.0}
    rows = [("s", i, j, true[j] - true[i]) for i, j in (("a", "b"), ("b", "d"), ("c", "d"))] + [("t", "x", "y", -2.0), ("t", "u", "v", 4.0)]
    got = {(r["scene_id"], r["cam"]): r["start"] for r in sy.start_times_sparse(spark.createDataFrame(rows, "scene_id string, i string, j string, off double"), ["scene_id"]).collect()}
    assert all(math.isclose(got["s", c], t + 3, abs_tol=1e-9) for c, t in true.items())
    # two parts that nothing connects: each begins at 0, then all are moved up together
    assert {k[1]: round(v, 9) for k, v in got.items() if k[0] == "t"} == {"u": 2, "v": 6, "x": 2, "y": 0}


def test_runs_are_composed_like_pixels(spark):
    from posegrid.operators import detections as det

    r = np.random.default_rng(5)
    runs = [(f, int(y), o, 100 + o, int(a), int(a + r.integers(0, 9))) for f in range(4) for o in range(12) for y in r.integers(0, 4, 2) for a in [r.integers(0, 20)]]
    df = spark.createDataFrame(runs, "frame_idx int, y int, ord int, person_id int, x_start int, x_end int")
    pixels: dict = {}
    for f, y, o, p, a, e in sorted(runs, key=lambda x: x[2]):
        for x in range(a, e + 1):
            pixels[f, y, x] = p
    got: dict = {}
    for row in det.compose_runs(df, ["frame_idx"]).collect():
        for x in range(row["x_start"], row["x_end"] + 1):
            assert (row["frame_idx"], row["y"], x) not in got
            got[row["frame_idx"], row["y"], x] = row["person_id"]
    assert got == pixels


def test_hybrid_of_all_components(spark):
    r = np.random.default_rng(6)
    a, s = r.normal(0, 1, 54), r.normal(0, 1, 10)
    got = spark.createDataFrame([(a.tolist(), s.tolist())], "a array<double>, s array<double>").select(vec.hybrid(F.col("a"), F.col("s")).alias("h")).first()["h"]
    want = np.concatenate([0.7 * a, 0.3 * s / np.linalg.norm(s)])
    assert np.allclose(got, want / np.linalg.norm(want))
