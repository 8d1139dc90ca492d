"""Correspondences between cameras and rigid or similarity alignment.

An alignment needs only sums over correspondences, which Spark combines before
it shuffles them; one row for each pair of cameras then goes to a 3 x 3 singular
value decomposition in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config

AXES = ("x", "y", "z")
POSE = T.StructType([T.StructField("rotation", T.ArrayType(T.DoubleType())), T.StructField("translation", T.ArrayType(T.DoubleType())), T.StructField("scale", T.DoubleType())])


def absolute_joints(joints: DataFrame, roots: DataFrame, drop_zero: bool = True) -> DataFrame:
    """Joints moved by their person's root.

    A joint that ends at the origin is missing.  A person in a frame without any
    joint left is its root alone (``joint`` -1); without a root it drops out.
    """
    keys = ["scene_id", "video_id", "frame_idx", "person_id"]
    there = roots.select(*keys, *[F.col(a).alias(f"r{a}") for a in AXES]).where("rx IS NOT NULL AND ry IS NOT NULL AND rz IS NOT NULL")
    rows = joints.join(there, keys).withColumns({a: F.col(a) + F.col(f"r{a}") for a in AXES}).select(*keys, "joint", *AXES)
    if drop_zero:
        rows = rows.where(~((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)))
    alone = there.join(rows.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(-1).alias("joint"), *[F.col(f"r{a}").alias(a) for a in AXES])
    return rows.unionByName(alone)


def evaluation_points(persons: DataFrame, keypoints: str = "pred_keypoints_3d", root: str = "pred_cam_t", vertices: str = "vertices") -> DataFrame:
    """Points of person rows as an evaluation takes them: ``scene_id, video_id, person_id,
    frame_idx, joint, x, y, z``.

    A person with keypoints anywhere gives its keypoints moved by its root (zero where
    it has none), one without gives its vertices.  Nothing is filtered: points at the
    origin and NaN stay.  Paired by ``correspondences``, two cameras share as many points
    as the one with fewer has.  Arrays are flat, three numbers a point; frames
    without the array that counts have no points.
    """
    keys = ["scene_id", "video_id", "person_id"]
    kinds = dict(persons.dtypes)
    array = lambda c: F.col(c).cast("array<double>") if c in kinds else F.lit(None).cast("array<double>")
    rows = persons.select(*keys, "frame_idx", array(keypoints).alias("k"), F.coalesce(array(root), F.array(*[F.lit(0.0)] * 3)).alias("t"), array(vertices).alias("v"))
    having = rows.where("k IS NOT NULL").select(*keys).distinct().withColumn("has_k", F.lit(True))
    chosen = rows.join(having, keys, "left").withColumn("p", F.when(F.col("has_k"), F.col("k")).otherwise(F.col("v")))
    move = lambda c: F.when(F.col("has_k"), F.col("t")[c]).otherwise(F.lit(0.0))
    spread = chosen.where(F.size("p") >= 3).withColumn("joint", F.explode(F.sequence(F.lit(0), F.floor(F.size("p") / 3).cast("int") - 1)))
    at = [(F.get("p", F.col("joint") * 3 + k) + move(k)).alias(a) for k, a in enumerate(AXES)]
    return spread.select(*keys, "frame_idx", "joint", *at)


def correspondences(joints: DataFrame, by_rank: bool = False) -> DataFrame:
    """Points that two cameras of a scene share: same person, frame and joint.

    ``by_rank`` pairs the n-th joint of both that is not missing (all zero), as far as
    both go, instead of equal joints.
    """
    keys = ["scene_id", "person_id", "frame_idx"]
    rows = joints.where(~((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0))) if by_rank else joints
    last = "joint"
    if by_rank:
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "video_id").orderBy("joint")))
        last = "nth"
    a = rows.select(*keys, last, F.col("video_id").alias("video_a"), *[F.col(c).alias(f"a{c}") for c in AXES])
    b = rows.select(*keys, last, F.col("video_id").alias("video_b"), *[F.col(c).alias(f"b{c}") for c in AXES])
    return a.join(b, [*keys, last]).where("video_a < video_b")


def sums(points: DataFrame, keys: list[str]) -> DataFrame:
    """Count, centroids, centred cross-covariance and variance of the points of each group.

    Products are of differences to the group's first centroid, so that points far
    from the origin lose no digits.
    """
    mean = {f"m{s}{c}": F.avg(f"{s}{c}") for s in "ab" for c in AXES}
    centred = points.join(points.groupBy(*keys).agg(*[v.alias(k) for k, v in mean.items()]), keys)
    d = {f"{s}{c}": F.col(f"{s}{c}") - F.col(f"m{s}{c}") for s in "ab" for c in AXES}
    aggs = [F.count(F.lit(1)).alias("n")] + [F.first(m).alias(m) for m in mean]
    aggs += [F.avg(d[f"b{i}"] * d[f"a{j}"]).alias(f"h{i}{j}") for i in AXES for j in AXES]
    aggs += [F.avg(sum((d[f"a{c}"] * d[f"a{c}"] for c in AXES[1:]), d["ax"] * d["ax"])).alias("var_a")]
    return centred.groupBy(*keys).agg(*aggs)


def merged(stats: DataFrame, keys: list[str]) -> DataFrame:
    """``sums`` of larger groups from those of the smaller ones that they are made of.

    A covariance about the common centroid is the mean of the groups' own ones and of
    the products of their centroids' distances to it, weighted by their sizes.
    """
    w = F.col("n").cast("double")
    mean = lambda c: F.sum(w * c) / F.sum(w)
    names = [f"m{s}{c}" for s in "ab" for c in AXES]
    total = stats.groupBy(*keys).agg(*[mean(F.col(m)).alias(f"t{m}") for m in names])
    d = {m: F.col(m) - F.col(f"t{m}") for m in names}
    aggs = [F.sum("n").alias("n")] + [F.first(f"t{m}").alias(m) for m in names]
    aggs += [mean(F.col(f"h{i}{j}") + d[f"mb{i}"] * d[f"ma{j}"]).alias(f"h{i}{j}") for i in AXES for j in AXES]
    aggs += [mean(F.col("var_a") + sum((d[f"ma{c}"] * d[f"ma{c}"] for c in AXES[1:]), d["max"] * d["max"])).alias("var_a")]
    return stats.join(total, keys).groupBy(*keys).agg(*aggs)


def solve(h: np.ndarray, mean_a: np.ndarray, mean_b: np.ndarray, var_a: np.ndarray, with_scale: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation, translation and scale from covariances (n, 3, 3), as b = s R a + t."""
    u, d, vt = np.linalg.svd(h)
    sign = np.ones((len(h), 3))
    sign[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1, 1)
    r = (u * sign[:, None, :]) @ vt
    s = np.where(var_a > 1e-12, (d * sign).sum(1) / np.maximum(var_a, 1e-12), 1.0) if with_scale else np.ones(len(h))
    return r, mean_b - s[:, None] * np.einsum("nij,nj->ni", r, mean_a), s


def poses(stats: DataFrame, with_scale: bool = False, cfg: Config = DEFAULT, least: int | None = None) -> DataFrame:
    """The pose of each group of ``sums`` with enough correspondences."""
    names = [f"h{i}{j}" for i in AXES for j in AXES] + [f"m{s}{c}" for s in "ab" for c in AXES] + ["var_a"]

    @F.pandas_udf(POSE)
    def fit(*cols: pd.Series) -> pd.DataFrame:
        v = np.column_stack([c.to_numpy(float) for c in cols])
        r, t, s = solve(v[:, :9].reshape(-1, 3, 3), v[:, 9:12], v[:, 12:15], v[:, 15], with_scale)
        return pd.DataFrame({"rotation": list(r.reshape(-1, 9)), "translation": list(t), "scale": s})

    least = cfg.min_correspondences if least is None else least
    return stats.where(F.col("n") >= least).withColumn("pose", fit(*[F.col(n) for n in names])).select(*[c for c in stats.columns if c not in names], "pose.*")


def moved(p: list[Column], rotation: Column, translation: Column, scale: Column | float = 1.0) -> list[Column]:
    return [scale * (rotation[3 * i] * p[0] + rotation[3 * i + 1] * p[1] + rotation[3 * i + 2] * p[2]) + translation[i] for i in range(3)]


def residuals(points: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of each moved point to its partner."""
    q = moved([F.col(f"a{c}") for c in AXES], F.col("rotation"), F.col("translation"), F.col("scale"))
    d = [F.col(f"b{c}") - q[k] for k, c in enumerate(AXES)]
    return points.join(fits, keys).withColumn("residual", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))


def pair_report(points: DataFrame, keep_small: bool = True, cfg: Config = DEFAULT) -> DataFrame:
    """Correspondences, root mean square residual and translation length of each pair of cameras.

    Pairs with too few correspondences have nulls, or go.
    """
    keys = ["scene_id", "video_a", "video_b"]
    stats = sums(points, keys)
    fits = poses(stats, cfg=cfg).drop("n")
    report = residuals(points, fits, keys).groupBy(*keys).agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"), F.first("translation").alias("t"))
    t = F.col("t")
    out = stats.select(*keys, "n").join(report, keys, "left" if keep_small else "inner")
    return out.select(*keys, "n", "rmse", F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2]).alias("t_length"))


def mean_rotation(rows: DataFrame, keys: list[str], matrix: str) -> DataFrame:
    """The rotation nearest to the sum of a group's rotations."""
    total = rows.groupBy(*keys).agg(*[F.sum(F.col(matrix)[k]).alias(f"s{k}") for k in range(9)])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(*cols: pd.Series) -> pd.Series:
        h = np.column_stack([c.to_numpy(float) for c in cols]).reshape(-1, 3, 3)
        zero = np.zeros((len(h), 3))
        return pd.Series(list(solve(h, zero, zero, np.ones(len(h)), False)[0].reshape(-1, 9)))

    return total.select(*keys, project(*[F.col(f"s{k}") for k in range(9)]).alias("rotation"))


def to_first_camera(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """World-to-camera coordinates of any camera in those of camera 0."""
    from ..functions import cam, vec

    base = cameras.where("cam = 0").select("scene_id", *[F.col(c).alias(f"o_{c}") for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])
    rows = points.join(cameras.select("scene_id", "cam", "qw", "qx", "qy", "qz", "tx", "ty", "tz"), ["scene_id", "cam"]).join(base, "scene_id")
    r = vec.matmul(cam.rotation("o_"), vec.transposed(cam.rotation()))
    moved_t = vec.apply(r, cam.translation())
    p = vec.apply(r, [F.col(a) for a in AXES])
    t0 = cam.translation("o_")
    return rows.select(*points.columns, *[(p[k] + t0[k] - moved_t[k]).alias(f"w{c}") for k, c in enumerate(AXES)])


def _with_first(rows: DataFrame, cameras: DataFrame) -> DataFrame:
    """Rows with their camera's pose, and that of camera 0 as ``o_``; scenes without it drop out."""
    names = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    base = cameras.where("cam = 0").select("scene_id", *[F.col(c).alias(f"o_{c}") for c in names])
    return rows.join(cameras.select("scene_id", "cam", *names), ["scene_id", "cam"]).join(base, "scene_id")


def _turned(rows: DataFrame, turn: list[Column], orient: str) -> DataFrame:
    """The rows with their orientations turned, null ones as they are.

    Each step is a column that the next one reads, so that no expression is
    written out again in the others.
    """
    from ..functions import rot, vec

    nine = lambda c: vec.items(F.col(c), 9)
    out = rows.withColumns({"_turn": F.array(*turn), "_body": F.array(*rot.axis_angle_to_matrix(vec.items(F.col(orient), 3)))})
    out = out.withColumn("_matrix", F.array(*vec.matmul(nine("_turn"), nine("_body"))))
    out = out.withColumn("_quat", F.array(*rot.matrix_to_quat(nine("_matrix"))))
    angles = F.array(*rot.quat_to_axis_angle(vec.items(F.col("_quat"), 4)))
    return out.withColumn(orient, F.when(F.col(orient).isNotNull(), angles)).drop("_turn", "_body", "_matrix", "_quat")


def orientations_to_first_camera(rows: DataFrame, cameras: DataFrame, orient: str = "global_orient") -> DataFrame:
    """Orientations (axis times angle) that cameras saw, as camera 0 would see them.

    Null orientations stay null.
    """
    from ..functions import cam, vec

    turn = vec.matmul(cam.rotation("o_"), vec.transposed(cam.rotation()))
    return _turned(_with_first(rows, cameras), turn, orient).select(*rows.columns)


def truth_to_first_camera(truth: DataFrame, cameras: DataFrame, orient: str = "global_orient", transl: str = "transl") -> DataFrame:
    """True orientations and positions, in world coordinates, as camera 0 sees them; null ones stay null."""
    from ..functions import cam, vec

    base = cameras.where("cam = 0").select("scene_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz")
    rows = truth.join(base, "scene_id")
    place = F.array(*[a + b for a, b in zip(vec.apply(cam.rotation(), vec.items(F.col(transl), 3)), cam.translation())])
    out = rows.withColumn(transl, F.when(F.col(transl).isNotNull(), place))
    return _turned(out, cam.rotation(), orient).select(*truth.columns)


def residual_histogram(rows: DataFrame, value: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """Counts in equal bins; the last one holds the upper end."""
    k = F.least(F.floor((F.col(value) - low) * bins / (high - low)), F.lit(bins - 1))
    return rows.where(F.col(value).between(low, high)).groupBy(k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
