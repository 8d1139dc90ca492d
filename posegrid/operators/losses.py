"""Losses, pooling and attention of the fusion model as relations; weights are inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import JOINT_PARENTS
from ..functions import cam, vec
from .attention import group_attention


def mse(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    d = F.col(a) - F.col(b)
    return rows.groupBy(*keys).agg(F.avg(d * d).alias("mse"))


def temporal_smoothness(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Sum of squared second differences (of first ones, or values, where rows are few)."""
    w = Window.partitionBy(*keys).orderBy(order)
    v, p1, p2 = F.col(value), F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    rows = rows.withColumns({"s0": v * v, "s1": (v - p1) * (v - p1), "s2": (v - 2 * p1 + p2) * (v - 2 * p1 + p2)})
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("s2"), F.sum("s1"), F.sum("s0")).alias("loss"))


def kl_term(rows: DataFrame, mu: str, logvar: str, keys: list[str]) -> DataFrame:
    m, lv = F.col(mu), F.col(logvar)
    return rows.groupBy(*keys).agg((F.sum(1 + lv - m * m - F.exp(lv)) * F.lit(-0.5)).alias("kl"))


def kl_loss(rows: DataFrame, mu: str, logvar: str, sample: list[str], keys: list[str] | None = None) -> DataFrame:
    """Divergence from the unit normal: summed over a sample's latent components, then the
    mean over samples (rows of one ``sample`` are its components)."""
    keys = keys or []
    own = kl_term(rows, mu, logvar, [*keys, *sample])
    return own.groupBy(*keys).agg(F.avg("kl").alias("kl"))


def body_parents(spark: SparkSession) -> DataFrame:
    """The body model's joints and their parents."""
    return spark.createDataFrame(list(enumerate(JOINT_PARENTS)), "joint int, parent int")


def bone_lengths(joints: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of each joint to its parent; the root has no bone."""
    p = joints.select(*keys, F.col("joint").alias("parent"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    d = [F.col(c) - F.col(f"p{c}") for c in "xyz"]
    # The parents of a body model: a table of fixed size.
    rows = joints.join(F.broadcast(parents.where("parent >= 0")), "joint").join(p, [*keys, "parent"])
    return rows.select(*keys, "joint", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("bone"))


def bone_consistency(bones: DataFrame, keys: list[str]) -> DataFrame:
    """Sample deviation of each bone's length over frames and cameras, plus 1e-6, then the mean."""
    per = bones.groupBy(*keys, "joint").agg((F.stddev_samp("bone") + 1e-6).alias("s"))
    return per.groupBy(*keys).agg(F.avg("s").alias("loss"))


def beta_consistency(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean squared deviation of each camera's shape from the cameras' mean."""
    d = F.col(value) - F.avg(value).over(Window.partitionBy(*group))
    return rows.withColumn("d2", d * d).agg(F.avg("d2").alias("loss"))


def camera_loss(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Squared translation error plus one minus the absolute quaternion product, on average."""
    t = sum(((F.col(f"t{c}") - F.col(f"g_t{c}")) * (F.col(f"t{c}") - F.col(f"g_t{c}")) for c in "yz"), (F.col("tx") - F.col("g_tx")) * (F.col("tx") - F.col("g_tx")))
    q = sum((F.col(f"q{c}") * F.col(f"g_q{c}") for c in "xyz"), F.col("qw") * F.col("g_qw"))
    return rows.groupBy(*keys).agg((F.avg(t) + F.avg(1 - F.abs(q))).alias("loss"))


def weighted_sum(losses: DataFrame, weights: DataFrame) -> DataFrame:
    return losses.join(F.broadcast(weights), "name").agg(F.sum(F.col("weight") * F.col("loss")).alias("total"))


def confidence_bias(q: Column, k: Column) -> Column:
    return F.log(q * k + 1e-6)


def softmax_pool(rows: DataFrame, keys: list[str], logit: str, value: str) -> DataFrame:
    """Values averaged with softmax weights over each key's rows."""
    top = rows.groupBy(*keys).agg(F.max(logit).alias("top"))
    e = F.exp(F.col(logit) - F.col("top"))
    return rows.join(top, keys).groupBy(*keys).agg((F.sum(e * F.col(value)) / F.sum(e)).alias("pooled"))


def windowed_attention(rows: DataFrame, keys: list[str], order: str, q: str, k: str, v: str, reach: int) -> DataFrame:
    """Scalar attention of every row over the rows within ``reach`` of its place.

    Each row is sent to the places it can be seen from, so the join is on equal places.
    """
    near = rows.select(*keys, F.col(order).alias("from"), F.col(k).alias("key"), F.col(v).alias("val")).withColumn(order, F.explode(F.sequence(F.col("from") - reach, F.col("from") + reach)))
    scored = rows.select(*keys, order, F.col(q).alias("query")).join(near, [*keys, order]).withColumn("s", F.col("query") * F.col("key"))
    return softmax_pool(scored, [*keys, order], "s", "val")


def vector_attention(queries: DataFrame, keys_values: DataFrame, group: list[str], bias: Column | None = None) -> DataFrame:
    """Scaled dot-product attention within a group (joints of a body, cameras of a frame,
    or one stream over another): ``q`` over ``k`` and ``v`` arrays, one value array out.

    Without a bias no pair becomes a row (``attention.group_attention``).  A bias is any expression
    of both rows, so with one every pair of a group is a row.
    """
    if bias is None:
        return group_attention(queries, keys_values, group)
    s = vec.dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q").cast("double"))
    pairs = queries.join(keys_values, group).withColumn("s", s if bias is None else s + bias)
    top = pairs.groupBy(*group, "q_id").agg(F.max("s").alias("top"))
    parts = pairs.join(top, [*group, "q_id"]).withColumn("e", F.exp(F.col("s") - F.col("top"))).select(*group, "q_id", "e", F.posexplode("v").alias("dim", "x"))
    per = parts.groupBy(*group, "q_id", "dim").agg((F.sum(F.col("e") * F.col("x")) / F.sum("e")).alias("x"))
    return per.groupBy(*group, "q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"]).alias("out"))


def epipolar_loss(points: DataFrame, cameras: DataFrame, cx: float, cy: float) -> DataFrame:
    """Mean absolute epipolar residual of points in front of both cameras of each pair."""
    names = ("qw", "qx", "qy", "qz", "tx", "ty", "tz", "focal_raw")
    side = lambda s: cameras.select("scene_id", F.col("cam").alias(f"cam_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in names])
    rows = side("i").join(side("j"), "scene_id").where("cam_i < cam_j").join(points, "scene_id")
    ri, rj, ti, tj = cam.rotation("i_"), cam.rotation("j_"), cam.translation("i_"), cam.translation("j_")
    fi, fj = cam.softplus(F.col("i_focal_raw")), cam.softplus(F.col("j_focal_raw"))
    x = [F.col(c) for c in "xyz"]
    pi = [a + b for a, b in zip(vec.apply(ri, x), ti)]
    pj = [a + b for a, b in zip(vec.apply(rj, x), tj)]
    center = (F.lit(cx), F.lit(cy))
    f = cam.fundamental(ri, ti, rj, tj, fi, fj, cx, cy)
    r = cam.epipolar_residual(f, cam.project(pi, fi, fi, *center), cam.project(pj, fj, fj, *center))
    seen = (pi[2] > 0) & (pj[2] > 0)
    return rows.where(seen).groupBy("scene_id").agg(F.avg(F.abs(r)).alias("loss"), F.count(F.lit(1)).alias("n"))


def camera_mean_target(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The target of an aggregated stream: the mean over cameras."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("target"))


def shape_losses(shapes: DataFrame) -> DataFrame:
    """The terms of body shapes: ``shape``, the cameras' mean against the mean of their targets,
    and ``beta``, each camera's deviation from the cameras' mean.

    ``shapes``: ``scene_id, cam, person_id, dim, pred, gt``.
    """
    body = ["scene_id", "person_id", "dim"]
    mean = shapes.groupBy(*body).agg(F.avg("pred").alias("p"), F.avg("gt").alias("g"))
    shape = mse(mean, "p", "g", []).select(F.lit("shape").alias("name"), F.col("mse").alias("loss"))
    return shape.union(beta_consistency(shapes, body, "pred").select(F.lit("beta").alias("name"), "loss"))


def epipolar_term(points: DataFrame, cameras: DataFrame, cx: float, cy: float) -> DataFrame:
    """The epipolar term, over all scenes' points and pairs; no row where no scene has two cameras."""
    per = epipolar_loss(points, cameras, cx, cy)
    total = per.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
    return total.where("loss IS NOT NULL").select(F.lit("epipolar").alias("name"), "loss")


def wired_losses(joints: DataFrame, target: DataFrame, cameras: DataFrame, bones: DataFrame) -> DataFrame:
    """The terms of a training step, each by its rule: ``name`` and ``loss``.

    ``joints`` and ``target``: ``scene_id, cam, frame_idx, person_id, joint, x``.  The
    aggregated stream is held against the mean of the target over cameras; cameras
    are held against their own truth (``cameras``: ``scene_id, cam, pred, gt``); the
    temporal term needs three frames, the bone term uses the target's bones
    (``bones``: ``scene_id, joint, bone``).
    """
    keys = ["scene_id", "frame_idx", "person_id", "joint"]
    mean = camera_mean_target(target, keys, "x")
    own = joints.groupBy(*keys).agg(F.avg("x").alias("x"))
    pose = mse(own.join(mean, keys), "x", "target", []).select(F.lit("pose").alias("name"), F.col("mse").alias("loss"))
    camera = mse(cameras, "pred", "gt", []).select(F.lit("camera").alias("name"), F.col("mse").alias("loss"))
    tracks = ["scene_id", "person_id", "joint"]
    long = own.join(own.groupBy(*tracks).agg(F.count(F.lit(1)).alias("n")).where("n >= 3"), tracks)
    smooth = temporal_smoothness(long, tracks, "frame_idx", "x").agg(F.sum("loss").alias("loss")).where("loss IS NOT NULL").select(F.lit("temporal").alias("name"), "loss")
    bone = bone_consistency(bones, ["scene_id"]).agg(F.avg("loss").alias("loss")).select(F.lit("bone").alias("name"), "loss")
    return pose.union(camera).union(smooth).union(bone)
