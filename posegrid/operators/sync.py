"""Time offsets between cameras by dynamic time warping, and global start times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .starts import start_times as pair_starts
from .warping import joint_costs, most_common, pose_costs, value_costs
from .warping import warp as warp_frames


#: Numbers of one block of costs that a task computes at a time.
BLOCK = 1 << 20


def in_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every row once for each other recording of its group: ``video_a`` < ``video_b``, and
    ``side`` 0 or 1 says whose row it is."""
    others = rows.groupBy(*keys).agg(F.collect_set("video_id").alias("others"))
    met = rows.join(others, keys).withColumn("other", F.explode(F.filter("others", lambda v: v != F.col("video_id"))))
    return met.drop("others").withColumns({"video_a": F.least("video_id", "other"), "video_b": F.greatest("video_id", "other"), "side": (F.col("video_id") > F.col("other")).cast("int")}).drop("video_id", "other")


def recordings(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of both sides of a pair: frame numbers, (frames, joints, 4), and which joints a frame
    has.  Joints are those that both recordings have somewhere."""
    col = {c: table[c].to_numpy() for c in ("side", "frame_idx", "joint", "x", "y", "z", "conf")}
    own = [np.flatnonzero(col["side"] == s) for s in (0, 1)]
    joints = np.intersect1d(col["joint"][own[0]], col["joint"][own[1]])
    out = []
    for rows in own:
        frames, at = np.unique(col["frame_idx"][rows], return_inverse=True)
        place = np.searchsorted(joints, col["joint"][rows])
        known = place < len(joints)
        known[known] = joints[place[known]] == col["joint"][rows][known]
        values, there = np.zeros((len(frames), len(joints), 4)), np.zeros((len(frames), len(joints)), bool)
        for c, name in enumerate(("x", "y", "z", "conf")):
            values[at[known], place[known], c] = col[name][rows][known]
        there[at[known], place[known]] = True
        out.append((frames, values, there))
    return out


def _pairs_of_joints(joints: DataFrame) -> DataFrame:
    numbers = ["x", "y", "z", "conf"]
    rows = joints.select("scene_id", "person_id", "video_id", "frame_idx", "joint", *(F.col(c).cast("double").alias(c) for c in numbers)).dropna()
    return in_pairs(rows, ["scene_id", "person_id"]).groupBy("scene_id", "person_id", "video_a", "video_b")


def cost_matrix(joints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Confidence-weighted distance of every two frames of one person in two cameras, over
    the joints that both frames have; frames that share none have no row.

    Both recordings of a pair meet in one task; the matrix is made and given out in
    blocks of frames.  Joints with a null number count as missing.
    """
    keys = ["scene_id", "person_id", "video_a", "video_b"]
    kinds = dict(joints.dtypes)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (f, x, in_x), (g, y, in_y) = recordings(pa.Table.from_batches(batches))
        step = max(1, BLOCK // max(1, y.shape[0] * y.shape[1]))
        for s in range(0, len(f), step):
            cost = joint_costs(x[s : s + step, None], y[None], cfg.dtw_exponent)
            i, j = np.nonzero(in_x[s : s + step].astype(np.float32) @ in_y.T.astype(np.float32))
            columns = [pa.repeat(k, len(i)) for k in key] + [pa.array(f[s + i]), pa.array(g[j]), pa.array(cost[i, j])]
            yield pa.record_batch(columns, names=[*keys, "frame_a", "frame_b", "cost"])

    v, n = kinds["video_id"], kinds["frame_idx"]
    return _pairs_of_joints(joints).applyInArrow(run, f"scene_id {kinds['scene_id']}, person_id {kinds['person_id']}, video_a {v}, video_b {v}, frame_a {n}, frame_b {n}, cost double")


def warp_sequences(joints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """DTW of every two recordings of one person: what moves is each recording once for
    each other one, and no task ever holds a cost matrix (see ``warping``).

    Frames count by their order, and those that share no joint cost nothing.  Persons
    that only one of two cameras has are left out; joints with a null number count
    as missing.
    """
    keys = ["scene_id", "person_id", "video_a", "video_b"]
    kinds = dict(joints.dtypes)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        (_, x, _), (_, y, _) = recordings(table)
        total, rows, cols = warp_frames(len(x), len(y), pose_costs(x, y, cfg.dtw_exponent))
        found = [total, len(rows), most_common(cols - rows)]
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([v], t) for v, t in zip(found, (pa.float64(), pa.int32(), pa.int32()))], names=[*keys, "distance", "path_length", "offset"])

    v = kinds["video_id"]
    return _pairs_of_joints(joints).applyInArrow(run, f"scene_id {kinds['scene_id']}, person_id {kinds['person_id']}, video_a {v}, video_b {v}, distance double, path_length int, offset int")


def warp_series(rows: DataFrame, keys: list[str]) -> DataFrame:
    """DTW distance of every two recordings of a group by squared differences of one value:
    ``video_id``, ``frame_idx``, ``v``.  Rows without a value are left out."""
    kinds = dict(rows.dtypes)
    own = rows.select(*keys, "video_id", "frame_idx", F.col("v").cast("double").alias("v")).dropna(subset=["frame_idx", "v"])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side, frame, v = (table[c].to_numpy() for c in ("side", "frame_idx", "v"))
        order = np.lexsort((v, frame))
        x, y = (v[order][side[order] == s] for s in (0, 1))
        far = warp_frames(len(x), len(y), value_costs(x, y))[0]
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([far])], names=[*keys, "video_a", "video_b", "distance"])

    v = kinds["video_id"]
    return in_pairs(own, keys).groupBy(*keys, "video_a", "video_b").applyInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"video_a {v}", f"video_b {v}", "distance double"]))


def scenes_with_equal_persons(joints: DataFrame) -> DataFrame:
    """Scenes whose cameras all have the same number of persons: persons can be paired by order there."""
    n = joints.groupBy("scene_id", "video_id").agg(F.countDistinct("person_id").alias("n"))
    return n.groupBy("scene_id").agg(F.min("n").alias("least"), F.max("n").alias("most")).where("least = most").select("scene_id", F.col("least").alias("n_persons"))


def accumulate(cost: np.ndarray) -> np.ndarray:
    """Least total cost of a path to every cell, one anti-diagonal at a time."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        j = k - i
        total[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(total[i - 1, j - 1], total[i - 1, j]), total[i, j - 1])
    return total


def path(total: np.ndarray) -> list[tuple[int, int]]:
    """The best path back from the end; on ties diagonal, then up, then left."""
    i, j = total.shape[0] - 1, total.shape[1] - 1
    out = []
    while i > 0 and j > 0:
        out.append((i - 1, j - 1))
        step = min(((total[i - 1, j - 1], 0), (total[i - 1, j], 1), (total[i, j - 1], 2)))[1]
        i, j = i - (step != 2), j - (step != 1)
    return out[::-1]


def warp(cost: DataFrame, keys: list[str], a: str = "frame_a", b: str = "frame_b", gaps: bool = False) -> DataFrame:
    """DTW of each group's cost matrix: distance, path length and offset.

    Frames count by their order; with ``gaps`` the offset is in frame numbers.  A
    group is one pair of one person's recordings and fits in a task.
    """
    kinds = {n: t for n, t in cost.dtypes}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", distance double, path_length int, offset int"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = pdf.pivot(index=a, columns=b, values="cost").sort_index().sort_index(axis=1)
        total = accumulate(matrix.to_numpy())
        steps = path(total)
        rows, cols = matrix.index.to_numpy(), matrix.columns.to_numpy()
        shift = [int(cols[j] - rows[i]) if gaps else j - i for i, j in steps]
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), total[-1, -1], len(steps), most_common(shift)]], columns=[*keys, "distance", "path_length", "offset"])

    return cost.groupBy(*keys).applyInPandas(solve, schema)


def pair_offsets(by_person: DataFrame, keys: list[str]) -> DataFrame:
    """Lower median of the persons' offsets."""
    return by_person.groupBy(*keys).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY offset)").cast("double").alias("offset"))


def offset_matrix(pairs: DataFrame, i: str = "i", j: str = "j", off: str = "off") -> DataFrame:
    """All ordered pairs: antisymmetric, zero on the diagonal."""
    upper = pairs.select(F.col(i).alias("i"), F.col(j).alias("j"), F.col(off).alias("off"))
    lower = pairs.select(F.col(j).alias("i"), F.col(i).alias("j"), (-F.col(off)).alias("off"))
    cams = upper.select("i").union(upper.select(F.col("j").alias("i"))).distinct()
    return upper.union(lower).union(cams.select("i", F.col("i").alias("j"), F.lit(0.0).alias("off")))


def start_times(matrix: DataFrame) -> DataFrame:
    """Least-squares start of every camera relative to the first, none below zero.

    For a complete matrix the solution is the mean of a column less that of the
    first camera's; starts are shifted up only if the least is negative.
    """
    first = matrix.agg(F.min("i").alias("f"))
    means = matrix.groupBy(F.col("j").alias("cam")).agg(F.avg("off").alias("m"))
    base = means.join(F.broadcast(first), F.col("cam") == F.col("f")).select(F.col("m").alias("m0"))
    starts = means.crossJoin(F.broadcast(base)).select("cam", (F.col("m") - F.col("m0")).alias("t"))  # one row on the right
    low = starts.agg(F.least(F.min("t"), F.lit(0.0)).alias("low"))
    return starts.crossJoin(F.broadcast(low)).select("cam", (F.col("t") - F.col("low")).alias("start"))


def start_times_sparse(pairs: DataFrame, keys: list[str], i: str = "i", j: str = "j", off: str = "off") -> DataFrame:
    """Least-squares starts of each scene's cameras where some pairs have no offset (see ``starts``)."""
    return pair_starts(pairs, keys, i, j, off)


def rounded(starts: DataFrame, start: Column | None = None) -> DataFrame:
    """Whole frames; halves round to even."""
    return starts.withColumn("start_frame", F.bround("start" if start is None else start).cast("int"))
