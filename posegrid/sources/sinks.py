"""Writers: tables partitioned by scene and video, dense only at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tracks import first_available

KEYS = ["scene_id", "video_id"]


def dense_tracks(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Person rows with gaps filled: zeros shaped like the person's first value of a field.

    A field that a person never has stays null; a field that nobody has is left out.
    """
    there = [f for f in fields if f in rows.columns]
    some = rows.agg(*[F.count(f).alias(f) for f in there]).first() if there else {}
    kept = [f for f in there if some[f]]
    return first_available(rows, [*KEYS, "person_id"], kept).select(*KEYS, "person_id", "frame_idx", *kept)


def summary(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Of each person the number of frames, their range and the length of each array field."""
    shapes = [F.max(F.size(f)).alias(f"len_{f}") for f in fields]
    return rows.groupBy(*KEYS, "person_id").agg(F.count(F.lit(1)).alias("num_frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), *shapes)


def write_tracks(rows: DataFrame, path: str, fields: list[str]) -> None:
    """Dense tracks, rows of a person in frame order, and their summary beside them."""
    dense = dense_tracks(rows, fields)
    dense.repartition(*KEYS, "person_id").sortWithinPartitions(*KEYS, "person_id", "frame_idx").write.partitionBy(*KEYS).parquet(f"{path}/persons")
    kept = [f for f in fields if f in dense.columns]
    summary(dense, kept).write.parquet(f"{path}/summary")


def write_gallery(gallery: DataFrame, path: str) -> None:
    gallery.select(*KEYS, "person_id", "descriptor").write.partitionBy(*KEYS).parquet(path)


def write_remaps(within: DataFrame, across: DataFrame, path: str) -> None:
    """Both remaps in one table, told apart by ``level``."""
    cols = [*KEYS, F.col("old_id").cast("long").alias("old_id"), F.col("new_id").cast("long").alias("new_id")]
    within.select(*cols, F.lit("video").alias("level")).unionByName(across.select(*cols, F.lit("scene").alias("level"))).write.partitionBy("level").parquet(path)


def write_poses(poses: DataFrame, path: str) -> None:
    """One row for each pair of videos, rotation and translation as arrays."""
    poses.select("scene_id", "video_a", "video_b", "rotation", "translation").write.parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """An alignment report as CSV: pair, correspondences, root mean square residual and translation length."""
    cols = [F.col("video_a").alias("vid_a"), F.col("video_b").alias("vid_b"), "n", F.col("rmse").alias("rmse_m"), F.col("t_length").alias("|t|_m")]
    report.select("scene_id", *cols).sortWithinPartitions("scene_id", "vid_a", "vid_b").write.option("header", "true").csv(path)


def compact_masks(masks: DataFrame, path: str) -> None:
    """Mask runs of many frames in few files: a video's rows are in one place, in frame order."""
    masks.repartition(*KEYS).sortWithinPartitions(*KEYS, "frame_idx", "person_id", "y", "x_start").write.option("compression", "zstd").partitionBy(*KEYS).parquet(path)
