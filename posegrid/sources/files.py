"""Readers of a recording's files.

Listings never read file contents: only path, length and time are selected.  A
root's first folder level is the scene; what lies below depends on the layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detections as det
from . import archives

VIDEO_SUFFIXES = ("mp4", "mkv", "avi")
IMAGE_SUFFIXES = ("jpg", "jpeg", "bmp", "png")

# The fields that a person's archive may hold for fusion.
PERSON_FIELDS = [
    "frame_indices", "pred_cam_t", "focal_length", "pred_keypoints_2d", "pred_keypoints_3d", "smplx_betas", "smplx_body_pose", "smplx_global_orient", "smplx_transl", "smplx_left_hand_pose",
    "smplx_right_hand_pose", "smplx_expression", "bbox",
]


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...], with_content: bool = False) -> DataFrame:
    """``path``, ``rel`` (below the root), ``length`` and ``modified`` of files with these suffixes, in any case.

    Files of other suffixes are not even opened: their contents may be larger than a row can be.
    """
    any_case = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{any_case}}}").load(root)
    rel = F.split_part(F.col("path"), F.lit(root.rstrip("/").partition("://")[2] or root.rstrip("/")), F.lit(2))
    rows = files.select("path", F.ltrim(rel, F.lit("/")).alias("rel"), "length", F.col("modificationTime").alias("modified"), *(["content"] if with_content else []))
    return rows.where(F.lower(F.substring_index("path", ".", -1)).isin(*suffixes))


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(_name(path), r"\.[^.]*$", "")


def _level(k: int) -> Column:
    return F.get(F.split("rel", "/"), F.lit(k))


def video_tree(spark: SparkSession, root: str, first: int | None = None, drop_aria: bool = True) -> DataFrame:
    """``scene_id``, ``video_id`` and ``path`` of the videos at any depth of a scene folder.

    Scenes are counted before cameras worn by persons are left out, so one of the
    first scenes may have no video left.
    """
    rows = listing(spark, root, VIDEO_SUFFIXES).where(F.contains("rel", F.lit("/"))).select(_level(0).alias("scene_id"), _stem(F.col("path")).alias("video_id"), "path")
    if first is not None:
        rows = det.first_scenes(rows, first)
    return det.without_ego(rows, "video_id", drop_aria)


def image_sequences(spark: SparkSession, root: str, first: int | None = None) -> DataFrame:
    """``scene_id``, ``video_id`` (a camera folder with images directly in it), ``n_images`` and ``duration_s`` 0 at 30 frames a second."""
    rows = listing(spark, root, IMAGE_SUFFIXES[:3]).where(F.size(F.split("rel", "/")) == 3)
    found = rows.groupBy(_level(0).alias("scene_id"), _level(1).alias("video_id")).agg(F.count(F.lit(1)).alias("n_images"))
    found = found.withColumns({"fps": F.lit(30.0), "duration_s": F.lit(0.0)})
    return found if first is None else det.first_scenes(found, first)


def frame_source(videos: DataFrame, images: DataFrame) -> DataFrame:
    """Where each video's frames come from, by precedence.

    ``videos``: ``video_id``, ``frames_dir`` (given, or null) and ``path``.
    ``images``: ``dir`` of every image.  A given folder with images is taken first,
    then ``frames`` below the path, then the path itself; what is left, files, has
    to be decoded, and folders without images have no frames.
    """
    dirs = images.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    options = F.array(
        F.struct(F.lit(1).alias("rank"), F.lit("given").alias("source"), F.col("frames_dir").alias("dir")),
        F.struct(F.lit(2).alias("rank"), F.lit("frames").alias("source"), F.concat("path", F.lit("/frames")).alias("dir")),
        F.struct(F.lit(3).alias("rank"), F.lit("folder").alias("source"), F.col("path").alias("dir")),
    )
    found = videos.select("video_id", F.explode(options).alias("o")).select("video_id", "o.*").join(dirs, "dir")
    best = found.groupBy("video_id").agg(F.min_by(F.struct("source", "dir", "n"), "rank").alias("best"))
    is_file = F.lower(F.substring_index("path", ".", -1)).isin(*VIDEO_SUFFIXES)
    rows = videos.join(best, "video_id", "left")
    return rows.select("video_id", F.coalesce("best.source", F.when(is_file, "decode").otherwise("none")).alias("source"), F.coalesce("best.dir", "path").alias("dir"), F.coalesce("best.n", F.lit(0)).cast("long").alias("n_frames"))


def label_files(spark: SparkSession, root: str) -> DataFrame:
    """All labels of the per-frame JSON files below ``<root>/<scene>/<video>``."""
    rows = listing(spark, root, ("json",), with_content=True).where(_name(F.col("path")).startswith("mask_"))
    frames = rows.select(_level(0).alias("scene_id"), _level(1).alias("video_id"), "path", F.col("content").cast("string").alias("json"))
    return det.parse_frame_labels(frames)


def persons(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Person rows with the keys and, of the known fields, those that are there and asked for.

    Only these columns are read.
    """
    rows = spark.read.parquet(path)
    wanted = [f for f in (fields or PERSON_FIELDS) if f in rows.columns]
    keys = [k for k in ("scene_id", "video_id", "person_id", "frame_idx") if k in rows.columns]
    return rows.select(*keys, *wanted)


def person_archives(spark: SparkSession, root: str, fields: list[str] | None = None) -> DataFrame:
    """Rows of ``<root>/<scene>/<video>/body_data/person_<id>.npz``, of the known fields those asked for.

    Only the members asked for are read.  A field that an archive lacks is null;
    ``frame_idx`` is null where an archive does not say its frames.
    """
    archives.register(spark)
    wanted = [f for f in PERSON_FIELDS[1:] if f in (fields or PERSON_FIELDS)]
    kinds = ", ".join(f"{f} array<double>" for f in wanted)
    rows = spark.read.format("npz").schema(f"path string, frame_indices long{', ' + kinds if kinds else ''}").option("layout", "rows").option("pattern", "person_*.npz").load(root)
    part = lambda k: F.element_at(F.split("path", "/"), k)
    keys = [part(-4).alias("scene_id"), part(-3).alias("video_id"), F.regexp_extract(part(-1), r"^person_(\d+)", 1).cast("long").alias("person_id")]
    return rows.where(part(-2) == "body_data").select(*keys, F.col("frame_indices").cast("int").alias("frame_idx"), *wanted)


def mask_archive_runs(spark: SparkSession, root: str, frames: list[int] | None = None) -> DataFrame:
    """Runs of the masks in ``<root>/<scene>/<video>/mask_data.npz``: pixels of one value, ``x_end`` included.

    ``frames``: only these are looked up in the archives.  Ids are the ones in the
    masks less one, since 0 is the background.
    """
    rows = archives.lookup(spark, root, None if frames is None else [f"mask_{f:06d}" for f in frames], "mask_", "mask_data.npz")
    part = lambda k: F.element_at(F.split("path", "/"), k)
    found = rows.select(part(-3).alias("scene_id"), part(-2).alias("video_id"), F.regexp_extract("key", r"^mask_(\d+)", 1).cast("int").alias("frame_idx"), "kind", "shape", "data")
    return found.mapInArrow(_mask_runs, "scene_id string, video_id string, frame_idx int, person_id long, y int, x_start int, x_end int")


def _mask_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            mask = np.frombuffer(r["data"], np.dtype(r["kind"])).reshape(r["shape"]).astype(np.int64)
            if mask.ndim != 2:
                raise ValueError(f"{r['video_id']}, frame {r['frame_idx']}: a mask has two axes, not {mask.ndim}")
            edge = np.ones((mask.shape[0], mask.shape[1] + 1), bool)
            edge[:, 1:-1] = mask[:, 1:] != mask[:, :-1]
            y, x = np.nonzero(edge[:, :-1])
            stop = np.nonzero(edge[:, 1:])[1]
            value = mask[y, x]
            own = value > 0
            n = int(own.sum())
            columns = [pa.array([r["scene_id"]] * n, pa.string()), pa.array([r["video_id"]] * n, pa.string()), pa.array([r["frame_idx"]] * n, pa.int32()), pa.array(value[own] - 1), *(pa.array(v[own].astype(np.int32)) for v in (y, x, stop))]
            yield pa.record_batch(columns, names=["scene_id", "video_id", "frame_idx", "person_id", "y", "x_start", "x_end"])


def pose_archives(spark: SparkSession, root: str) -> DataFrame:
    """``scene_id``, ``video_a``, ``video_b``, ``rotation`` and ``translation`` of ``<root>/<scene>/camera_alignment.npz``."""
    rows = archives.lookup(spark, root, pattern="camera_alignment.npz").where(F.col("key").contains("__to__"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [np.frombuffer(d, np.dtype(k)).astype(np.float64).tolist() for d, k in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(values, pa.list_(pa.float64()))], names=["scene_id", "key", "value"])

    scene = F.element_at(F.split("path", "/"), -2).alias("scene_id")
    found = rows.select(scene, "key", "data", "kind").mapInArrow(numbers, "scene_id string, key string, value array<double>")
    return pairwise_poses(found, keys=["scene_id"])


def persons_to_sync(rows: DataFrame, field: str = "pred_keypoints_3d") -> DataFrame:
    """Rows with keypoints, each with confidence 1."""
    return rows.where(F.col(field).isNotNull() & (F.size(field) > 0)).withColumn("conf", F.lit(1.0))


def persons_in_summary(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows of the persons that the summary names and that have frames."""
    keys = [k for k in ("scene_id", "video_id", "person_id") if k in summary.columns]
    return rows.where(F.col("frame_idx").isNotNull()).join(summary.select(*keys).distinct(), keys, "left_semi")


def mask_of_frame(masks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The mask of each wanted (video, frame); null where there is none."""
    keys = [k for k in ("scene_id", "video_id", "frame_idx") if k in wanted.columns]
    return wanted.join(masks, keys, "left")


_MATRIX = "struct<rows: int, cols: int, data: string>"


def calibrations(rows: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Extrinsics (12), intrinsics (9) and distortion of calibration files; a missing tag is null."""
    parsed = F.from_xml(F.col(xml_col), f"CameraMatrix {_MATRIX}, Intrinsics {_MATRIX}, Distortion {_MATRIX}")

    def numbers(tag: str) -> Column:
        text = F.trim(F.regexp_replace(F.coalesce(F.col(f"c.{tag}.data"), F.lit("")), r"\s+", " "))
        values = F.when(text == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(text, " "), lambda x: x.cast("double")))
        return F.when(F.col(f"c.{tag}").isNotNull(), values)

    found = rows.withColumn("c", parsed)
    return found.select(*[c for c in rows.columns if c != xml_col], numbers("CameraMatrix").alias("extrinsics"), numbers("Intrinsics").alias("intrinsics"), numbers("Distortion").alias("distortion"))


def calibration_files(spark: SparkSession, root: str) -> DataFrame:
    """Calibrations of ``<root>/<scene>/.../<camera>.xml``."""
    rows = listing(spark, root, ("xml",), with_content=True)
    return calibrations(rows.select(_level(0).alias("scene_id"), _stem(F.col("path")).alias("cam"), F.col("content").cast("string").alias("xml")))


def pairwise_poses(rows: DataFrame, key: str = "key", value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Rotation and translation of each pair of videos from rows keyed ``a__to__b__R`` and ``a__to__b__t``.

    Keys that do not name two videos are skipped; so are pairs without both.
    """
    part = F.substring_index(key, "__", -1)
    pair = F.expr(f"left({key}, length({key}) - length(substring_index({key}, '__', -1)) - 2)")
    names = F.split(pair, "__to__")
    found = rows.where(part.isin("R", "t")).withColumns({"part": part, "names": names}).where(F.size("names") == 2)
    out = found.groupBy(*(keys or []), F.get("names", F.lit(0)).alias("video_a"), F.get("names", F.lit(1)).alias("video_b")).agg(F.max(F.when(F.col("part") == "R", F.col(value))).alias("rotation"), F.max(F.when(F.col("part") == "t", F.col(value))).alias("translation"))
    return out.where("rotation IS NOT NULL AND translation IS NOT NULL")


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no output yet; running a step again does only this."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
