"""Readers, writers and hooks on small files in folders that the tests make."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from posegrid import config
from posegrid.sources import files, hooks, sinks


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture
def tree(tmp_path):
    for name in ("s1/a/cam01.mp4", "s1/aria01.MKV", "s1/ego_preview.avi", "s2/deep/er/cam 2.AVI", "s3/note.txt", "top.mp4", "s4/cam9.mp4"):
        at = tmp_path / "videos" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x")
    return str(tmp_path / "videos")


def test_video_tree(spark, tree):
    assert rows(files.video_tree(spark, tree), "scene_id", "video_id") == [("s1", "cam01"), ("s2", "cam 2"), ("s4", "cam9")]
    assert rows(files.video_tree(spark, tree, first=1, drop_aria=False), "video_id") == [("aria01",), ("cam01",)]
    assert rows(files.video_tree(spark, tree + "/", first=2), "scene_id") == [("s1",), ("s2",)]


def test_image_sequences(spark, tmp_path):
    for name in ("s1/cam_0/1.jpg", "s1/cam_0/2.JPEG", "s1/cam_1/1.bmp", "s1/cam_2/frames/1.jpg", "s2/1.jpg", "s2/cam_0/x.txt"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x")
    assert rows(files.image_sequences(spark, str(tmp_path)), "scene_id", "video_id", "n_images", "fps", "duration_s") == [("s1", "cam_0", 2, 30.0, 0.0), ("s1", "cam_1", 1, 30.0, 0.0)]


def test_frame_source(spark):
    videos = spark.createDataFrame([("given", "/g", "/v/a.mp4"), ("empty", "/none", "/v/b.mp4"), ("sub", None, "/d"), ("plain", None, "/e"), ("bare", None, "/f")], "video_id string, frames_dir string, path string")
    images = spark.createDataFrame([("/g",), ("/g",), ("/d/frames",), ("/d",), ("/e",)], "dir string")
    assert rows(files.frame_source(videos, images), "video_id", "source", "dir", "n_frames") == [("bare", "none", "/f", 0), ("empty", "decode", "/v/b.mp4", 0), ("given", "given", "/g", 2), ("plain", "folder", "/e", 1), ("sub", "frames", "/d/frames", 1)]


def test_label_files(spark, tmp_path):
    at = tmp_path / "s1" / "cam" / "json_data"
    at.mkdir(parents=True)
    box = {"instance_id": 3, "class_name": "person", "x1": 1, "y1": 2, "x2": 30, "y2": 40, "score": 0.5}
    (at / "mask_000042.json").write_text(json.dumps({"mask_height": 9, "labels": {"3": box}}))
    (at / "mask_000043.json").write_text(json.dumps({"mask_height": 9}))
    (at / "summary.json").write_text("{}")
    assert rows(files.label_files(spark, str(tmp_path)), "scene_id", "video_id", "frame_idx", "person_id", "x2", "score") == [("s1", "cam", 42, 3, 30.0, 0.5)]


def test_calibration_files(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    numbers = " ".join(str(k / 2) for k in range(12))
    (tmp_path / "s1" / "000.xml").write_text(f'<?xml version="1.0"?>\n<opencv_storage><CameraMatrix type_id="opencv-matrix"><rows>3</rows><cols>4</cols><dt>d</dt><data>\n  {numbers}\n </data></CameraMatrix></opencv_storage>')
    r = files.calibration_files(spark, str(tmp_path)).first()
    assert (r["scene_id"], r["cam"], r["extrinsics"], r["intrinsics"], r["distortion"]) == ("s1", "000", [k / 2 for k in range(12)], None, None)


@pytest.fixture
def people(spark):
    data = [("s", "v", 1, 0, [1.0, 2.0], None, [9.0]), ("s", "v", 1, 2, None, None, None), ("s", "v", 1, 1, [3.0, 4.0], None, [8.0]), ("s", "v", 2, 0, None, None, [7.0])]
    return spark.createDataFrame(data, "scene_id string, video_id string, person_id long, frame_idx int, smplx_betas array<double>, shape_params array<double>, bbox array<double>")


def test_tracks_are_dense(spark, people, tmp_path):
    sinks.write_tracks(people, str(tmp_path / "out"), ["smplx_betas", "shape_params", "bbox", "not_there"])
    back = spark.read.parquet(str(tmp_path / "out/persons"))
    assert "shape_params" not in back.columns
    assert rows(back, "person_id", "frame_idx", "smplx_betas", "bbox") == [(1, 0, [1.0, 2.0], [9.0]), (1, 1, [3.0, 4.0], [8.0]), (1, 2, [0.0, 0.0], [0.0]), (2, 0, None, [7.0])]
    assert rows(spark.read.parquet(str(tmp_path / "out/summary")), "person_id", "num_frames", "first_frame", "last_frame", "len_bbox") == [(1, 3, 0, 2, 1), (2, 1, 0, 0, 1)]


def test_persons_read_only_known_columns(spark, people, tmp_path):
    people.withColumn("unknown", F.lit(1)).write.parquet(str(tmp_path / "p"))
    found = files.persons(spark, str(tmp_path / "p"))
    assert found.columns == ["scene_id", "video_id", "person_id", "frame_idx", "smplx_betas", "bbox"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "unknown" not in plan and "shape_params" not in plan
    assert files.persons(spark, str(tmp_path / "p"), ["bbox"]).columns[-1] == "bbox"


def test_all_person_fields_are_read(spark, tmp_path):
    assert len(set(files.PERSON_FIELDS)) == 13
    spark.range(3).select(F.col("id").alias("person_id"), *[F.lit(k).alias(f) for k, f in enumerate(files.PERSON_FIELDS)]).write.parquet(str(tmp_path / "p"))
    assert files.persons(spark, str(tmp_path / "p")).columns == ["person_id", *files.PERSON_FIELDS]


def test_large_files_beside_the_wanted_ones_are_not_read(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "000.XML").write_text("<o><CameraMatrix><rows>1</rows><cols>2</cols><data>1 2</data></CameraMatrix></o>")
    (tmp_path / "s1" / "000.mp4").write_bytes(bytes(5000))
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert rows(files.calibration_files(spark, str(tmp_path)), "cam", "extrinsics") == [("000", [1.0, 2.0])]
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


def test_other_writers(spark, tmp_path):
    g = spark.createDataFrame([("s", "v", 1, [1.0])], "scene_id string, video_id string, person_id long, descriptor array<double>")
    sinks.write_gallery(g, str(tmp_path / "g"))
    assert rows(spark.read.parquet(str(tmp_path / "g")), "person_id", "descriptor") == [(1, [1.0])]
    m = spark.createDataFrame([("s", "v", 4, 1)], "scene_id string, video_id string, old_id long, new_id long")
    sinks.write_remaps(m, m.withColumn("new_id", F.lit(7)), str(tmp_path / "m"))
    assert rows(spark.read.parquet(str(tmp_path / "m")), "level", "old_id", "new_id") == [("scene", 4, 7), ("video", 4, 1)]
    p = spark.createDataFrame([("s", "a", "b", [1.0] * 9, [0.0] * 3)], "scene_id string, video_a string, video_b string, rotation array<double>, translation array<double>")
    sinks.write_poses(p, str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p")), "video_a", "video_b", "translation") == [("a", "b", [0.0] * 3)]
    report = spark.createDataFrame([("s", "a", "b", 40, 0.5, 2.0), ("s", "a", "c", 3, None, None)], "scene_id string, video_a string, video_b string, n long, rmse double, t_length double")
    sinks.write_report(report, str(tmp_path / "r"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "r"))
    assert back.columns == ["scene_id", "vid_a", "vid_b", "n", "rmse_m", "|t|_m"] and rows(back, "vid_b", "n", "rmse_m") == [("b", "40", "0.5"), ("c", "3", None)]


def test_masks_are_compacted(spark, tmp_path):
    masks = spark.createDataFrame([("s", "v", f, 1, 0, f, f + 2) for f in range(50)], "scene_id string, video_id string, frame_idx int, person_id long, y int, x_start int, x_end int").repartition(10)
    sinks.compact_masks(masks, str(tmp_path / "m"))
    assert len(list((tmp_path / "m").rglob("*.parquet"))) == 1
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == 50
    wanted = spark.createDataFrame([("s", "v", 7), ("s", "v", 99)], "scene_id string, video_id string, frame_idx int")
    assert rows(files.mask_of_frame(back, wanted), "frame_idx", "x_end") == [(7, 9), (99, None)]


def test_hooks_keep_their_schemas(spark):
    crops = spark.createDataFrame([("v", 0, 1, "pose", [1.0]), ("v", 0, 2, "pose", [-1.0])], "video_id string, frame_idx int, person_id long, field string, value array<double>")

    def halve(b: pd.DataFrame) -> pd.DataFrame:
        if any(v[0] < 0 for v in b["value"]):
            raise RuntimeError("no fit")
        return b.assign(value=[[x / 2 for x in v] for v in b["value"]])

    assert rows(hooks.convert(crops, halve), "person_id", "value") == [(1, [0.5]), (2, None)]
    told = {r["person_id"]: r["status"] for r in hooks.convert(crops, halve, with_status=True).collect()}
    assert told == {1: None, 2: "RuntimeError: no fit"}
    boxes = hooks.apply_hook(crops, "segment", lambda b: pd.DataFrame({"video_id": b.video_id, "frame_idx": b.frame_idx, "person_id": b.person_id, "score": 0.9, "y": 1, "x_start": 2, "x_end": 5}))
    assert rows(boxes, "person_id", "x_end") == [(1, 5), (2, 5)]
    for kind in hooks.SCHEMAS:
        assert hooks.apply_hook(crops, kind, lambda b: b).schema is not None


def test_config_from_yaml():
    c = config.from_yaml("parameters_extraction:\n  reid_threshold: 0.55\n  gallery_moving_average_alpha: 0.85\ndata:\n  rich_max_side: null\nother: 1\n")
    assert (c.reid_threshold, c.ema_alpha, c.max_side, c.retry_window) == (0.55, 0.85, 1440, 5)
    assert config.from_yaml("") == config.DEFAULT
