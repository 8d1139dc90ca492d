"""The archive data source on real archives that numpy writes."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.sources import archives, files


@pytest.fixture(autouse=True)
def registered(spark):
    archives.register(spark)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def spoil(path, *keep):
    """Overwrite the compressed bytes of all members but some: opening one of these fails."""
    raw = bytearray(path.read_bytes())
    with zipfile.ZipFile(path) as z:
        for i in z.infolist():
            if i.filename.removesuffix(".npy") not in keep:
                at = i.header_offset + 30 + len(i.filename)
                raw[at + 20 : at + 20 + max(0, i.compress_size - 20)] = bytes(max(0, i.compress_size - 20))
    path.write_bytes(raw)


@pytest.fixture
def people(tmp_path):
    """Two persons in one scene: frames, a matrix a frame, and a member that only one has."""
    r = np.random.default_rng(1)
    data = {}
    for p, n in ((1, 2500), (12, 3)):
        at = tmp_path / "s" / "cam0" / "body_data" / f"person_{p}.npz"
        at.parent.mkdir(parents=True, exist_ok=True)
        data[p] = {"frame_indices": np.arange(n) * 2, "pred_keypoints_3d": r.normal(size=(n, 4, 3)).astype(np.float32), "smplx_betas": r.normal(size=(n, 10)), "focal_length": r.normal(size=(n, 1)), "other": r.normal(size=(n, 50))}
        if p == 1:
            data[p]["bbox"] = np.asfortranarray(r.normal(size=(n, 4)))
        np.savez_compressed(at, **data[p])
    np.savez(tmp_path / "s" / "cam0" / "body_data" / "notes.npz", x=np.zeros(3))
    return tmp_path, data


def test_rows_are_the_arrays(spark, people):
    root, data = people
    got = files.person_archives(spark, str(root))
    assert got.columns == ["scene_id", "video_id", "person_id", "frame_idx", *files.PERSON_FIELDS[1:]]
    found = {(r["person_id"], r["frame_idx"]): r for r in got.collect()}
    assert len(found) == 2503
    for p, own in data.items():
        for k, f in enumerate(own["frame_indices"].tolist()):
            r = found[p, f]
            assert r["scene_id"] == "s" and r["video_id"] == "cam0" and r["smplx_transl"] is None
            assert np.array_equal(r["pred_keypoints_3d"], own["pred_keypoints_3d"][k].reshape(-1).astype(float)) and np.array_equal(r["smplx_betas"], own["smplx_betas"][k])
            assert r["focal_length"] == own["focal_length"][k].tolist()
            assert r["bbox"] == (own["bbox"][k].tolist() if p == 1 else None)


def test_only_the_members_asked_for_are_opened(spark, people):
    root, data = people
    for p in data:
        spoil(root / "s" / "cam0" / "body_data" / f"person_{p}.npz", "smplx_betas", "frame_indices")
    read = lambda kinds: spark.read.format("npz").schema(f"path string, row long, opened int, {kinds}").option("layout", "rows").option("pattern", "person_*.npz").load(str(root))
    assert read("smplx_betas array<double>").where("opened = 2").count() == 2503  # betas, and the index's header
    assert read("frame_indices int").where("opened = 1").count() == 2503
    got = files.person_archives(spark, str(root), ["smplx_betas"])
    assert got.where("person_id = 12").count() == 3 and got.columns[-1] == "smplx_betas"
    with pytest.raises(Exception, match="damaged archive"):
        read("other array<double>").collect()


def test_keys_are_looked_up(spark, tmp_path):
    at = tmp_path / "s" / "v" / "mask_data.npz"
    at.parent.mkdir(parents=True)
    masks = {f"mask_{f:06d}": np.random.default_rng(f).integers(0, 3, (5, 7)).astype(np.uint16) for f in range(40)}
    np.savez_compressed(at, **masks)
    spoil(at, "mask_000007", "mask_000031")
    df = spark.read.format("npz").load(str(tmp_path))
    look = lambda *keys, **o: archives.lookup(spark, str(tmp_path), [*keys], **o)
    one = look("mask_000007").collect()
    assert len(one) == 1 and one[0]["shape"] == [5, 7] and one[0]["kind"] == "<u2" and one[0]["data"] == masks["mask_000007"].tobytes()
    assert rows(look("mask_000031", "mask_999999", "mask_000007"), "key") == [("mask_000007",), ("mask_000031",)]
    assert rows(look("mask_000031", "mask_000007", prefix="mask_00003"), "key") == [("mask_000031",)]
    assert look("nothing").count() == 0 and look().count() == 0 and look("mask_000007", pattern="other.npz").count() == 0
    # the directory alone tells the keys: no member is opened
    assert spark.read.format("npz").schema("key string").load(str(tmp_path)).count() == 40
    with pytest.raises(Exception, match="damaged archive"):
        df.collect()
    runs = files.mask_archive_runs(spark, str(tmp_path), frames=[7, 31, 99])
    back = {f: np.zeros((5, 7), int) for f in (7, 31)}
    for r in runs.collect():
        assert (r["scene_id"], r["video_id"]) == ("s", "v")
        back[r["frame_idx"]][r["y"], r["x_start"] : r["x_end"] + 1] += r["person_id"] + 1
    assert all(np.array_equal(back[f], masks[f"mask_{f:06d}"]) for f in back)
    wanted = spark.createDataFrame([("s", "v", 7), ("s", "v", 99)], "scene_id string, video_id string, frame_idx int")
    assert files.mask_of_frame(runs, wanted).where("frame_idx = 99 AND y IS NULL").count() == 1


def test_large_archives_are_read_by_many_tasks(spark, tmp_path):
    for name, n in (("a", 50), ("b", 1), ("c", 1)):
        np.savez(tmp_path / f"{name}.npz", **{f"k{j}": np.full(400, j) for j in range(n)})
    df = spark.read.format("npz").option("target_mb", "0.05").load(str(tmp_path))
    assert df.rdd.getNumPartitions() >= 4
    assert rows(df, "key").count(("k0",)) == 3 and df.count() == 52
    assert archives.lookup(spark, str(tmp_path), ["k3"]).rdd.getNumPartitions() == 1
    # a filter before does not change what the same table has afterwards
    assert df.where("key = 'k3'").count() == 1 and df.count() == 52


def test_odd_archives(spark, tmp_path):
    def one(name, **arrays):
        (tmp_path / name).mkdir()
        np.savez_compressed(tmp_path / name / "x.npz", **arrays)
        return str(tmp_path / name)

    read = lambda path, kinds, **o: spark.read.format("npz").schema(kinds).option("layout", "rows").options(**o).load(path)
    short = one("short", a=np.arange(5), b=np.arange(3) / 2, c=np.array(7.5), e=np.zeros((0, 4)))
    assert rows(read(short, "row int, a long, b double, c double, e array<double>, f string")) == [(0, 0, 0.0, 7.5, None, None), (1, 1, 0.5, 7.5, None, None), (2, 2, 1.0, 7.5, None, None), (3, 3, None, 7.5, None, None), (4, 4, None, 7.5, None, None)]
    assert rows(read(short, "b double", index="a")) == [(0.0,), (0.5,), (1.0,), (None,), (None,)]
    assert read(short, "b double").count() == 3 and read(short, "c double").count() == 0 and read(short, "e array<double>").count() == 0
    big = one("big", a=np.arange(3, dtype=">i4"), t=np.array([True, False, True]), n=np.array([np.nan, np.inf, 1.0]))
    assert [str(r) for r in rows(read(big, "a int, t boolean, n double"))] == ["(0, True, nan)", "(1, False, inf)", "(2, True, 1.0)"]
    empty = one("empty")
    assert read(empty, "a int").count() == 0 and spark.read.format("npz").load(empty).count() == 0
    bare = tmp_path / "bare"
    bare.mkdir()
    assert spark.read.format("npz").load(str(bare)).count() == 0
    with pytest.raises(Exception, match="FileNotFound|not exist|No such"):
        spark.read.format("npz").load(str(tmp_path / "missing")).count()
    with pytest.raises(Exception, match="one"):
        read(one("wide", a=np.zeros((2, 3))), "a double").collect()


def test_damaged_archives(spark, tmp_path):
    good = tmp_path / "good.npz"
    np.savez_compressed(good, a=np.random.default_rng(1).normal(size=(2000, 3)), b=np.arange(2000))
    raw = good.read_bytes()
    (tmp_path / "cut.npz").write_bytes(raw[: len(raw) // 2])
    (tmp_path / "none.npz").write_bytes(b"")
    np.savez(tmp_path / "pickled.npz", a=np.array([{}, []], object))
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:  # the header promises more than there is
        array = io.BytesIO()
        np.save(array, np.zeros((9, 3)))
        z.writestr("a.npy", array.getvalue()[:-8])
    (tmp_path / "brief.npz").write_bytes(body.getvalue())
    spoiled = tmp_path / "crc.npz"
    spoiled.write_bytes(raw)
    spoil(spoiled, "b")
    df = spark.read.format("npz").schema("path string, a array<double>, error string").option("layout", "rows")
    with pytest.raises(Exception, match="damaged archive"):
        df.load(str(tmp_path)).collect()
    got = df.option("damaged", "report").load(str(tmp_path))
    bad = {r["path"].rpartition("/")[2]: r for r in got.where("error IS NOT NULL").collect()}
    assert sorted(bad) == ["brief.npz", "crc.npz", "cut.npz", "none.npz", "pickled.npz"] and all(r["a"] is None and r["path"] in r["error"] for r in bad.values())
    assert got.where(F.col("path").endswith("good.npz") & F.col("a").isNotNull()).count() == 2000
    members = spark.read.format("npz").option("damaged", "report").option("target_mb", "0.001").load(str(tmp_path))
    assert members.where(F.col("path").endswith("cut.npz")).count() == 1  # told once, however many tasks there are
    assert members.where(F.col("path").endswith("good.npz") & F.col("data").isNotNull()).count() == 2


def test_poses(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    np.savez(tmp_path / "s1" / "camera_alignment.npz", a__to__b__R=turn, a__to__b__t=np.array([1.0, 2, 3]), a__to__c__to__d__R=turn, a__to__c__to__d__t=turn[0], a__to__e__R=turn, x=turn)
    assert rows(files.pose_archives(spark, str(tmp_path))) == [("s1", "a", "b", turn.reshape(-1).tolist(), [1.0, 2.0, 3.0])]


def test_round_trip(spark, tmp_path):
    data = [("s", "v", 1, 3, [1.0, 2.0], 5.0, None), ("s", "v", 1, 1, [3.0, 4.0], 6.0, [1.0]), ("s", "v", 2, 0, [7.0], 8.0, [2.0]), ("s", "w", 1, 0, [9.0], 1.0, [3.0])]
    df = spark.createDataFrame(data, "scene_id string, video_id string, person_id long, frame_idx int, smplx_betas array<double>, focal double, bbox array<double>")
    name = F.concat_ws("/", "scene_id", "video_id", F.lit("body_data"), F.concat(F.lit("person_"), "person_id", F.lit(".npz")))
    made = archives.write_rows(df.withColumn("frame_indices", F.col("frame_idx")), str(tmp_path), ["scene_id", "video_id", "person_id"], "frame_idx", ["frame_indices", "smplx_betas", "bbox"], name)
    assert sorted(r["n_rows"] for r in made.collect()) == [1, 1, 2]
    with np.load(tmp_path / "s/v/body_data/person_1.npz") as z:
        assert sorted(z.files) == ["frame_indices", "smplx_betas"] and z["smplx_betas"].tolist() == [[3.0, 4.0], [1.0, 2.0]]
    back = files.person_archives(spark, str(tmp_path), ["smplx_betas", "bbox"])
    assert rows(back, "video_id", "person_id", "frame_idx", "smplx_betas", "bbox") == [("v", 1, 1, [3.0, 4.0], None), ("v", 1, 3, [1.0, 2.0], None), ("v", 2, 0, [7.0], [2.0]), ("w", 1, 0, [9.0], [3.0])]
    assert not list(tmp_path.rglob("*.part"))
