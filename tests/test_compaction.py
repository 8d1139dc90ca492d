"""Compaction that is stopped after each step and each file."""

from __future__ import annotations

import pytest

from posegrid.sources import compaction as cp

KEYS, ORDER = ["scene_id", "video_id"], ["frame_idx", "y"]


class Stopped(Exception):
    pass


@pytest.fixture
def masks(spark, tmp_path):
    rows = [("s" if f % 3 else "t", f"v{f % 2}", f, 1, y, 5 * y) for f in range(30) for y in range(3)] + [("s", "v1", 7, 1, 0, 0)] * 2
    df = spark.createDataFrame(rows, "scene_id string, video_id string, frame_idx int, person_id long, y int, x_start int")
    path = str(tmp_path / "masks")
    df.repartition(8).write.partitionBy(*KEYS).parquet(path)
    return path, rows


def rows_of(df):
    return sorted(tuple(r) for r in df.select("scene_id", "video_id", "frame_idx", "person_id", "y", "x_start").collect())


def files(path):
    from pathlib import Path

    return [p for p in Path(path).rglob("*.parquet")]


def test_few_files_with_the_same_rows(spark, masks):
    path, rows = masks
    before = len(files(path))
    told = cp.compact(spark, path, KEYS, ORDER)
    assert told == {"before": before, "after": 4, "rows": len(rows)} and len(files(path)) == 4 < before
    assert rows_of(spark.read.parquet(path)) == rows_of(cp.live(spark, path)) == sorted(rows)
    one = spark.read.parquet(str(files(path)[0])).collect()
    assert [(r["frame_idx"], r["y"]) for r in one] == sorted((r["frame_idx"], r["y"]) for r in one)
    assert cp.compact(spark, path, KEYS, ORDER)["after"] == 4 and cp.recover(spark, path) == "nothing"


@pytest.mark.parametrize("step", ["begun", "written", "verified", "published", "one deleted", "deleted", "one moved", "moved"])
def test_stopped_anywhere(spark, masks, step):
    path, rows = masks
    calls = []

    def after(s):
        calls.append(s)
        if s == step and (not s.startswith("one") or calls.count(s) == 2):
            raise Stopped

    with pytest.raises(Stopped):
        cp.compact(spark, path, KEYS, ORDER, after)
    assert rows_of(cp.live(spark, path)) == sorted(rows)  # whole at that moment
    if step in ("begun", "written", "verified"):
        assert rows_of(spark.read.parquet(path)) == sorted(rows)
    late = spark.createDataFrame([("s", "v1", 99, 1, 0, 0)], "scene_id string, video_id string, frame_idx int, person_id long, y int, x_start int")
    late.write.mode("append").partitionBy(*KEYS).parquet(path)  # arrives in between
    want = sorted([*rows, ("s", "v1", 99, 1, 0, 0)])
    assert rows_of(cp.live(spark, path)) == want
    assert cp.recover(spark, path) == ("undone" if step in ("begun", "written", "verified") else "finished")
    assert rows_of(spark.read.parquet(path)) == want and cp.recover(spark, path) == "nothing"
    assert cp.compact(spark, path, KEYS, ORDER)["rows"] == len(want) and rows_of(spark.read.parquet(path)) == want


def test_what_differs_is_not_published(spark, masks):
    path, rows = masks
    before = sorted(files(path))

    def spoil(step):
        if step == "written":
            from pathlib import Path

            aside = next(Path(path).glob("_compaction-*/"))
            next(aside.rglob("*.parquet")).unlink()

    with pytest.raises(ValueError, match="nothing was changed"):
        cp.compact(spark, path, KEYS, ORDER, spoil)
    assert sorted(files(path)) == before and rows_of(spark.read.parquet(path)) == sorted(rows)


def test_empty_folder(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert cp.compact(spark, str(tmp_path / "e"), KEYS, ORDER) == {"before": 0, "after": 0, "rows": 0}


def test_checksum_tells_rows_apart(spark):
    df = lambda rows: spark.createDataFrame(rows, "a int, b string")
    one = cp.checksum(df([(1, "x"), (2, None), (2, None)]).repartition(3))
    assert one == cp.checksum(df([(2, None), (1, "x"), (2, None)]))
    for other in ([(1, "x"), (2, None)], [(1, "x"), (1, "x"), (2, None)], [(1, None), (2, "x"), (2, None)]):
        assert cp.checksum(df(other)) != one
