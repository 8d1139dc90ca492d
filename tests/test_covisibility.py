"""The stream that counts pairs itself against the batch forms, with frames in disorder."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from posegrid.operators import reid
from posegrid.operators import tracks as trk
from posegrid.streaming import covisibility as cv
from posegrid.streaming import fold

SCHEMA = "video_id string, frame_idx int, ord long, person_id long, feature array<double>, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def at(f: int) -> dt.datetime:
    return T0 + dt.timedelta(seconds=f)


def scene(seed: int, frames: int = 40) -> list[tuple]:
    """Persons who leave and come back under new ids; some two ids overlap for a few frames."""
    r = np.random.default_rng(seed)
    base = r.normal(0, 1, (3, 8))
    rows, n = [], 0
    for f in range(frames):
        for p in range(3):
            if (f + 3 * p) % 11 == 0:
                continue
            for person in {p + 10 * ((f + 3 * p) // 11), p + 10 * ((f + 3 * p + seed) // 11)}:
                v = base[p] + 0.1 * r.normal(0, 1, 8)
                rows.append((f"v{seed}", f, n, person, None if r.random() < 0.1 else (v / np.linalg.norm(v)).tolist(), at(f)))
                n += 1
    return rows


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cv._PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, tmp_path, batches, delay, gap=None):
    """What comes out, the rows of one file in each micro-batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = cv.reidentify_unscanned(fold.frames(spark, str(tmp_path / "in"), SCHEMA), delay, gap)
    q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((tuple(r) for r in spark.read.schema("video_id string, frame_idx int, ord long, person_id long, canonical_id long").parquet(str(tmp_path / "out")).collect()), key=str)


#: Pushes the watermark past everything else.
END = [("end", 0, 0, 0, None, at(100_000))]


def shuffled(rows, seed, parts, spread):
    """Rows in batches by their time and some noise, so frames are out of order and split."""
    r = np.random.default_rng(seed)
    place = np.array([x[1] for x in rows]) + r.integers(-spread, spread + 1, len(rows))
    order = np.argsort(place, kind="stable")
    return [[rows[k] for k in some] for some in np.array_split(order, parts)]


def test_whole_recordings_are_the_batch(spark, tmp_path):
    # one person leaves and comes back as 10; that they are two is seen only later
    two = [("x", f, f, 0, [1.0, 0.0], at(f)) for f in [*range(10), *range(20, 25)]] + [("x", f, 100 + f, 10, [0.9, 0.1], at(f)) for f in [*range(10, 15), *range(20, 25)]]
    rows = scene(1) + scene(2) + two
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((tuple(r) for r in reid.reidentify(df, trk.covisible_pairs(df)).collect()), key=str)
    assert any(p != c for *_, p, c in want)
    assert want != sorted((tuple(r) for r in reid.reidentify_so_far(df).collect()), key=str)
    got = streamed(spark, tmp_path, [*shuffled(rows, 1, 4, 8), END], "20 seconds", "30 seconds")
    assert got == want


def test_prompt_frames_are_the_batch_so_far(spark, tmp_path):
    rows = scene(3) + scene(4)
    want = sorted((tuple(r) for r in reid.reidentify_so_far(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    got = streamed(spark, tmp_path, [*shuffled(rows, 2, 4, 8), END], "20 seconds")
    assert got == want


def test_late_rows_have_a_defined_end(spark, tmp_path):
    rows = scene(5)
    first, late = [x for x in rows if x[1] >= 5], [x for x in rows if x[1] < 5]
    again = [("v5", 200 + f, 10_000 + n, p, v, at(60_000 + f)) for _, f, n, p, v, _ in rows[:20]]
    # the second file lies behind the watermark, the third begins after the video was over
    got = streamed(spark, tmp_path, [first + [("w", 0, 0, 1, None, at(50_000))], late, again, END], "10 seconds", "100 seconds")
    df = lambda some: spark.createDataFrame(some, SCHEMA)
    parts = [reid.reidentify(df(x), trk.covisible_pairs(df(x))).collect() for x in (first, again)]
    behind = [("v5", f, n, p, None) for _, f, n, p, _, _ in late]
    assert got == sorted((tuple(r) for r in [*parts[0], *parts[1], *behind, ("w", 0, 0, 1, 1)]), key=str)


def test_rows_of_a_frame_that_was_given_out(spark, tmp_path):
    early = [("v", f, f, 1, [1.0, 0.0], at(f)) for f in range(5)]
    wrong = [("v", 2, 90, 7, [0.0, 1.0], at(200)), (None, 1, 1, 1, None, at(200)), ("v", None, 1, 1, None, at(200))]
    got = streamed(spark, tmp_path, [early + [("w", 0, 0, 1, None, at(100))], wrong, END], "10 seconds")
    assert got == sorted([("v", f, f, 1, 1) for f in range(5)] + [("v", 2, 90, 7, None), ("w", 0, 0, 1, 1)], key=str)
