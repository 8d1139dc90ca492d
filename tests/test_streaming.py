"""The streaming fold against the batch fold on the same rows."""

from __future__ import annotations

import numpy as np

from posegrid.operators import reid
from posegrid.sources import files
from posegrid.streaming import fold

SCHEMA = "video_id string, frame_idx int, ord long, person_id long, feature array<double>"


def scene(seed: int) -> list[tuple]:
    """Persons who leave and come back under new ids, some too unlike anyone."""
    r = np.random.default_rng(seed)
    base = r.normal(0, 1, (4, 8))
    rows, n = [], 0
    for f in range(30):
        for p in range(4):
            if (f + p) % 7 == 0:
                continue
            v = base[p] + 0.05 * r.normal(0, 1, 8)
            person = p + 10 * ((f + p) // 7)
            feature = None if r.random() < 0.1 else (v / np.linalg.norm(v)).tolist()
            rows.append((f"v{seed}", f, n, person, feature))
            n += 1
    return rows


def test_stream_is_the_batch(spark, tmp_path):
    rows = scene(1) + scene(2)
    together = spark.createDataFrame([("v1", 0, 1), ("v1", 10, 11), ("v2", 0, 12)], "video_id string, person_a long, person_b long")
    want = sorted(map(tuple, reid.reidentify(spark.createDataFrame(rows, SCHEMA), together).collect()))
    assert len({c for *_, c in want}) < len({(v, p) for v, _, _, p, _ in want})
    for k in range(3):  # ten frames a file, one file a micro-batch
        some = [x for x in rows if x[1] // 10 == k]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = fold.reidentify_stream(fold.frames(spark, str(tmp_path / "in"), SCHEMA), together)

    def run():
        q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    assert run() == want
    assert run() == want  # what was done is not done again


def test_state_survives_a_round_trip():
    f = reid.Fold(set())
    f.frame([(1, np.array([1.0, 0.0])), (2, np.array([0.0, 1.0]))])
    g = fold.restored(fold.saved(f), f.cfg)
    assert g.remap == f.remap and g.left == f.left and g.gallery.keys() == f.gallery.keys()
    assert all(np.array_equal(g.gallery[k], f.gallery[k]) for k in f.gallery)


def test_only_what_is_not_done(spark):
    rows = spark.createDataFrame([(k,) for k in range(6)], "frame_idx int")
    assert sorted(r[0] for r in files.not_done(rows, rows.where("frame_idx < 4"), ["frame_idx"]).collect()) == [4, 5]
