"""Pairs of persons seen in the same frames, counted in blocks of persons.

A video's persons are dealt into groups, and each two groups meet in one task: what
moves is a copy of a group's frames for each group it meets, and only pairs seen
together often enough leave the task.  There blocks of persons are counted against
blocks in a table of counts, so neither memory nor what is shuffled grows with the
pairs of a frame.

Defined results: a row without a video, frame or person takes no part; a person
counts once in a frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

#: Rows of a group (about), persons of a block, and meetings counted at once.
ROWS, BLOCK, STEP = 1 << 17, 2048, 1 << 22


class Side:
    """A group's rows: persons by rank, frames by rank, in order of frame within each block of persons."""

    def __init__(self, person: np.ndarray, frame: np.ndarray, block: int):
        order = np.lexsort((frame, person // block))
        person, frame = person[order], frame[order]
        cuts = np.searchsorted(person // block, np.arange((int(person.max()) if len(person) else -1) // block + 2))
        self.blocks = [(k * block, person[s:e] - k * block, frame[s:e]) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:]))]


def together(a: tuple, b: tuple, block: int, step: int) -> np.ndarray:
    """How often each person of a block is seen with each of another: (block, block)."""
    (_, p, f), (_, q, g) = a, b
    low, high = np.searchsorted(g, f, side="left"), np.searchsorted(g, f, side="right")
    n = high - low
    ends = np.cumsum(n)
    out = np.zeros(block * block, np.int32)
    s = 0
    while s < len(f):
        # rows whose meetings go into a step; one row has at most a block of them
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + step, side="right")))
        own = n[s:e]
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(low[s:e], own)
        out += np.bincount(np.repeat(p[s:e], own) * block + q[at], minlength=len(out)).astype(np.int32)
        s = e
    return out.reshape(block, block)


def covisible_pairs(detections: DataFrame, cfg: Config = DEFAULT, rows: int = ROWS, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """Pairs of persons seen in the same frame often enough, and how often."""
    kinds = {c: detections.schema[c].dataType.simpleString() for c in ("video_id", "person_id")}
    least = max(1, cfg.covisible_frames)
    seen = detections.select("video_id", "frame_idx", "person_id").where("video_id IS NOT NULL AND frame_idx IS NOT NULL AND person_id IS NOT NULL")
    # videos are not so many that a row for each is much; the largest decides how many groups there are
    most = seen.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    groups = max(1, -(-most // rows))
    place = F.pmod(F.xxhash64("person_id"), F.lit(groups)).cast("int")
    own = seen.withColumn("g", place).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = own.select("video_id", "frame_idx", "person_id", "g", F.least("g", "other").alias("group_a"), F.greatest("g", "other").alias("group_b")).groupBy("video_id", "group_a", "group_b")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> Iterator[pa.Table]:
        video, one, other = key
        table = table.select(["person_id", "frame_idx", "g"]).combine_chunks()
        # persons by rank in their own order, so that less is smaller in any type
        ids = pc.unique(table["person_id"].combine_chunks())
        ids = ids.take(pc.array_sort_indices(ids))
        person = pc.index_in(table["person_id"], ids).to_numpy().astype(np.int64)
        frame = np.unique(table["frame_idx"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        group = table["g"].to_numpy()
        flat = np.unique(person * (frame.max() + 1) + frame, return_index=True)[1]
        person, frame, group = person[flat], frame[flat], group[flat]
        same = one.as_py() == other.as_py()
        names, sides = [], []
        for g in (one.as_py(),) if same else (one.as_py(), other.as_py()):
            who, local = np.unique(person[group == g], return_inverse=True)
            names.append(who)
            sides.append(Side(local, frame[group == g], block).blocks)
        for k, a in enumerate(sides[0]):
            for b in sides[0][k:] if same else sides[1]:
                count = together(a, b, block, step)
                i, j = np.nonzero(count >= least)
                n = count[i, j]
                p, q = names[0][a[0] + i], names[-1][b[0] + j]
                if same and a is b:
                    upper = i < j
                    p, q, n = p[upper], q[upper], n[upper]
                p, q = np.minimum(p, q), np.maximum(p, q)
                yield pa.table([pa.repeat(video, len(n)), ids.take(pa.array(p)), ids.take(pa.array(q)), pa.array(n.astype(np.int64))], names=["video_id", "person_a", "person_b", "n_frames"])

    def each(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in run(key, pa.Table.from_batches(batches)):
            yield from t.to_batches(max_chunksize=1 << 18)

    return met.applyInArrow(each, f"video_id {kinds['video_id']}, person_a {kinds['person_id']}, person_b {kinds['person_id']}, n_frames long")
