"""Re-identification of a stream that needs no pass over the recording before.

Which persons were seen together is counted while frames arrive, in state that is
keyed by video: a map of pair counts, a map of frames that wait, and the fold.
Frames may come out of order and in pieces; event time (``ts``) says when one is
complete.  Two ways:

* ``whole``: a video that has been silent for ``gap`` is over.  Only then are its
  frames folded, with the counts of the whole recording, so the result is that
  of ``reidentify`` over a finished table.
* ``prompt``: a frame is folded as soon as the watermark has passed it, with the
  pairs counted in the frames up to it.  The result is that of
  ``reidentify_so_far`` over a finished table.

Defined results: a late row, which the watermark had passed before it came, takes
no part and comes out with a null ``canonical_id``; with ``prompt`` so does a row of
a frame that has been given out, or of one before it; with ``whole``, what a video
sends after it was over is a recording of its own.  Rows without a video, frame,
place, person or time are left out.
Of rows with one canonical id in a frame the last stays, as in the batch form.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..config import DEFAULT, Config
from ..operators.reid import Fold, folded_frame
from .fold import restored, saved

#: Rows of output that a task holds at a time.
ROWS = 4096
_OUT = ["video_id", "frame_idx", "ord", "person_id", "canonical_id"]
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Waiting(StatefulProcessor):
    """One video's frames until they are complete; see the module."""

    def __init__(self, cfg: Config, gap_ms: int | None):
        self.cfg, self.gap = cfg, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getMapState("pairs", "a long, b long", "n long")
        self.frames = handle.getMapState("frames", "frame_idx int", "due long, persons string")
        #: the fold, the last frame that was folded, and when the timer goes off
        self.fold = handle.getValueState("fold", "fold string, last int, timer long")

    def state(self) -> tuple[Fold, int | None, int | None]:
        if not self.fold.exists():
            return Fold(set(), self.cfg), None, None
        text, last, timer = self.fold.get()
        return restored(text, self.cfg), last, timer

    def wait_until(self, due: int, timer: int | None) -> int:
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        return due

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # what the watermark has passed is complete without these rows
        yield from self.folded(key, timerValues)
        fold, last, timer = self.state()
        limit, late, due = timerValues.getCurrentWatermarkInMs(), [], timer
        for some in rows:
            behind = some.due <= limit
            if last is not None:
                behind |= some.frame_idx <= last
            late += [(key[0], int(f), int(o), int(p), None) for f, o, p in zip(some.frame_idx[behind], some.ord[behind], some.person_id[behind])]
            some = some[~behind]
            for f, own in some.groupby("frame_idx", sort=True):
                at, text = self.frames.getValue((int(f),)) if self.frames.containsKey((int(f),)) else (0, "[]")
                held = json.loads(text)
                new = [[int(o), int(p), None if v is None else np.asarray(v, float).tolist()] for o, p, v in zip(own.ord, own.person_id, own.feature)]
                at = max(at, int(own.due.max()))
                if self.gap is not None:  # pieces of a frame add to the counts of what was there
                    before = {p for _, p, _ in held}
                    self.count(before, {p for _, p, _ in new} - before)
                    due = max(due or 0, at + self.gap)
                else:
                    due = at if due is None else min(due, at)
                self.frames.updateValue((int(f),), (at, json.dumps(held + new)))
        if due is not None:
            self.fold.update((saved(fold), last, self.wait_until(due, timer)))
        if late:
            yield pd.DataFrame(late, columns=_OUT).astype({"canonical_id": "Int64"})

    def count(self, before: set[int], new: set[int]) -> None:
        """A person that is new in a frame is seen together with all others of it."""
        for a, b in [*combinations(sorted(new), 2), *((min(p, q), max(p, q)) for p in before for q in new)]:
            n = self.pairs.getValue((a, b))[0] if self.pairs.containsKey((a, b)) else 0
            self.pairs.updateValue((a, b), (n + 1,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.folded(key, timerValues)

    def folded(self, key: tuple, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        """What is due at the watermark, in frame order."""
        fold, last, timer = self.state()
        limit = timerValues.getCurrentWatermarkInMs()
        if timer is None or timer > limit:
            return
        counts = Counter({(a, b): n for (a, b), (n,) in self.pairs.iterator()})
        fold.together = {frozenset(p) for p, n in counts.items() if n >= self.cfg.covisible_frames}
        waiting = sorted((int(k[0]), int(v[0])) for k, v in self.frames.iterator())
        changed, out = Counter(), []
        for f, due in waiting:
            if self.gap is None and due > limit:
                break  # frames are folded in their order
            persons = sorted(json.loads(self.frames.getValue((f,))[1]), key=lambda r: r[0])
            if self.gap is None:
                for pair in combinations(sorted({p for _, p, _ in persons}), 2):
                    counts[pair] += 1
                    changed[pair] = counts[pair]
                    if counts[pair] >= self.cfg.covisible_frames:
                        fold.together.add(frozenset(pair))
            out += [(key[0], f, o, p, c) for o, p, c in folded_frame(fold, persons)]
            self.frames.removeKey((f,))
            last = f
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=_OUT).astype({"canonical_id": "Int64"})
                out = []
        self.handle.deleteTimer(timer)
        if self.gap is not None:
            for state in (self.pairs, self.frames, self.fold):
                state.clear()
        else:
            for pair, n in changed.items():
                self.pairs.updateValue(pair, (n,))
            left = [due for f, due in waiting if last is None or f > last]
            # what is due already waits for a frame before it
            following = max(min(left), limit + 1) if left else None
            if left:
                self.handle.registerTimer(following)
            self.fold.update((saved(fold), last, following))
        if out:
            yield pd.DataFrame(out, columns=_OUT).astype({"canonical_id": "Int64"})

    def close(self) -> None:
        pass


def reidentify_unscanned(rows: DataFrame, delay: str, gap: str | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """``video_id, frame_idx, ord, person_id, canonical_id`` of a stream of ``video_id,
    frame_idx, ord, person_id, feature, ts``.

    ``delay``: how late a row may be.  ``gap``: with it, the way is ``whole`` and a
    video silent for so long is over; without, it is ``prompt``.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != _PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {_PROVIDER}")
    kind = dict(rows.dtypes)["video_id"]
    gap_ms = None if gap is None else int(spark.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {gap}"))).alias("ms")).first()["ms"])
    own = rows.select("video_id", F.col("frame_idx").cast("int"), F.col("ord").cast("long"), F.col("person_id").cast("long"), F.col("feature").cast("array<double>"), F.col("ts").cast("timestamp").alias("ts"))
    own = own.dropna(subset=["video_id", "frame_idx", "ord", "person_id", "ts"]).withWatermark("ts", delay).withColumn("due", F.unix_millis("ts"))
    out = f"video_id {kind}, frame_idx int, ord long, person_id long, canonical_id long"
    return own.groupBy("video_id").transformWithStateInPandas(Waiting(cfg, gap_ms), out, "Append", "EventTime")
