"""Re-identification as a stream: the batch fold with its state kept between micro-batches.

Frames of a video must come in order, as the frame source gives them, and the
pairs seen together are a table beside the stream (``covisible_pairs``).  Without
such a table, or out of order, see ``covisibility``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Config
from ..operators.reid import Fold, Gallery, folded_frame, ordered_frames


def frames(spark: SparkSession, path: str, schema: str, files_at_a_time: int = 1) -> DataFrame:
    """Parquet files of frames as they arrive, oldest first, some in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).option("latestFirst", "false").parquet(path)


def saved(fold: Fold) -> str:
    pairs = lambda d: [[k, v] for k, v in d.items()]
    return json.dumps({"gallery": [[k, v.tolist()] for k, v in fold.gallery.items()], "remap": pairs(fold.remap), "left": pairs(fold.left)})


def restored(text: str, cfg: Config) -> Fold:
    held = json.loads(text)
    fold = Fold(set(), cfg)
    fold.gallery = Gallery({k: np.array(v) for k, v in held["gallery"]})
    fold.remap, fold.left = dict(held["remap"]), dict(held["left"])
    return fold


def reidentify_stream(rows: DataFrame, together: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``video_id, frame_idx, ord, person_id, canonical_id`` of a stream of
    ``video_id, frame_idx, ord, person_id, feature``; of rows with one canonical
    id in a frame the last stays.  A frame must not be split between micro-batches.
    """
    both = together.select("video_id", "person_a", "person_b").union(together.select("video_id", F.col("person_b"), F.col("person_a")))
    partners = both.groupBy("video_id", F.col("person_a").alias("person_id")).agg(F.collect_set("person_b").alias("partners"))
    kind = dict(rows.dtypes)["video_id"]
    out = f"video_id {kind}, frame_idx int, ord long, person_id long, canonical_id long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = restored(state.get[0], cfg) if state.exists else Fold(set(), cfg)
        held = pd.concat(list(batches))
        fold.together = {frozenset((int(p), int(q))) for p, own in zip(held.person_id, held.partners) if own is not None for q in own}
        found = []
        for f, persons in ordered_frames(held):
            found += [(key[0], f, o, p, c) for o, p, c in folded_frame(fold, persons)]
        state.update((saved(fold),))
        yield pd.DataFrame(found, columns=["video_id", "frame_idx", "ord", "person_id", "canonical_id"])

    joined = rows.join(partners, ["video_id", "person_id"], "left").select("video_id", "frame_idx", "ord", "person_id", "feature", "partners")
    return joined.groupBy("video_id").applyInPandasWithState(step, out, "fold string", "append", GroupStateTimeout.NoTimeout)
