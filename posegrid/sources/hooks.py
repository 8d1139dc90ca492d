"""Places for what is not Spark's work: decoders, networks, body models, pickles.

A hook is a function from pandas frames to pandas frames that runs in the tasks
(``mapInPandas``).  The schemas are fixed here; what a hook returns is checked
against them by Spark.  Nothing of a model is reimplemented.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Hook = Callable[[pd.DataFrame], pd.DataFrame]

SCHEMAS = {
    "probe": "scene_id string, video_id string, num_frames int, fps double, duration_s double, img_w int, img_h int",
    "ground_truth": "scene_id string, frame_idx int, person_id long, field string, value array<double>",
    "segment": "video_id string, frame_idx int, person_id long, score double, y int, x_start int, x_end int",
    "estimate": "video_id string, frame_idx int, person_id long, field string, value array<double>, feature array<double>",
    "convert": "video_id string, frame_idx int, person_id long, field string, value array<double>",
    "body_model": "video_id string, frame_idx int, person_id long, joint int, x double, y double, z double",
    "network": "scene_id string, frame_idx int, person_id long, output string, value array<double>",
}


def apply_hook(rows: DataFrame, kind: str, hook: Hook) -> DataFrame:
    """The hook's rows for each batch of input rows, in the schema of its kind."""
    names = [c.split()[0] for c in SCHEMAS[kind].split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = hook(b)
            yield out[names]

    return rows.mapInPandas(run, SCHEMAS[kind])


def convert(rows: DataFrame, hook: Hook, with_status: bool = False) -> DataFrame:
    """Body parameters in another model's terms; a row that fails has a null value and stays.

    The hook gets whole batches.  Only where it fails on one are its rows tried one by
    one, so a bad row costs its own batch and no other.  ``with_status`` adds the
    failure's text as ``status``, null where there is none.
    """
    names = [c.split()[0] for c in SCHEMAS["convert"].split(", ")]

    def failed(one: pd.DataFrame, why: Exception) -> pd.DataFrame:
        field = one["field"] if "field" in one else ""
        return one.assign(field=field, value=None, status=f"{type(why).__name__}: {why}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                out = hook(b).assign(status=None)
            except Exception:  # noqa: BLE001  a model may fail in any way; its rows are told apart below
                parts = []
                for k in range(len(b)):
                    one = b.iloc[k : k + 1]
                    try:
                        parts.append(hook(one).assign(status=None))
                    except Exception as e:  # noqa: BLE001
                        parts.append(failed(one, e))
                out = pd.concat(parts) if parts else b.assign(field="", value=None, status=None)
            yield out[[*names, "status"]]

    found = rows.mapInPandas(run, SCHEMAS["convert"] + ", status string")
    return found if with_status else found.drop("status")
