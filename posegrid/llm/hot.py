"""Joins on keys whose counts are known, some of which may be very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], frequent: Column) -> DataFrame:
    """Every row with its row of ``table``, which has one for each key that occurs.

    ``frequent`` says which keys of the table may stand for so many rows that
    they should not meet in one task; the caller knows a bound of their number,
    and they are broadcast.  All other keys are joined by a shuffle.  Null keys
    are equal.
    """
    renamed = table.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in table.columns if c not in keys), frequent.alias("_frequent"))
    hot, rest = renamed.where("_frequent").drop("_frequent"), renamed.where("not _frequent").drop("_frequent")
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    own = [f"_{k}" for k in keys]
    near = rows.join(F.broadcast(hot), same).drop(*own)
    far = rows.join(F.broadcast(hot.select(*own)), same, "left_anti").join(rest, same).drop(*own)
    return near.unionByName(far)
