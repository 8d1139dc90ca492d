"""Connected components of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so neither a component nor a hub's
links meet in one task, and nothing is sent to the driver but a count and a sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` (a, b) with a > b, rewired to the least neighbour."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``root`` (the least id of its component) of every linked id, as a written table.

    ``links`` has two columns of ids in any order; nulls and self-links drop out.
    Each round's table is deleted when the next one stands.
    """
    x, y = links.columns
    links = links.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    links = written(links, "links")
    before = _state(links)
    while before[0]:
        last, links = links, written(_star(_star(links, True), False), "links")
        drop(last)
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("a").alias("id"), F.col("b").alias("root")).union(links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
    out = written(roots, "roots")
    drop(links)
    return out
