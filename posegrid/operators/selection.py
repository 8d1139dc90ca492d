"""Exact medians and percentiles of groups of any size.

A group of few values is sorted where it lies (``median`` keeps a group's distinct
values in one task).  In a larger one the value is narrowed down by counting: the
values' bits, in an order that is that of the numbers, are looked at sixteen at
a time; each round counts the values by their next sixteen bits, and the count
that reaches the rank says which bits the value begins with.  Four rounds give
all 64 bits.  Counts are added before they are shuffled, and no task ever holds
more than the 65,536 counts of one group.

Nulls do not count; NaN is greater than every number, and -0.0 is 0.0, as Spark
sorts them.  A group without values has a null.  Null keys are a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

#: Groups of at most so many values are sorted in one task.
SMALL = 1 << 16
#: Large groups up to this number are sent to all tasks.
MANY = 100_000
BITS = 16


@F.arrow_udf(LongType())
def ordered_bits(v: pa.Array) -> pa.Array:
    """A number's bits as a long that sorts as the number does."""
    x = v.to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pa.array(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.arrow_udf(DoubleType())
def number_of(bits: pa.Array) -> pa.Array:
    b = bits.to_numpy(zero_copy_only=False)
    return pa.array((b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def same(keys: list[str], left: str = "l", right: str = "r") -> Column:
    """Equal keys, nulls included."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _ranks(n: Column, share: float, discrete: bool) -> Column:
    """The ranks, from 0, of the values that a percentile is made of."""
    if discrete:
        return F.array(F.greatest(F.ceil(n * F.lit(share)) - 1, F.lit(0)).cast("long"))
    at = (n - 1) * F.lit(share)
    return F.array(F.floor(at).cast("long"), F.ceil(at).cast("long"))


def at_ranks(rows: DataFrame, keys: list[str], targets: DataFrame, few: bool) -> DataFrame:
    """``keys``, ``which`` and ``v``: the values of large groups at the ranks of ``targets``
    (``keys``, ``which``, ``rank``).  ``rows`` has ``keys`` and the bits ``o``."""
    small = F.broadcast if few else (lambda df: df)
    found = targets.withColumn("prefix", F.lit(None).cast("long"))
    for shift in range(64 - BITS, -1, -BITS):
        first = shift == 64 - BITS
        begins = same(keys) if first else same(keys) & (F.shiftright("l.o", shift + BITS) == F.col("r.prefix"))
        live = rows.alias("l").join(small(found.select(*keys, "prefix").distinct().alias("r")), begins, "left_semi")
        counts = live.groupBy(*keys, F.shiftright("o", shift).alias("next")).agg(F.count(F.lit(1)).alias("m"))
        fits = same(keys) if first else same(keys) & (F.shiftright("l.next", BITS) == F.col("r.prefix"))
        met = counts.alias("l").join(small(found.alias("r")), fits).select(*[f"l.{k}" for k in keys], "which", "rank", "next", "m")
        upto = F.sum("m").over(Window.partitionBy(*keys, "which").orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("before", upto - F.col("m")).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("m")))
        found = met.select(*keys, "which", (F.col("rank") - F.col("before")).alias("rank"), F.col("next").alias("prefix"))
    return found.select(*keys, "which", number_of("prefix").alias("v"))


def percentile(rows: DataFrame, keys: list[str], value: str, share: float = 0.5, discrete: bool = False, small: int = SMALL) -> DataFrame:
    """``keys`` and ``percentile`` of each group, exactly; interpolated, or ``discrete`` one of the values.

    The groups' sizes are counted first; they decide how each is done.
    """
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    own = rows.select(*keys, F.col(value).cast("double").alias("v"))
    sizes = own.groupBy(*keys).agg(F.count("v").alias("n"))
    plain = F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY v)") if discrete else F.percentile("v", share)
    n_large = sizes.agg(F.count_if(F.col("n") > small)).first()[0]
    if not n_large:
        return own.groupBy(*keys).agg(plain.alias("percentile"))
    few = n_large <= MANY
    large = sizes.where(F.col("n") > small)
    hint = F.broadcast if few else (lambda df: df)
    rest = own.alias("l").join(hint(large.select(*keys).alias("r")), same(keys), "left_anti").groupBy(*keys).agg(plain.alias("percentile"))
    big = own.where(F.col("v").isNotNull()).alias("l").join(hint(large.select(*keys).alias("r")), same(keys), "left_semi")
    targets = large.select(*keys, F.posexplode(_ranks(F.col("n"), share, discrete)).alias("which", "rank"))
    found = at_ranks(big.select(*keys, ordered_bits("v").alias("o")), keys, targets, few)
    at = (F.col("r.n") - 1) * F.lit(share)
    both = found.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high")).alias("l").join(hint(large.alias("r")), same(keys))
    mixed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil(at) - at) * F.col("low") + (at - F.floor(at)) * F.col("high"))
    return rest.unionByName(both.select(*[f"l.{k}" for k in keys], mixed.alias("percentile")))


def medians(rows: DataFrame, keys: list[str], values: list[str], small: int = SMALL) -> DataFrame:
    """``keys`` and the median of each value, under its own name.

    Where no group is large, all values are done together.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if not sizes.agg(F.count_if(F.col("n") > small)).first()[0]:
        return rows.groupBy(*keys).agg(*[F.median(F.col(v).cast("double")).alias(v) for v in values])
    out = None
    for v in values:
        one = percentile(rows, keys, v, small=small).withColumnRenamed("percentile", v)
        out = one if out is None else out.alias("l").join(one.alias("r"), same(keys)).select("l.*", f"r.{v}")
    return out
