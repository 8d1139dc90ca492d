"""Whole-number vectors: floors of scaled components, distances and sums that never round.

Components whose squares and sums fit 64 bits are held as int64 (narrow); any
others, up to the largest double, as Python integers (wide).  Sums leave a task
in limbs of 24 bits, which Spark adds as longs.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMB = 24
LONG_MAX = (1 << 63) - 1
SUMS = "g int, entry int, dim int, limb int, value long"


def limit(dim: int) -> int:
    """Components up to this are narrow: squared distances of ``dim`` of them fit a long."""
    return min(math.isqrt((1 << 62) // max(dim, 1)) // 2, (1 << 30) - 1)


def finite_rows(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors (doubles) of each length; null, empty and non-finite ones are left out."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        x = values[begin[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(1)
        if good.any():
            yield rows[good], x[good]


def floors(x: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """``floor(factor * x)``, exactly, as doubles where the row is narrow (second: which rows are)."""
    with np.errstate(over="ignore"):
        out = np.floor(x * factor)
    return out, (np.abs(out) <= limit(x.shape[1])).all(1)


def whole(v: float, factor: int) -> int:
    return int(v) * factor if abs(v) >= 1 << 53 else math.floor(v * factor)


def fits(c: list[int]) -> bool:
    return all(abs(v) <= limit(len(c)) for v in c)


def squared(x: np.ndarray, center: list[int]) -> np.ndarray:
    """Squared distances of the rows of ``x`` to a vector: int64, or Python integers."""
    if x.dtype != object and fits(center):
        d = x - np.array(center, np.int64)
        return np.einsum("ij,ij->i", d, d)
    d = x.astype(object) - np.array(center, object)
    return (d * d).sum(1) if len(d) else np.zeros(0, object)


def numbers(values: list[int], wide: bool) -> bytes:
    """A canonical form of a vector, for keys and files."""
    return b"w" + ",".join(map(str, values)).encode() if wide else b"\0" + np.array(values, "<i4").tobytes()


def limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield k, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        k += 1


class Sums:
    """Exact sums by (g, entry, dim), given out in limbs."""

    def __init__(self):
        self.held: dict[tuple[int, int, int], int] = defaultdict(int)

    def add(self, g: int, entry: int, dim: int, value: int) -> None:
        self.held[g, entry, dim] += value

    def rows(self) -> list[dict]:
        return [{"g": g, "entry": e, "dim": d, "limb": k, "value": v} for (g, e, d), total in self.held.items() for k, v in limbs(total)]


def totals(sums: DataFrame) -> dict[tuple[int, int, int], int]:
    """The sums of all tasks; a row for each limb of each sum reaches the driver."""
    out: dict[tuple[int, int, int], int] = defaultdict(int)
    for r in sums.groupBy("g", "entry", "dim", "limb").agg(F.sum("value").alias("value")).collect():
        out[r["g"], r["entry"], r["dim"]] += r["value"] << (LIMB * r["limb"]) if r["value"] >= 0 else -(-r["value"] << (LIMB * r["limb"]))
    return out


def as_long(value: int) -> int | None:
    """The number, or None where a long can't hold it."""
    return value if abs(value) <= LONG_MAX else None


def peeked(batches: Iterator[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, Iterator[pa.RecordBatch]]:
    """The first batch, which tells the types, and all of them."""
    first = next(batches, None)
    return first, iter(()) if first is None else chain([first], batches)
