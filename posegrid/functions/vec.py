"""Vectors and 3 x 3 matrices as Spark expressions (arrays of doubles, row-major)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, least: float = 1e-8) -> Column:
    """The unit vector; a vector shorter than ``least`` is divided by it."""
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x / n)


def items(a: Column, n: int) -> list[Column]:
    return [a[k] for k in range(n)]


def matmul(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """Product of two 3 x 3 matrices, given and returned as nine columns."""
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def transposed(a: Sequence[Column]) -> list[Column]:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def apply(a: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [a[3 * i] * v[0] + a[3 * i + 1] * v[1] + a[3 * i + 2] * v[2] for i in range(3)]


def skew(v: Sequence[Column]) -> list[Column]:
    zero = F.lit(0.0)
    return [zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero]


def hybrid(appearance: Column, shape: Column, wa: float = 0.7, ws: float = 0.3) -> Column:
    """Weighted appearance and unit shape side by side, as one unit vector."""
    unit = normalised(shape)
    return normalised(F.concat(F.transform(appearance, lambda x: x * wa), F.transform(unit, lambda x: x * ws)))


def fitted(a: Column, n: int) -> Column:
    """The first ``n`` components, zeros beyond the end."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), n)), 1, n)


def pooled_feature(channels: Column) -> Column:
    """Mean over the places of each channel (an array of arrays), made unit."""
    return normalised(F.transform(channels, lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)))


def positional_encoding(position: Column, dim: int) -> Column:
    """Sines at even and cosines at odd places, of falling frequency."""
    rate = [10000.0 ** (-(k - k % 2) / dim) for k in range(dim)]
    return F.array(*[(F.sin if k % 2 == 0 else F.cos)(position * F.lit(r)) for k, r in enumerate(rate)])


def full_pose(orient: Column, body: Column, *rest: Column, joints: int = 55) -> Column:
    """All joints' axis-angle numbers: orientation, body, then hands and face where they are
    there, zeros up to the full length; null without orientation or body."""
    parts = F.concat(orient, body, *[F.coalesce(r, F.array().cast("array<double>")) for r in rest])
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0.0), 3 * joints)), 1, 3 * joints)


def distance_2d(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def limb_radius(y1: Column, y2: Column) -> Column:
    """Of the capsules that a body is drawn with: a part of its box's height, 3 pixels at least."""
    return F.greatest(F.lit(3), F.floor(F.greatest(F.lit(1.0), (y2 - y1).cast("double")) / 24).cast("int"))


def head_radius(limb: Column, neck_to_head: Column) -> Column:
    return F.greatest(limb, F.floor(neck_to_head * 0.6).cast("int"))
