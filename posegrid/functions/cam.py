"""Cameras as Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rot, vec


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def inverse_softplus(y: Column) -> Column:
    """Without overflow for large focal lengths."""
    return y + F.log(-F.expm1(-y))


def project(p: Sequence[Column], fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    z = p[2] + 1e-8
    return [fx * p[0] / z + cx, fy * p[1] / z + cy]


def rotation(prefix: str = "") -> list[Column]:
    return rot.quat_to_matrix(*(F.col(f"{prefix}{c}") for c in ("qw", "qx", "qy", "qz")))


def translation(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("tx", "ty", "tz")]


def centre(r: Sequence[Column], t: Sequence[Column]) -> list[Column]:
    """Camera centre: minus the transposed rotation applied to the translation."""
    return [-x for x in vec.apply(vec.transposed(r), t)]


def matrix_4x4(r: Sequence[Column], t: Sequence[Column]) -> Column:
    """Rotation and translation as one array of 16 numbers, row by row."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*r[0:3], t[0], *r[3:6], t[1], *r[6:9], t[2], zero, zero, zero, one)


def inverse(r: Sequence[Column], t: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """Camera-to-world from world-to-camera: the transposed rotation and the camera's centre."""
    return vec.transposed(r), centre(r, t)


def intrinsics(focal_raw: Column, width: Column, height: Column) -> Column:
    """The matrix K of a camera vector: its focal length, and the middle of the image."""
    f, zero = softplus(focal_raw), F.lit(0.0)
    return F.array(f, zero, width / 2, zero, f, height / 2, zero, zero, F.lit(1.0))


def fundamental(ri, ti, rj, tj, fi: Column, fj: Column, cx: float, cy: float) -> list[Column]:
    """The matrix F with ``xj' F xi = 0`` for images of one point in both cameras."""
    r = vec.matmul(rj, vec.transposed(ri))
    moved = vec.apply(r, ti)
    t = [tj[k] - moved[k] for k in range(3)]
    e = vec.matmul(vec.skew(t), r)
    zero, one = F.lit(0.0), F.lit(1.0)

    def inverse_k(f):
        return [1 / f, zero, -cx / f, zero, 1 / f, -cy / f, zero, zero, one]

    return vec.matmul(vec.transposed(inverse_k(fj)), vec.matmul(e, inverse_k(fi)))


def epipolar_residual(f: Sequence[Column], xi: Sequence[Column], xj: Sequence[Column]) -> Column:
    line = vec.apply(f, [xi[0], xi[1], F.lit(1.0)])
    return xj[0] * line[0] + xj[1] * line[1] + line[2]
