"""Rotations as Spark expressions.  Conventions are in the names: quaternions are
(w, x, y, z); six numbers are the first two columns of the matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vec


def quat_to_matrix(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    one = F.lit(1.0)
    return [
        one - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), one - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), one - 2 * (x * x + y * y),
    ]


def axis_angle_to_matrix(v: Sequence[Column]) -> list[Column]:
    """Rodrigues' formula; below an angle of 1e-8 the identity plus the skew matrix."""
    a = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    small = a < 1e-8
    s = F.when(small, F.lit(1.0)).otherwise(F.sin(a) / a)
    c = F.when(small, F.lit(0.5)).otherwise((1 - F.cos(a)) / (a * a))
    k = vec.skew(v)
    kk = vec.matmul(k, k)
    return [F.lit(1.0 if i % 4 == 0 else 0.0) + s * k[i] + c * kk[i] for i in range(9)]


def matrix_to_sixd(m: Sequence[Column]) -> list[Column]:
    return [m[0], m[3], m[6], m[1], m[4], m[7]]


def sixd_to_matrix(s: Sequence[Column]) -> list[Column]:
    """Gram-Schmidt on the two columns; the third is their cross product."""
    n = F.sqrt(s[0] * s[0] + s[1] * s[1] + s[2] * s[2])
    a = [x / n for x in s[:3]]
    d = a[0] * s[3] + a[1] * s[4] + a[2] * s[5]
    b = [s[3 + i] - d * a[i] for i in range(3)]
    n = F.sqrt(b[0] * b[0] + b[1] * b[1] + b[2] * b[2])
    b = [x / n for x in b]
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return [v[i] for i in range(3) for v in (a, b, c)]


def matrix_to_quat(m: Sequence[Column]) -> list[Column]:
    """(w, x, y, z) with w >= 0, by the largest of the trace and the diagonal."""
    t = m[0] + m[4] + m[8]

    def branch(w, x, y, z):
        n = F.sqrt(w * w + x * x + y * y + z * z)
        sign = F.when(w < 0, -1.0).otherwise(1.0)
        return [sign * c / n for c in (w, x, y, z)]

    by_w = branch(1 + t, m[7] - m[5], m[2] - m[6], m[3] - m[1])
    by_x = branch(m[7] - m[5], 1 + m[0] - m[4] - m[8], m[1] + m[3], m[2] + m[6])
    by_y = branch(m[2] - m[6], m[1] + m[3], 1 + m[4] - m[0] - m[8], m[5] + m[7])
    by_z = branch(m[3] - m[1], m[2] + m[6], m[5] + m[7], 1 + m[8] - m[0] - m[4])
    return [F.when(t > 0, by_w[k]).when((m[0] >= m[4]) & (m[0] >= m[8]), by_x[k]).when(m[4] >= m[8], by_y[k]).otherwise(by_z[k]) for k in range(4)]


def quat_to_axis_angle(q: Sequence[Column]) -> list[Column]:
    s = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    k = F.when(s < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(s, q[0]) / s)
    return [k * q[i] for i in (1, 2, 3)]


def matrix_to_axis_angle(m: Sequence[Column]) -> list[Column]:
    return quat_to_axis_angle(matrix_to_quat(m))


def geodesic_degrees(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Angle of the rotation between two rotation matrices."""
    trace = sum((a[k] * b[k] for k in range(1, 9)), a[0] * b[0])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
