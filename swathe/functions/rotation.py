"""Rotations and poses on flat columns r00..r22, tx, ty, tz."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import Vec, add, dot, sub

R_NAMES = [f"r{i}{j}" for i in range(3) for j in range(3)]
POSE = R_NAMES + ["tx", "ty", "tz"]
Mat = list[list[Column]]


def matrix(prefix: str = "r") -> Mat:
    return [[F.col(f"{prefix}{i}{j}") for j in range(3)] for i in range(3)]


def transpose(m: Mat) -> Mat:
    return [[m[j][i] for j in range(3)] for i in range(3)]


def compose(a: Mat, b: Mat) -> Mat:
    return [[sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(3)] for i in range(3)]


def apply(m: Mat, v: Vec) -> Vec:
    return tuple(dot(tuple(m[i]), v) for i in range(3))


def to_world(v: Vec, m: Mat, t: Vec) -> Vec:
    """``R p + t``."""
    return add(apply(m, v), t)


def to_sensor(w: Vec, m: Mat, t: Vec) -> Vec:
    """``R^T (w - t)``: the inverse of an orthonormal pose."""
    return apply(transpose(m), sub(w, t))


def angle(m: Mat) -> Column:
    """Rotation angle in radians from the trace, clipped against rounding."""
    c = (m[0][0] + m[1][1] + m[2][2] - 1) / 2
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def rodrigues(v: Vec) -> Mat:
    """Matrix of a rotation vector, exact near zero by its series."""
    theta2 = dot(v, v)
    theta = F.sqrt(theta2)
    small = theta2 < 1e-16
    a = F.when(small, F.lit(1.0)).otherwise(F.sin(theta) / theta)
    b = F.when(small, F.lit(0.5)).otherwise((1 - F.cos(theta)) / theta2)
    x, y, z = v
    one = F.lit(1.0)
    return [
        [one - b * (y * y + z * z), b * x * y - a * z, b * x * z + a * y],
        [b * x * y + a * z, one - b * (x * x + z * z), b * y * z - a * x],
        [b * x * z - a * y, b * y * z + a * x, one - b * (x * x + y * y)],
    ]


def rotation_vector(m: Mat) -> Vec:
    """Axis times angle of a matrix, the inverse of ``rodrigues`` for angles below a half turn."""
    v = tuple((m[(k + 2) % 3][(k + 1) % 3] - m[(k + 1) % 3][(k + 2) % 3]) / 2 for k in range(3))
    sine = F.sqrt(dot(v, v))
    scale = F.when(sine < 1e-12, F.lit(1.0)).otherwise(F.atan2(sine, (m[0][0] + m[1][1] + m[2][2] - 1) / 2) / sine)
    return tuple(scale * x for x in v)


def quaternion(m: Mat) -> list[Column]:
    """(w, x, y, z) of a rotation matrix; the largest component is taken first."""
    t = m[0][0] + m[1][1] + m[2][2]
    w2 = 1 + t
    x2 = 1 + 2 * m[0][0] - t
    y2 = 1 + 2 * m[1][1] - t
    z2 = 1 + 2 * m[2][2] - t
    top = F.greatest(w2, x2, y2, z2)
    d = 2 * F.sqrt(top)
    pick = lambda w, x, y, z: F.when(w2 == top, w).when(x2 == top, x).when(y2 == top, y).otherwise(z)
    big = F.sqrt(top) / 2
    yz, zx, xy = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    sxy, szx, syz = m[1][0] + m[0][1], m[0][2] + m[2][0], m[2][1] + m[1][2]
    return [
        pick(big, yz / d, zx / d, xy / d),
        pick(yz / d, big, sxy / d, szx / d),
        pick(zx / d, sxy / d, big, syz / d),
        pick(xy / d, szx / d, syz / d, big),
    ]


def from_quaternion(q: list[Column]) -> Mat:
    w, x, y, z = q
    one = F.lit(1.0)
    return [
        [one - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), one - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), one - 2 * (x * x + y * y)],
    ]


def slerp(a: list[Column], b: list[Column], t: Column) -> list[Column]:
    """Spherical interpolation of unit quaternions along the shorter arc."""
    d0 = sum((p * q for p, q in zip(a[1:], b[1:])), a[0] * b[0])
    sign = F.when(d0 < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    d = F.least(F.lit(1.0), F.abs(d0))
    th = F.acos(d)
    s = F.sin(th)
    flat = s < 1e-9
    wa = F.when(flat, 1 - t).otherwise(F.sin((1 - t) * th) / s)
    wb = F.when(flat, t).otherwise(F.sin(t * th) / s) * sign
    return [wa * p + wb * q for p, q in zip(a, b)]
