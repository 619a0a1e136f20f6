"""3-vectors as tuples of three double columns, so every operation stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    """``vec("x", "y", "z")`` or ``vec("l")`` for the columns lx, ly, lz."""
    if len(names) == 1:
        names = tuple(names[0] + axis for axis in "xyz")
    return tuple(F.col(n).cast("double") for n in names)


def const(x: float, y: float, z: float) -> Vec:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Vec, factor: Column | float) -> Vec:
    return tuple(p * factor for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def unit(a: Vec, eps: float = 1e-10) -> Vec:
    """Unit vector; null where the length is below ``eps``."""
    n = norm(a)
    return tuple(F.when(n >= eps, p / n) for p in a)


def named(a: Vec, prefix: str) -> list[Column]:
    return [p.alias(prefix + axis) for p, axis in zip(a, "xyz")]
