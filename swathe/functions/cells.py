"""Cell keys of a regular grid: the hash side of every spatial join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import Vec

CELL = ["ci", "cj", "ck"]
HALF_RANGE = 1 << 20  # packed keys hold 21 bits per axis


def cell_of(v: Vec, size: float) -> list[Column]:
    return [F.floor(c / size).alias(name) for c, name in zip(v, CELL)]


def packed_key(v: Vec, size: float) -> Column:
    """One long per cell inside +/-2^20 cells, null outside (use the three keys there)."""
    i, j, k = (F.floor(c / size) for c in v)
    inside = F.lit(True)
    for c in (i, j, k):
        inside = inside & (c >= -HALF_RANGE) & (c < HALF_RANGE)
    shifted = (
        F.shiftleft(i + HALF_RANGE, 42) + F.shiftleft(j + HALF_RANGE, 21) + (k + HALF_RANGE)
    )
    return F.when(inside, shifted)


def offsets(ring: int, half: bool = False) -> Column:
    """Array literal of neighbour offsets within ``ring`` cells.

    ``half`` keeps the offsets at or after (0, 0, 0) in natural order, so that
    each unordered pair of cells meets once.
    """
    span = range(-ring, ring + 1)
    rows = [(a, b, c) for a in span for b in span for c in span]
    if half:
        rows = [r for r in rows if r >= (0, 0, 0)]
    text = ",".join(f"named_struct('a',{a}L,'b',{b}L,'c',{c}L)" for a, b, c in rows)
    return F.expr(f"array({text})")


def explode_neighbours(df: DataFrame, ring: int, half: bool = False) -> DataFrame:
    """One row per neighbouring cell; the key columns move to the neighbour.

    The planner counts an exploded row once, so the join must not be left to
    it: it would gather the copies on the driver.
    """
    keep = [c for c in df.columns if c not in CELL]
    return df.select(*keep, *CELL, F.explode(offsets(ring, half)).alias("__o")).select(
        *keep,
        (F.col("ci") + F.col("__o.a")).alias("ci"),
        (F.col("cj") + F.col("__o.b")).alias("cj"),
        (F.col("ck") + F.col("__o.c")).alias("ck"),
    ).hint("merge")


def explode_box(df: DataFrame, lo: Vec, hi: Vec, size: float) -> DataFrame:
    """One row per cell touched by the box lo..hi."""
    names = ["__a0", "__b0", "__c0", "__a1", "__b1", "__c1"]
    bounds = [F.floor(c / size).alias(n) for c, n in zip([*lo, *hi], names)]
    cells = F.expr(
        "flatten(transform(sequence(__a0, __a1), i -> flatten(transform(sequence(__b0, __b1),"
        " j -> transform(sequence(__c0, __c1), k -> named_struct('ci', i, 'cj', j, 'ck', k))))))"
    )
    keep = df.columns
    return df.select(*keep, *bounds).select(*keep, F.explode(cells).alias("__cell")).select(*keep, "__cell.*")
