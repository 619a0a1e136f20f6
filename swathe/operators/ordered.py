"""Ordered scans that do not put a whole key into one task.

A plain window over ``PARTITION BY run ORDER BY frame`` sorts all of a run in a
single task. Here each key is cut into blocks of its order column, the window
runs per (key, block), and only one summary row per block is carried forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def blocked_scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    specs: dict[str, tuple[str, Column]],
    block: int = BLOCK,
    ties: list[str] = (),
) -> DataFrame:
    """Add running columns along ``order`` within ``keys``.

    ``specs`` maps a new column to (kind, expression); kinds are ``lag``,
    ``lead``, ``sum``, ``max``, ``min`` and ``last`` (newest non-null so far,
    this row included). ``order`` with ``ties`` must be a total order per key.
    """
    position = [F.col(order), *[F.col(t) for t in ties]]
    rank = F.struct(*position)
    base = df.withColumn("__scan_b", F.floor(F.col(order) / block))
    for name, (_, expr) in specs.items():
        base = base.withColumn(f"__v_{name}", expr)
    w = Window.partitionBy(*keys, "__scan_b").orderBy(*position)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    inner, summary, carry, final = {}, [], {}, {}
    wb = Window.partitionBy(*keys).orderBy("__scan_b")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in specs.items():
        v, s, c, n = F.col(f"__v_{name}"), f"__s_{name}", f"__c_{name}", F.col(f"__i_{name}")
        if kind == "lag":
            inner[name] = F.lag(v).over(w)
            summary.append(F.max_by(v, rank).alias(s))
            carry[c] = F.lag(s).over(wb)
            final[name] = F.when(F.col("__scan_first"), F.col(c)).otherwise(n)
        elif kind == "lead":
            inner[name] = F.lead(v).over(w)
            summary.append(F.min_by(v, rank).alias(s))
            carry[c] = F.lead(s).over(wb)
            final[name] = F.when(F.col("__scan_last"), F.col(c)).otherwise(n)
        elif kind == "sum":
            inner[name] = F.sum(v).over(upto)
            summary.append(F.sum(v).alias(s))
            carry[c] = F.sum(s).over(before)
            final[name] = F.when(F.col(c).isNull(), n).otherwise(F.col(c) + F.coalesce(n, F.lit(0)))
        elif kind in ("max", "min"):
            agg, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            inner[name] = agg(v).over(upto)
            summary.append(agg(v).alias(s))
            carry[c] = agg(s).over(before)
            final[name] = pick(n, F.col(c))
        elif kind == "last":
            inner[name] = F.last(v, ignorenulls=True).over(upto)
            summary.append(F.max_by(v, F.when(v.isNotNull(), rank)).alias(s))
            carry[c] = F.last(s, ignorenulls=True).over(before)
            final[name] = F.coalesce(n, F.col(c))
        else:
            raise ValueError(f"unknown scan kind {kind}")

    edges = {
        "__scan_first": F.lag(F.lit(True), 1, False).over(w) == F.lit(False),
        "__scan_last": F.lead(F.lit(True), 1, False).over(w) == F.lit(False),
    }
    scanned = base.select("*", *[e.alias(n) for n, e in edges.items()],
                          *[e.alias(f"__i_{n}") for n, e in inner.items()])
    blocks = base.groupBy(*keys, "__scan_b").agg(*summary)
    carried = blocks.select(
        *[c.alias(f"__k_{k}") for k, c in ((k, F.col(k)) for k in keys)], F.col("__scan_b").alias("__k_block"),
        *[e.alias(n) for n, e in carry.items()],
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__scan_b") == F.col("__k_block")]
    joined = scanned.join(carried, on, "left")
    return joined.select(*df.columns, *[e.alias(n) for n, e in final.items()])


def islands(df: DataFrame, keys: list[str], order: str, starts: Column, name: str = "island", **kw) -> DataFrame:
    """Number of starts seen so far: rows of one unbroken stretch share a value."""
    flag = F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return blocked_scan(df, keys, order, {name: ("sum", flag)}, **kw)


def sequence_number(df: DataFrame, order: list[str], name: str, block: int = BLOCK) -> DataFrame:
    """0-based position in a global total order, without sorting all rows in one task.

    The first order column must be a whole number; rows are ranked within
    blocks of it and shifted by the counts of the earlier blocks, themselves
    summed per group of blocks.
    """
    first = order[0]
    based = df.withColumn("__b", F.floor(F.col(first) / block))
    counts = based.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__g", F.floor(F.col("__b") / 4096))
    groups = counts.groupBy("__g").agg(F.sum("__n").alias("__gn"))
    wg = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("__g", F.coalesce(F.sum("__gn").over(wg), F.lit(0)).alias("__g0"))
    wc = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__b0", F.coalesce(F.sum("__n").over(wc), F.lit(0))).join(groups, "__g")
    starts = starts.select("__b", (F.col("__b0") + F.col("__g0")).alias("__start"))
    wr = Window.partitionBy("__b").orderBy(*order)
    ranked = based.withColumn("__r", F.row_number().over(wr) - 1)
    return ranked.join(starts, "__b").select(*df.columns, (F.col("__r") + F.col("__start")).cast("long").alias(name))
