"""Quantiles. ``percentile`` keeps a group's distinct values in one buffer, which
is right for groups bounded by geometry (a section, a component). Groups that
grow with the data use ``exact_quantiles`` instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile(c: Column | str, q: float) -> Column:
    """Linear-interpolation quantile of a bounded group."""
    return F.percentile(c, F.lit(float(q)))


def _fused(a: Column, x: Column, z: Column) -> Column:
    """a * x + z, rounded once: the product's and the sum's own rounding errors are added last."""
    def halves(v: Column) -> tuple[Column, Column]:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    (ah, al), (xh, xl), p = halves(a), halves(x), a * x
    lost = ((ah * xh - p) + ah * xl + al * xh) + al * xl
    s = p + z
    back = s - p
    return s + (lost + ((p - (s - back)) + (z - back)))


def sorted_quantile(values: Column, q: float) -> Column:
    """``quantile_cont`` of a sorted array, to the last bit, so that a verdict at a limit is the SQL's.

    The SQL engine weighs the two neighbours with one fused step; a
    ``percentile`` may be one unit in the last place beside it.
    """
    pos = (F.size(values) - 1) * F.lit(float(q))
    k = F.floor(pos)
    a, b, d = F.get(values, k.cast("int")), F.get(values, F.ceil(pos).cast("int")), pos - k
    return F.when(F.size(values) > 0, F.when(d == 0, a).otherwise(_fused(a, 1 - d, b * d)))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], width: float
) -> DataFrame:
    """Exact linear-interpolation quantiles of groups of any size.

    1. equal values collapse to counts before the shuffle;
    2. a histogram of ``width`` finds the bins that hold the wanted ranks;
    3. only those bins are ranked, each on its own.
    Memory per task is one bin of one group, never the group.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__b", F.floor(F.col("__v") / width))
    )
    hist = counted.groupBy(*keys, "__b").agg(F.sum("__n").alias("__bn"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    run = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(
        *keys, "__b", "__bn",
        F.coalesce(F.sum("__bn").over(run), F.lit(0)).alias("__lo"),
        F.sum("__bn").over(whole).alias("__total"),
    )
    names = list(quantiles)
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("__total") - 1)).alias("pos"))
        for i, q in enumerate(quantiles.values())
    ])
    picked = hist.select("*", F.explode(wanted).alias("__q")).select(
        *keys, "__b", "__bn", "__lo", "__total", F.col("__q.i").alias("__i"), F.col("__q.pos").alias("__pos"),
        F.floor("__q.pos").alias("__k0"), F.ceil("__q.pos").alias("__k1"),
    )
    holds = lambda k: (k >= F.col("__lo")) & (k < F.col("__lo") + F.col("__bn"))
    picked = picked.where(holds(F.col("__k0")) | holds(F.col("__k1")))
    picked = picked.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__k_block"),
                           "__lo", "__i", "__pos", "__k0", "__k1")
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__b") == F.col("__k_block")]
    rows = counted.join(picked, on).select(*keys, "__b", "__v", "__n", "__lo", "__i", "__pos", "__k0", "__k1")
    wr = Window.partitionBy(*keys, "__b", "__i").orderBy("__v")
    rows = rows.withColumn("__end", F.col("__lo") + F.sum("__n").over(wr)).withColumn(
        "__start", F.col("__end") - F.col("__n")
    )
    has = lambda k: (F.col(k) >= F.col("__start")) & (F.col(k) < F.col("__end"))
    parts = []
    for i, name in enumerate(names):
        mine = F.col("__i") == i
        parts += [
            F.max(F.when(mine & has("__k0"), F.col("__v"))).alias(f"__a{i}"),
            F.max(F.when(mine & has("__k1"), F.col("__v"))).alias(f"__z{i}"),
            F.max(F.when(mine, F.col("__pos") - F.col("__k0"))).alias(f"__f{i}"),
        ]
    out = rows.groupBy(*keys).agg(*parts)
    lerp = lambda i: F.col(f"__a{i}") + (F.col(f"__z{i}") - F.col(f"__a{i}")) * F.col(f"__f{i}")
    return out.select(*keys, *[lerp(i).alias(n) for i, n in enumerate(names)])
