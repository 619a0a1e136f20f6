"""Safe numerics, robust weights, confidence formulas and time arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_finite(c: Column) -> Column:
    """False for null, NaN and both infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def wrap_half_turn(a: Column) -> Column:
    """Angle folded into [-pi/2, pi/2)."""
    return F.pmod(a + math.pi / 2, F.lit(math.pi)) - math.pi / 2


# Tuning constants of the four loss functions.
HUBER, CAUCHY, TUKEY, STUDENT = 1.5, 2.0, 4.685, 5.0


def robust_weight(r: Column, loss: str) -> Column:
    """Reweighting factor of a normalised residual."""
    r = F.greatest(r, F.lit(1e-12))
    if loss == "huber":
        return F.least(F.lit(1.0), HUBER / r)
    if loss == "cauchy":
        return 1 / (1 + (r / CAUCHY) * (r / CAUCHY))
    if loss == "tukey":
        inner = F.greatest(F.lit(0.0), 1 - (r / TUKEY) * (r / TUKEY))
        return inner * inner
    if loss == "student":
        return STUDENT / (STUDENT - 1 + r * r)
    raise ValueError(f"unknown loss {loss}")


def saturation(x: Column, scale: float) -> Column:
    """``1 - exp(-x/scale)``: evidence that levels off."""
    return 1 - F.exp(-x / scale)


def pair_confidence(support: Column, margin: Column, margin_scale: float = 0.25) -> Column:
    """Confidence of a rail pair from its weaker support and its lead over the runner-up."""
    return saturation(support, 20.0) * saturation(margin, margin_scale)


def contact_confidence(n: Column, geometry: Column, shape: Column, margin: Column) -> Column:
    """Confidence of a contact-rail placement."""
    lead = F.greatest(F.lit(0.0), margin)
    return saturation(n, 5.0) * (0.3 + 0.7 * geometry) * (0.4 + 0.6 * shape) * saturation(lead, 0.3)


def age_ms(now_ns: Column, then_ns: Column) -> Column:
    return (now_ns - then_ns) / F.lit(1e6)


def slot_number(stamp_ns: Column, first_ns: Column, hz: int) -> Column:
    """Whole slot since the first stamp, in integer arithmetic."""
    d = (stamp_ns - first_ns) * hz
    return F.floor((d - F.pmod(d, F.lit(1_000_000_000))) / 1_000_000_000).cast("long")


def null_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column, also inside arrays."""

    def fix(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(is_finite(c), c).alias(field.name)
        if isinstance(field.dataType, T.ArrayType) and isinstance(
            field.dataType.elementType, (T.DoubleType, T.FloatType)
        ):
            return F.transform(c, lambda e: F.when(is_finite(e), e)).alias(field.name)
        return c

    return df.select([fix(f) for f in df.schema.fields])
