"""What may be said right now, and what has become of every message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def current_assessment(published: DataFrame, members: DataFrame, groups: DataFrame, keys: list[str], stale_ms: float = 1000.0) -> DataFrame:
    """Per source: confirmed groups observed in the published frame. ``obstacle_detected`` is null,
    not false, when the result is stale or the object snapshot lags behind it.

    ``published``: keys, source_frame, age_ms, snapshot_frame.
    """
    seen = members.join(published.select(*keys, "source_frame"), [*keys, "source_frame"])
    live = seen.join(groups.where("status = 'CONFIRMED'").select("group_id"), "group_id", "left_semi")
    n = live.groupBy(*keys).agg(F.countDistinct("group_id").alias("objects"))
    out = published.join(n, keys, "left").withColumn("objects", F.coalesce("objects", F.lit(0)))
    ok = (c("age_ms") <= stale_ms) & (c("snapshot_frame") >= c("source_frame"))
    return out.withColumns({"assessment_available": ok, "obstacle_detected": F.when(ok, c("objects") > 0)})


def late_drop(df: DataFrame, age_ms: Column, limit: Column | float) -> tuple[DataFrame, DataFrame]:
    """(admitted rows, journal rows of the dropped ones). Nothing disappears without a record."""
    marked = df.withColumn("age_ms", age_ms).withColumn("limit_ms", F.lit(limit) if not isinstance(limit, Column) else limit)
    late = c("age_ms") > c("limit_ms")
    return marked.where(~late), marked.where(late).withColumn("event", F.lit("ADMISSION_EXPIRED"))


def emit_on_change(df: DataFrame, keys: list[str], order: str, state: list[str], ties: list[str] = ()) -> DataFrame:
    """Rows whose state differs from the row before."""
    from ..operators.ordered import blocked_scan

    d = blocked_scan(df, keys, order, {"__p": ("lag", F.struct(*state))}, ties=ties)
    return d.where(c("__p").isNull() | ~c("__p").eqNullSafe(F.struct(*state))).drop("__p")


def replacement_accounting(journal: DataFrame, keys: list[str]) -> DataFrame:
    """Received, sent, replaced and expired counts per key."""
    return journal.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"), *[F.count_if(c("event") == e.upper()).alias(e) for e in ("sent", "replaced", "expired")])


def run_status(journal: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Received and processed counts and the latest finished row per run; null while none is finished."""
    done = c("event") == "GEOMETRY_COMPLETE"
    return journal.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(done).alias("processed"),
        F.max_by("message_id", F.when(done, F.struct(*order))).alias("latest"), F.max(F.when(done, c("ts_ns"))).alias("latest_ns"))
