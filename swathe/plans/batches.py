"""Disjoint batches of consecutive frames, merged into the frame of their target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rotation as rot
from ..functions.vector import named, vec
from ..operators.windows import slot_targets

c = F.col


def batch_frames(frames: DataFrame, keys: list[str], hz: int) -> DataFrame:
    """One row per (target, frame): the frames since the previous target, the target last."""
    t = slot_targets(frames, keys, hz).where("target").select(*keys, c("frame").alias("target"), F.coalesce("batch_start", "frame").alias("lo"))
    return t.select(*keys, "target", F.explode(F.sequence("lo", "target")).alias("frame")).join(frames.select(*keys, "frame"), [*keys, "frame"])


def merge_batch(points: DataFrame, frames: DataFrame, keys: list[str], hz: int) -> DataFrame:
    """Batch clouds in target coordinates, each row keeping its owner (frame, point_idx).

    Only poses move: both poses are joined to the frame list first, and the
    points meet that small table once.
    """
    ok = frames.where(c("pose_status").isin("ok", "origin")).select(*keys, "frame", *rot.POSE)
    tgt = ok.select(*keys, c("frame").alias("target"), *[c(n).alias("g" + n) for n in rot.POSE])
    b = batch_frames(frames, keys, hz).join(ok, [*keys, "frame"]).join(tgt, [*keys, "target"])
    j = points.join(b, [*keys, "frame"])
    j = j.select("*", *named(rot.to_world(vec("x", "y", "z"), rot.matrix("r"), vec("t")), "w"))
    s = rot.to_sensor(vec("w"), rot.matrix("gr"), vec("gt"))
    return j.withColumnRenamed("frame", "owner_frame").select("*", *named(s, "s"))
