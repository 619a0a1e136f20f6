"""Keyed streams: sessions, slots, histories and motion triggers.

Each stream has a batch twin that gives the same rows, so a stream can be checked against it.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import scratch_folder
from .tracks import TrackBook, stream_track, track_batch  # noqa: F401

c = F.col


def as_stream(df: DataFrame, order: str, chunks: int = 4, files: int = 4) -> DataFrame:
    """Replay a table as a file stream in the order of one numeric column.

    The table is appended in ``chunks`` ascending ranges of ``files`` files
    each, and one trigger takes one chunk, so arrival follows the order.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_folder(spark), f"stream-{uuid.uuid4().hex}")
    edges = df.approxQuantile(order, [i / chunks for i in range(1, chunks)], 0.01)
    bounds = [None, *sorted(set(edges)), None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = df
        if lo is not None:
            part = part.where(c(order) > lo)
        if hi is not None:
            part = part.where(c(order) <= hi)
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and return what it wrote."""
    spark = stream.sparkSession
    base = os.path.join(scratch_folder(spark), f"drain-{uuid.uuid4().hex}")
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", base + "/state")
         .trigger(availableNow=True).start(base + "/rows"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/rows")


def _keyed(pdfs) -> pd.DataFrame:
    parts = list(pdfs)
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


SESSION_OUT = "source long, message_id long, generation long, rejected string"


def _sessions(source, ids, stamps, last, max_gap_ns: int):
    """Generation (-1: refused) and reason per message of several sources, and the state after them.

    Messages lie by (source, id). ``last``: arrays of source (ascending), last accepted id, its stamp, generation.
    """
    known, last_id, last_ts, gen = last
    here, at = np.unique(source, return_inverse=True)
    every = np.union1d(known, here)
    held = [np.full(len(every), v, np.int64) for v in (-1, -1, 0)]
    for column, values in zip(held, (last_id, last_ts, gen)):
        column[np.searchsorted(every, known)] = values
    at = np.searchsorted(every, here)[at]
    fits = np.flatnonzero((ids > held[0][at]) & (stamps > 0))
    again = np.zeros(len(fits), bool)
    again[1:] = (at[fits[1:]] == at[fits[:-1]]) & (ids[fits[1:]] == ids[fits[:-1]])
    taken = fits[~again]
    # The last id accepted before each message: that of its source in this trigger, or the held one.
    before = np.searchsorted(taken, np.arange(len(ids))) - 1
    previous = held[0][at]
    if len(taken):
        row = taken[before]
        previous = np.where((before >= 0) & (at[row] == at), ids[row], previous)
    reason = np.where(ids <= previous, "SEQUENCE_NOT_INCREASING", np.where(stamps <= 0, "MISSING_STAMP", None))
    out = np.full(len(ids), -1, np.int64)
    if len(taken):
        who, ts = at[taken], stamps[taken]
        first = np.r_[True, who[1:] != who[:-1]]
        since = np.where(first, held[1][who], np.r_[0, ts[:-1]])
        breaks = (since >= 0) & ~((ts - since > 0) & (ts - since < max_gap_ns))
        total = np.cumsum(breaks)
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        out[taken] = held[2][who] + total - (total - breaks)[start]
        end = np.r_[first[1:], True]
        for column, values in zip(held, (ids[taken], ts, out[taken])):
            column[who[end]] = values[end]
    return out, reason, (every, *held)


def stream_sessions(stream: DataFrame, max_gap_ns: int = 150_000_000, buckets: int = 1024) -> DataFrame:
    """Sessions per source as messages arrive; a message out of sequence or without a stamp is refused.

    State per source: last sequence, last stamp, generation. ``stream``: source, message_id, ts_ns.
    Sources share ``buckets`` groups, since a group of its own costs each source some milliseconds a trigger.
    """

    def step(key, pdfs, state):
        rows = _keyed(pdfs)
        rows["source"] = rows["source"].fillna(0).astype("int64")  # nulls have a bucket of their own
        rows = rows.sort_values(["source", "message_id"], kind="stable")
        source, ids, stamps = (rows[n].astype("int64").to_numpy() for n in ("source", "message_id", "ts_ns"))
        last = [np.array(v, np.int64) for v in state.get] if state.exists else [np.zeros(0, np.int64)] * 4
        generation, reason, last = _sessions(source, ids, stamps, last, max_gap_ns)
        state.update(tuple(v.tolist() for v in last))
        yield pd.DataFrame({
            "source": pd.arrays.IntegerArray(source, np.full(len(ids), key[0] < 0)), "message_id": ids,
            "generation": pd.arrays.IntegerArray(generation, generation < 0), "rejected": reason})

    bucket = F.when(c("source").isNull(), -1).otherwise(F.pmod(F.xxhash64("source"), F.lit(buckets)))
    return stream.select("source", "message_id", "ts_ns", bucket.alias("bucket")).groupBy("bucket").applyInPandasWithState(
        step, SESSION_OUT, "sources array<long>, last_id array<long>, last_ts array<long>, gen array<long>", "append", GroupStateTimeout.NoTimeout)


def stream_slots(stream: DataFrame, hz: int, epoch_ns: int, late: str = "10 minutes") -> DataFrame:
    """One row per (source, slot): the slot number is integer arithmetic, repeats are dropped by the watermark."""
    from ..functions.numeric import slot_number

    s = stream.withColumn("slot", slot_number(c("ts_ns"), F.lit(epoch_ns), hz))
    s = s.withColumn("ts", F.timestamp_micros(F.floor(c("ts_ns") / 1000))).withWatermark("ts", late)
    return s.dropDuplicatesWithinWatermark(["source", "slot"]).select("source", "slot")


def stream_history(stream: DataFrame, depth: int = 12) -> DataFrame:
    """Each frame with the size and oldest member of its bounded history; older frames leave the state."""

    def step(key, pdfs, state):
        ring = list(state.get[0]) if state.exists else []
        rows = []
        for frame in sorted(_keyed(pdfs)["frame"].tolist()):
            ring = [f for f in ring if f > frame - depth] + [frame]
            rows.append((key[0], frame, len(ring), min(ring)))
        state.update((ring,))
        yield pd.DataFrame(rows, columns=["run", "frame", "held", "oldest"])

    return stream.select("run", "frame").groupBy("run").applyInPandasWithState(
        step, "run int, frame int, held int, oldest int", "ring array<int>", "append", GroupStateTimeout.NoTimeout)


def _timed(stream: DataFrame, ns: str, late: str) -> DataFrame:
    """The stream with an event time made from nanoseconds; rows that come more than ``late`` after younger ones are dropped.

    One millisecond later than the stamp, since the first watermark, zero, would refuse a row of time zero.
    """
    return stream.withColumn("__ts", F.timestamp_micros(F.floor(c(ns) / 1000) + 1000)).withWatermark("__ts", late)


def _wake(state, at_ns: int) -> None:
    """Ask to be called when the watermark passes that time."""
    state.setTimeoutTimestamp(max(at_ns // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))


MEMORY_OUT = "run int, generation int, frame int, base int, usable boolean"


def stream_path_memory(stream: DataFrame, base_ms: int = 5000, correction_ms: int = 1000, late: str = "10 seconds") -> DataFrame:
    """Per frame the remembered far path, if its source and its last correction are both young enough.

    ``stream``: run, generation, frame, time_ns, is_base, is_correction (what the frame brings).
    A base and a correction expire each on a clock of their own, that of
    event time; a correction never makes its base younger, and a new generation starts with nothing.
    A timer drops what has expired, so the state of a generation that has ended goes.
    """
    ages = (base_ms * 1_000_000, correction_ms * 1_000_000)

    def kept(parts, now):
        return [p if p[0] >= 0 and now - p[1] <= age else (-1, -1) for p, age in zip(parts, ages)]

    def store(state, parts):
        due = [p[1] + age for p, age in zip(parts, ages) if p[0] >= 0]
        if due:
            state.update(tuple(int(x) for p in parts for x in p))
            _wake(state, min(due))
        elif state.exists:
            state.remove()

    def step(key, pdfs, state):
        held = state.get if state.exists else (-1, -1, -1, -1)
        parts = [tuple(held[:2]), tuple(held[2:])]
        rows = []
        if state.hasTimedOut:
            store(state, kept(parts, state.getCurrentWatermarkMs() * 1_000_000))
        else:
            now = 0
            for frame, now, *brings in _keyed(pdfs).sort_values("frame")[["frame", "time_ns", "is_base", "is_correction"]].itertuples(index=False):
                parts = kept([(frame, now) if new else old for new, old in zip(brings, parts)], now)
                usable = parts[0][0] >= 0 and parts[1][0] >= 0
                rows.append((*key, frame, parts[0][0] if usable else None, usable))
            store(state, parts)
        out = pd.DataFrame(rows, columns=["run", "generation", "frame", "base", "usable"])
        out["base"] = out["base"].astype("Int32")
        yield out

    timed = _timed(stream.select("run", "generation", "frame", "time_ns", "is_base", "is_correction"), "time_ns", late)
    return timed.groupBy("run", "generation").applyInPandasWithState(
        step, MEMORY_OUT, "base long, base_ns long, fix long, fix_ns long", "append", GroupStateTimeout.EventTimeTimeout)


TRIGGER_OUT = "run int, chain long, frame int, action string, source int"


def _decide(rows: pd.DataFrame, last, distance: float):
    """Recompute on the first accepted pose and after every ``distance`` metres since the last success.

    Where a recomputation fails, the last success goes on as stale and the next frame tries again.
    """
    out = []
    for r in rows.sort_values("frame").itertuples():
        source = last[0] if last else None
        if r.pose_status not in ("ok", "origin"):
            out.append((r.frame, "UNAVAILABLE", source))
        elif last is not None and np.sqrt((r.tx - last[1]) ** 2 + (r.ty - last[2]) ** 2 + (r.tz - last[3]) ** 2) < distance:
            out.append((r.frame, "REUSE", source))
        elif r.solved:
            last = (int(r.frame), float(r.tx), float(r.ty), float(r.tz))
            out.append((r.frame, "RECOMPUTE", last[0]))
        else:
            out.append((r.frame, "STALE" if last else "NO_GEOMETRY", source))
    return out, last


def _trigger_columns(frames: DataFrame, *more: str) -> DataFrame:
    solved = F.coalesce("solved", F.lit(False)) if "solved" in frames.columns else F.lit(True)
    return frames.select("run", "chain", "frame", "pose_status", "tx", "ty", "tz", solved.alias("solved"), *more)


def _triggers(key, rows) -> pd.DataFrame:
    out = pd.DataFrame([(*key, *r) for r in rows], columns=["run", "chain", "frame", "action", "source"])
    out["source"] = out["source"].astype("Int32")
    return out


def motion_trigger(frames: DataFrame, distance: float = 0.5) -> DataFrame:
    """Per frame of a chain: RECOMPUTE, REUSE of the last success, STALE (a failed attempt, the last success goes on), NO_GEOMETRY (none yet) or UNAVAILABLE.

    ``frames``: run, chain, frame, pose_status, tx, ty, tz, and ``solved`` where attempts can fail.
    Frames only, never points.
    """

    def run(key, pdf):
        return _triggers(key, _decide(pdf, None, distance)[0])

    return _trigger_columns(frames).groupBy("run", "chain").applyInPandas(run, TRIGGER_OUT)


def stream_motion_trigger(stream: DataFrame, distance: float = 0.5, keep_ms: int = 600_000, late: str = "10 seconds") -> DataFrame:
    """``motion_trigger`` frame by frame; ``time_ns`` is the event time, and a chain without frames for ``keep_ms`` leaves the state.

    Without a ``time_ns`` there is no clock, and chains stay.
    """
    timed = "time_ns" in stream.columns

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            yield _triggers(key, [])
            return
        rows = _keyed(pdfs)
        found, last = _decide(rows, tuple(state.get) if state.exists else None, distance)
        if last is not None:
            state.update(last)
            if timed:
                _wake(state, int(rows["time_ns"].max()) + keep_ms * 1_000_000)
        yield _triggers(key, found)

    cols = _timed(_trigger_columns(stream, "time_ns"), "time_ns", late) if timed else _trigger_columns(stream)
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return cols.groupBy("run", "chain").applyInPandasWithState(step, TRIGGER_OUT, "frame int, tx double, ty double, tz double", "append", timeout)
