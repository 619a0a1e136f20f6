"""Streams with clocks and two sinks: restarts, expiry and empty state."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from swathe.session import scratch_folder
from swathe.streaming import admission
from swathe.streaming import stateful as sf

SECOND = 1_000_000_000


def feed(spark, rows, schema, folder):
    """Appends rows to a file stream, one file, one trigger."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def folder(spark):
    return os.path.join(scratch_folder(spark), f"test-{uuid.uuid4().hex}")


def test_a_restart_between_the_sinks_loses_and_repeats_nothing(spark, monkeypatch):
    schema, source, base = "id long, age double", folder(spark), folder(spark)
    stream = feed(spark, [(i, 50.0 * i) for i in range(10)] + [(99, None)], schema, source)
    real = admission._write

    def broken(rows, sink, batch_id):
        if sink.endswith("journal"):
            raise RuntimeError("lost between the sinks")
        real(rows, sink, batch_id)

    monkeypatch.setattr(admission, "_write", broken)
    with pytest.raises(Exception, match="lost between the sinks"):
        admission.admitted_and_journal(stream, F.col("age"), 200, base)
    monkeypatch.setattr(admission, "_write", real)
    ok, late = admission.admitted_and_journal(stream, F.col("age"), 200, base)
    assert sorted(r["id"] for r in ok.collect()) == [0, 1, 2, 3, 4]
    assert sorted(r["id"] for r in late.collect()) == [5, 6, 7, 8, 9, 99]
    stream = feed(spark, [(20, 1.0), (21, 900.0)], schema, source)  # later arrivals, taken up from the checkpoint
    ok, late = admission.admitted_and_journal(stream, F.col("age"), 200, base)
    assert sorted(r["id"] for r in ok.collect()) == [0, 1, 2, 3, 4, 20]
    assert {r["event"] for r in late.collect()} == {"ADMISSION_EXPIRED"} and late.count() == 7


def run(spark, stream, base):
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", base + "/state").trigger(availableNow=True).start(base + "/rows")
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.schema(stream.schema).parquet(base + "/rows"), held[-1]


EVENTS = "run int, generation int, frame int, time_ns long, is_base boolean, is_correction boolean"


def remembered(rows, base_s, fix_s):
    out, held = [], {}
    for r, g, f, t, b, x in rows:
        base, fix = held.get((r, g), (None, None))
        base, fix = ((f, t) if b else base), ((f, t) if x else fix)
        held[r, g] = base, fix
        ok = base is not None and fix is not None and t - base[1] <= base_s * SECOND and t - fix[1] <= fix_s * SECOND
        out.append((r, g, f, base[0] if ok else None, ok))
    return sorted(out, key=str)


def test_base_and_correction_expire_on_their_own_clocks(spark):
    source, base = folder(spark), folder(spark)
    seen = []
    step = [
        [(0, 0, 1, 1 * SECOND, True, False), (0, 0, 2, 2 * SECOND, False, True), (0, 0, 3, 3 * SECOND, False, False)],  # the third: correction just young enough
        [(0, 0, 4, 4 * SECOND, False, True), (0, 0, 5, 6 * SECOND, False, True), (0, 0, 6, 7 * SECOND, False, True)],  # corrections don't make the base younger
        [(0, 1, 7, 8 * SECOND, False, True), (0, 1, 8, 9 * SECOND, True, True), (0, 1, 9, 12 * SECOND, False, False)],  # a new generation starts with nothing
    ]
    for rows in step:
        seen += rows
        stream = sf.stream_path_memory(feed(spark, rows, EVENTS, source), 5000, 1000)
        got, held = run(spark, stream, base)
        assert sorted(map(tuple, got.collect()), key=str) == remembered(seen, 5, 1)
    want = {r[2]: r[4] for r in remembered(seen, 5, 1)}
    assert want[3] and not want[6] and not want[7] and want[8] and not want[9]
    far = [(5, 0, 100, 1000 * SECOND, False, False)]
    got, held = run(spark, sf.stream_path_memory(feed(spark, far, EVENTS, source), 5000, 1000), base)
    got, held = run(spark, sf.stream_path_memory(feed(spark, [(5, 0, 101, 1001 * SECOND, False, False)], EVENTS, source), 5000, 1000), base)
    assert held == 0


FRAMES = "run int, chain long, frame int, pose_status string, tx double, ty double, tz double, solved boolean, time_ns long"


def test_failed_attempts_go_on_with_what_there_is_and_old_chains_leave_the_state(spark):
    rows = [(0, 0, i, "unavailable" if i == 4 else "ok", 0.3 * i, 0.0, 0.0, i not in (0, 5, 6), i * SECOND) for i in range(12)]
    want = [(0, "NO_GEOMETRY", None), (1, "RECOMPUTE", 1), (2, "REUSE", 1), (3, "RECOMPUTE", 3), (4, "UNAVAILABLE", 3), (5, "STALE", 3), (6, "STALE", 3), (7, "RECOMPUTE", 7), (8, "REUSE", 7), (9, "RECOMPUTE", 9), (10, "REUSE", 9), (11, "RECOMPUTE", 11)]
    batch = sf.motion_trigger(spark.createDataFrame(rows, FRAMES), 0.55)
    assert sorted((r["frame"], r["action"], r["source"]) for r in batch.collect()) == want
    source, base = folder(spark), folder(spark)
    for i in (0, 5, 6):
        part = rows[i : {0: 5, 5: 6, 6: 12}[i]]
        got, held = run(spark, sf.stream_motion_trigger(feed(spark, part, FRAMES, source), 0.55, 60_000), base)
    assert sorted((r["frame"], r["action"], r["source"]) for r in got.collect()) == want and held == 1
    for i in (500, 501):
        late = [(1, 0, i, "unavailable", 0.0, 0.0, 0.0, True, i * SECOND)]
        got, held = run(spark, sf.stream_motion_trigger(feed(spark, late, FRAMES, source), 0.55, 60_000), base)
    assert held == 0 and got.count() == len(rows) + 2
