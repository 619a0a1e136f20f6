"""Sources, sinks and streams."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import windows as win
from ..operators.ordered import islands
from ..operators.joins import asof_model
from ..plans import batches
from ..plans import status as st
from ..sources import recordings as rec
from ..sources import sinks
from ..streaming import admission
from ..streaming import stateful as sf
from .q_objects import components
from .q_windows import SLOTS
from .registry import query

c = F.col


@query("src_01_read_messages", "messages", "SELECT message_id, ts_ns, value FROM messages WHERE topic = 'click' ORDER BY ts_ns, message_id LIMIT 1000", rnd="value")
def _(t):
    return rec.read_messages(t.messages, "click", 1000, "topic", "message_id").select("message_id", "ts_ns", "value")


@query("src_02_topic_catalog", "messages", "SELECT topic, count(*) AS messages, CAST(max(ts_ns)-min(ts_ns) AS DOUBLE)/1e9 AS duration_s, arg_min(props, (ts_ns, message_id)) AS first_payload FROM messages GROUP BY topic", rnd="duration_s")
def _(t):
    return rec.topic_catalog(t.messages, "topic", "message_id", "props")


@query("src_03_extract_topic", "messages", "SELECT message_id, source, ts_ns, props FROM messages WHERE topic = 'view'")
def _(t):
    return rec.extract_topic(t.messages, "view", "topic").select("message_id", "source", "ts_ns", "props")


def _blobs(t, build):
    """Every (frame, slot block) of the cloud encoded as one message; a block is 512 slots, so a message is bounded.

    Messages are cut out of sorted rows: a call of Python each would cost more than their rows.
    """
    names = ["frame", "block", "point_idx", "slot", "ring", "x", "y", "z", "intensity"]
    p = t.points.withColumn("block", F.floor(c("slot") / 512).cast("int")).select(names)

    def run(parts):
        rest = None
        for pdf in parts:
            rows = {n: pdf[n].to_numpy() if rest is None else np.concatenate([rest[n], pdf[n].to_numpy()]) for n in names}
            new = (np.diff(rows["frame"]) != 0) | (np.diff(rows["block"]) != 0)
            starts = [0, *(np.flatnonzero(new) + 1).tolist()] if len(rows["frame"]) else []
            yield encoded([{n: rows[n][lo:hi] for n in names} for lo, hi in zip(starts[:-1], starts[1:])])
            rest = {n: rows[n][starts[-1]:] for n in names} if starts else rest  # its message may go on in the next part
        if rest is not None:
            yield encoded([rest])

    def encoded(messages):
        ids = [int(q["frame"][0]) * 16 + int(q["block"][0]) for q in messages]
        return pd.DataFrame({"message_id": np.array(ids, np.int64), "data": [build(q, int(q["frame"][0])) for q in messages]})

    p = p.repartition("frame", "block").sortWithinPartitions("frame", "block", "point_idx")
    return p.mapInPandas(run, "message_id long, data binary")


def _matrix(q, *names):
    return np.column_stack([q[n] for n in names])


@query("src_04_decode_points", "points", """WITH m AS (SELECT CAST(frame AS BIGINT)*16 + slot//512 AS message_id, frame, point_idx, x, y, z, intensity FROM points)
SELECT message_id, CAST(frame AS BIGINT)*100000000 AS header_time_ns, 'lidar' AS frame_id, CAST(row_number() OVER (PARTITION BY message_id ORDER BY point_idx) - 1 AS INTEGER) AS point_row, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z, CAST(CAST(intensity AS FLOAT) AS DOUBLE) AS intensity FROM m""", rnd="x y z intensity")
def _(t):
    """Clouds encoded, alternately little and big endian, and decoded again."""
    blobs = _blobs(t, lambda q, f: rec.build_cloud(_matrix(q, "x", "y", "z", "intensity"), f * 100_000_000, "lidar", f % 2 == 0))
    d = rec.decode_points(blobs, "message_id", "data").where(c("error").isNull()).drop("error")
    return d.select("message_id", "header_time_ns", "frame_id", "point_row", *[c(n).cast("double").alias(n) for n in ("x", "y", "z", "intensity")])


@query("src_05_read_point_files", "points", """WITH m AS (SELECT CAST(frame AS BIGINT)*16 + slot//512 AS message_id, point_idx, x, y, z FROM points)
SELECT CAST(message_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY message_id ORDER BY point_idx) - 1 AS point_row, x, y, z, -1 AS ring FROM m""", rnd="x y z", ints="ring")
def _(t):
    files = _blobs(t, lambda q, f: rec.build_las(_matrix(q, "x", "y", "z"), 0.001)).select(c("message_id").cast("string").alias("path"), c("data").alias("content"))
    return rec.read_point_files(files).select("path", "point_row", "x", "y", "z", "ring")


@query("src_05b_point_file_ranges", "points", """WITH m AS (SELECT CAST(frame AS BIGINT)*16 + slot//512 AS message_id, point_idx, slot, ring, x, y, z, intensity FROM points)
SELECT CAST(message_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY message_id ORDER BY point_idx) - 1 AS point_row, x, y, z, ring, slot AS point_index, intensity, CAST(message_id AS BIGINT) AS frame_index FROM m""", rnd="x y z intensity", ints="ring point_index")
def _(t):
    """Files with dimensions of their own, written to the shared folder and read back 100 records a task."""
    import os
    import uuid

    from pyarrow import fs

    from ..session import scratch_folder

    folder = os.path.join(scratch_folder(t.spark), f"las-{uuid.uuid4().hex}")
    at = folder if "://" in folder or folder.startswith("/") else folder.replace("file:/", "file:///", 1)

    def build(q, frame):
        extra = {"ring": q["ring"].astype("<i2"), "point_index": q["slot"].astype("<u4"), "intensity_raw": q["intensity"].astype("<f8"), "frame_index": (frame * 16 + q["slot"] // 512).astype("<i8")}
        return rec.build_las(_matrix(q, "x", "y", "z"), 0.001, extra)

    def write(batches):
        system, path = fs.FileSystem.from_uri(at)
        system.create_dir(path)
        for batch in batches:
            for name, data in zip(batch.column("message_id").to_pylist(), batch.column("data")):
                with system.open_output_stream(f"{path}/{name}.las") as out:
                    out.write(data.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["message_id"])

    _blobs(t, build).mapInArrow(write, "message_id long").write.format("noop").mode("overwrite").save()
    p = rec.read_point_ranges(t.spark, folder, 100)
    return p.select(F.regexp_extract("path", "([0-9]+)[.]las$", 1).alias("file"), "point_row", "x", "y", "z", "ring", "point_index", "intensity", "frame_index")


@query("src_06_read_journal", "messages", "SELECT topic, source, count(*) AS n, max(message_id) AS newest FROM messages GROUP BY topic, source")
def _(t):
    """Messages written as a JSON-lines journal and read back."""
    import os
    import uuid

    from ..session import scratch_folder

    path = os.path.join(scratch_folder(t.spark), f"journal-{uuid.uuid4().hex}")
    t.messages.select("topic", "source", "message_id", "ts_ns").write.json(path)
    j = rec.read_journal(t.spark, path, "topic string, source long, message_id long, ts_ns long")
    return j.groupBy("topic", "source").agg(F.count(F.lit(1)).alias("n"), F.max("message_id").alias("newest"))


@query("src_07_causal_records", "frames", "WITH m AS (SELECT CAST(floor(avg(frame)) AS BIGINT) AS t FROM frames) SELECT frame, header_time_ns, tx, ty, pose_status FROM frames, m WHERE frame <= t UNION ALL SELECT frame, NULL, tx, ty, pose_status FROM frames, m WHERE frame = t + 1", rnd="tx ty")
def _(t):
    """Records known at the middle frame, plus only the pose of the one after it."""
    f = t.frames
    mid = int(f.agg(F.floor(F.avg("frame"))).first()[0])
    return rec.causal_records(f, mid, ["header_time_ns", "tx", "ty", "pose_status"], ["tx", "ty", "pose_status"])


@query("src_08_stream_messages", "messages", """WITH m AS (SELECT source, message_id, CASE WHEN message_id % 50 = 0 THEN 0 ELSE ts_ns END AS ts FROM messages)
SELECT source, count(*) FILTER (ts > 0) AS accepted, count(*) FILTER (ts = 0) AS rejected FROM m GROUP BY source""")
def _(t):
    m = t.messages.withColumn("ts_ns", F.when(c("message_id") % 50 == 0, 0).otherwise(c("ts_ns")))
    out = sf.drain(sf.stream_sessions(sf.as_stream(m.select("source", "message_id", "ts_ns"), "message_id")))
    return out.groupBy("source").agg(F.count_if(c("rejected").isNull()).alias("accepted"), F.count_if(c("rejected") == "MISSING_STAMP").alias("rejected"))


@query("snk_03_write_stations", "stations", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS different FROM stations")
def _(t):
    back, diff = sinks.write_stations(t.stations)
    return back.agg(F.count(F.lit(1)).alias("rows")).crossJoin(diff.agg(F.count(F.lit(1)).alias("different")))


@query("snk_04_layered_geometry", "points path", """WITH l AS (SELECT run, CASE WHEN ring = 1 THEN 1 WHEN ring = 2 THEN 4 ELSE 0 END AS layer, x, y, z FROM points UNION ALL SELECT run, 20, cx, cy, cz FROM path UNION ALL SELECT run, 21, lx, ly, lz FROM path UNION ALL SELECT run, 22, rx, ry, rz FROM path UNION ALL SELECT run, 23, (lx+rx)/2, (ly+ry)/2, (lz+rz)/2 FROM path)
SELECT run, layer, count(*) AS n, sum(x) AS sx, sum(z) AS sz FROM l GROUP BY run, layer""", rnd="sx sz", ints="layer")
def _(t):
    p = t.points.withColumn("layer", F.when(c("ring") == 1, 1).when(c("ring") == 2, 4).otherwise(0))
    return sinks.layered_geometry(p, t.path).groupBy("run", "layer").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("z").alias("sz"))


@query("snk_05_write_batches", "points frames", f"""WITH {SLOTS}, b AS (SELECT run, frame AS target, coalesce(pt + 1, frame) AS lo FROM tg), bf AS (SELECT f.*, b.target FROM frames f JOIN b ON f.run = b.run AND f.frame BETWEEN b.lo AND b.target)
SELECT bf.run, bf.target, count(*) AS n, count(DISTINCT p.frame) AS sources FROM points p JOIN bf ON p.frame = bf.frame JOIN frames g ON g.frame = bf.target WHERE bf.pose_status = 'ok' AND g.pose_status = 'ok' GROUP BY ALL""")
def _(t):
    m = batches.merge_batch(t.points, t.frames, ["run"], 3).select("run", "target", "owner_frame", "point_idx", "sx", "sy", "sz")
    return sinks.write_batches(m).groupBy("run", "target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("owner_frame").alias("sources"))


@query("snk_06_emit_on_change", "messages", "WITH l AS (SELECT *, lag(topic) OVER (PARTITION BY source ORDER BY message_id) AS p FROM messages) SELECT source, message_id, topic FROM l WHERE p IS NULL OR p <> topic")
def _(t):
    return st.emit_on_change(t.messages, ["source"], "message_id", ["topic"]).select("source", "message_id", "topic")


LATE = "lt AS (SELECT *, (message_id*37 % 900)::DOUBLE AS age_ms, CASE topic WHEN 'click' THEN 100 WHEN 'view' THEN 400 ELSE 800 END AS limit_ms FROM messages)"


# Admission ages in ms of input, geometry and result.
def _admission():
    return F.expr("CASE topic WHEN 'click' THEN 100 WHEN 'view' THEN 400 ELSE 800 END")


def _late(t):
    return st.late_drop(t.messages, (c("message_id") * 37 % 900).cast("double"), _admission())


@query("snk_07_journal_sink", "messages", f"WITH {LATE} SELECT topic, 'ADMISSION_EXPIRED' AS event, count(*) AS n, max(age_ms) AS oldest_ms FROM lt WHERE age_ms > limit_ms GROUP BY topic", rnd="oldest_ms")
def _(t):
    j = sinks.journal_sink(_late(t)[1].select("topic", "event", "message_id", "age_ms"))
    return j.groupBy("topic", "event").agg(F.count(F.lit(1)).alias("n"), F.max("age_ms").alias("oldest_ms"))


@query("str_01_late_drop", "messages", f"WITH {LATE} SELECT source, count(*) FILTER (age_ms <= limit_ms) AS admitted, count(*) FILTER (age_ms > limit_ms) AS dropped FROM lt GROUP BY source")
def _(t):
    ok, late = _late(t)
    a = ok.select("source", F.lit(1).alias("a"), F.lit(0).alias("d")).unionByName(late.select("source", F.lit(0).alias("a"), F.lit(1).alias("d")))
    return a.groupBy("source").agg(F.sum("a").alias("admitted"), F.sum("d").alias("dropped"))


@query("str_01b_stream_late_drop", "messages", f"WITH {LATE} SELECT message_id, age_ms, age_ms <= limit_ms AS admitted, CASE WHEN age_ms > limit_ms THEN 'ADMISSION_EXPIRED' END AS event FROM lt", rnd="age_ms")
def _(t):
    """The same decision in a stream with two sinks: every message stands in one of them."""
    m = t.messages.select("message_id", "topic", (c("message_id") * 37 % 900).cast("double").alias("age"))
    ok, late = admission.admitted_and_journal(sf.as_stream(m, "message_id"), c("age"), _admission())
    return ok.select("message_id", "age_ms", F.lit(True).alias("admitted"), F.lit(None).cast("string").alias("event")).unionByName(late.select("message_id", "age_ms", F.lit(False).alias("admitted"), "event"))


@query("str_02_stream_sessions", "messages", """WITH l AS (SELECT *, lag(ts_ns) OVER w AS p FROM messages WINDOW w AS (PARTITION BY source ORDER BY message_id))
SELECT source, message_id, sum(CASE WHEN p IS NOT NULL AND NOT (ts_ns-p > 0 AND ts_ns-p < 43200000000000) THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY message_id) AS generation FROM l""", ints="generation")
def _(t):
    m = t.messages.select("source", "message_id", "ts_ns")
    out = sf.drain(sf.stream_sessions(sf.as_stream(m, "message_id"), 43_200_000_000_000))
    return out.select("source", "message_id", "generation")


@query("str_03_stream_slots", "messages", "SELECT DISTINCT source, CAST(((ts_ns - 1704067200000000000)*3) // 1000000000 AS BIGINT) AS slot FROM messages")
def _(t):
    m = t.messages.select("source", "ts_ns")
    return sf.drain(sf.stream_slots(sf.as_stream(m, "ts_ns"), 3, 1_704_067_200_000_000_000))


@query("str_04_stream_history", "frames", "SELECT run, frame, count(*) OVER w AS held, min(frame) OVER w AS oldest FROM frames WINDOW w AS (PARTITION BY run ORDER BY frame RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)", ints="held oldest")
def _(t):
    return sf.drain(sf.stream_history(sf.as_stream(t.frames.select("run", "frame"), "frame")))


def _voxels(t):
    m = components(t).join(t.frames.select("frame", "generation"), "frame")
    cells = m.groupBy("run", "generation", "frame", "component", F.floor("x").alias("i"), F.floor("y").alias("j"), F.floor("z").alias("k"))
    return cells.agg(*[F.avg(a).alias(a) for a in "xyz"]).withColumn("t_s", c("frame") / 10)


@query("str_05_track", "points")
def _(t):
    """Components of the envelope hits tracked through each session; 1.5 m suits the sparse cloud."""
    return sf.track_batch(_voxels(t), {"radius": 1.5, "voxel": 1.0})


@query("str_05b_stream_track", "points")
def _(t):
    v = _voxels(t).select("run", "generation", "frame", "t_s", "component", "x", "y", "z")
    return sf.drain(sf.stream_track(sf.as_stream(v, "frame"), {"radius": 1.5, "voxel": 1.0}))


MEMORY = """WITH m AS (SELECT run, generation, frame AS mf, header_time_ns AS mt FROM frames WHERE frame % 11 = 0), k AS (SELECT run, generation, frame AS kf, header_time_ns AS kt FROM frames WHERE frame % 6 = 0),
j AS (SELECT f.run, f.frame, max(mf) AS mf, arg_max(mt, mf) AS mt, any_value(header_time_ns) AS t FROM frames f LEFT JOIN m ON f.run = m.run AND f.generation = m.generation AND mf <= f.frame GROUP BY ALL),
j2 AS (SELECT f.run, f.frame, max(kf) AS kf, arg_max(kt, kf) AS kt FROM frames f LEFT JOIN k ON f.run = k.run AND f.generation = k.generation AND kf <= f.frame GROUP BY ALL)
SELECT j.run, j.frame, CASE WHEN t-mt <= 900000000 AND t-kt <= 300000000 THEN mf END AS base, coalesce(t-mt <= 900000000 AND t-kt <= 300000000, false) AS usable FROM j JOIN j2 ON j.run = j2.run AND j.frame = j2.frame"""


@query("str_06_path_memory", "frames", MEMORY)
def _(t):
    """A base path lives 0.9 s, its correction 0.3 s; a correction never refreshes the base."""
    f, k = t.frames, ["run", "generation"]
    base = asof_model(f, f.where(c("frame") % 11 == 0), k, 900.0).select(*k, "frame", c("model").alias("base"))
    fix = asof_model(f, f.where(c("frame") % 6 == 0), k, 300.0).select(*k, "frame", c("model").alias("fix"))
    ok = c("base").isNotNull() & c("fix").isNotNull()
    return base.join(fix, [*k, "frame"]).select("run", "frame", F.when(ok, c("base")).alias("base"), ok.alias("usable"))


@query("str_06b_stream_path_memory", "frames", MEMORY)
def _(t):
    """The same as a stream with a timer for each of the two ages."""
    f = t.frames.select("run", "generation", "frame", c("header_time_ns").alias("time_ns"), (c("frame") % 11 == 0).alias("is_base"), (c("frame") % 6 == 0).alias("is_correction"))
    out = sf.drain(sf.stream_path_memory(sf.as_stream(f, "frame"), 900, 300))
    return out.select("run", "frame", "base", "usable")


TRIGGERS = """WITH RECURSIVE f AS (SELECT run, frame, header_time_ns AS time_ns, pose_status IN ('ok', 'origin') AS ok, frame % 7 <> 3 AS solved, tx, ty, tz,
  sum(CASE WHEN frame % 25 = 10 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY frame) AS chain FROM frames),
n AS (SELECT *, row_number() OVER (PARTITION BY run, chain ORDER BY frame) AS i FROM f),
s AS (
  SELECT run, chain, i, frame, CASE WHEN NOT ok THEN 'UNAVAILABLE' WHEN solved THEN 'RECOMPUTE' ELSE 'NO_GEOMETRY' END AS action, CASE WHEN ok AND solved THEN frame END AS source,
    CASE WHEN ok AND solved THEN tx END AS lx, CASE WHEN ok AND solved THEN ty END AS ly, CASE WHEN ok AND solved THEN tz END AS lz FROM n WHERE i = 1
  UNION ALL
  SELECT n.run, n.chain, n.i, n.frame,
    CASE WHEN NOT n.ok THEN 'UNAVAILABLE' WHEN sqrt((tx-lx)*(tx-lx)+(ty-ly)*(ty-ly)+(tz-lz)*(tz-lz)) < 1.2 THEN 'REUSE' WHEN n.solved THEN 'RECOMPUTE' WHEN s.source IS NOT NULL THEN 'STALE' ELSE 'NO_GEOMETRY' END,
    CASE WHEN n.ok AND n.solved AND NOT coalesce(sqrt((tx-lx)*(tx-lx)+(ty-ly)*(ty-ly)+(tz-lz)*(tz-lz)) < 1.2, false) THEN n.frame ELSE s.source END,
    CASE WHEN n.ok AND n.solved AND NOT coalesce(sqrt((tx-lx)*(tx-lx)+(ty-ly)*(ty-ly)+(tz-lz)*(tz-lz)) < 1.2, false) THEN tx ELSE lx END,
    CASE WHEN n.ok AND n.solved AND NOT coalesce(sqrt((tx-lx)*(tx-lx)+(ty-ly)*(ty-ly)+(tz-lz)*(tz-lz)) < 1.2, false) THEN ty ELSE ly END,
    CASE WHEN n.ok AND n.solved AND NOT coalesce(sqrt((tx-lx)*(tx-lx)+(ty-ly)*(ty-ly)+(tz-lz)*(tz-lz)) < 1.2, false) THEN tz ELSE lz END
  FROM s JOIN n ON n.run = s.run AND n.chain = s.chain AND n.i = s.i + 1)
SELECT run, frame, action, source FROM s"""


def _chained(t):
    """Chains that begin anew at each tenth frame of a run; each seventh attempt fails."""
    return islands(t.frames, ["run"], "frame", c("frame") % 25 == 10, "chain").withColumns({"solved": c("frame") % 7 != 3, "time_ns": c("header_time_ns")})


@query("str_09_motion_trigger", "frames", TRIGGERS)
def _(t):
    return sf.motion_trigger(_chained(t), 1.2).select("run", "frame", "action", "source")


@query("str_09b_stream_motion_trigger", "frames", TRIGGERS)
def _(t):
    f = _chained(t).select("run", "chain", "frame", "pose_status", "tx", "ty", "tz", "solved", "time_ns")
    return sf.drain(sf.stream_motion_trigger(sf.as_stream(f, "frame"), 1.2)).select("run", "frame", "action", "source")


@query("str_10_replacement_accounting", "messages", "SELECT source, count(*) AS received, count(*) FILTER (topic = 'click') AS sent, count(*) FILTER (topic = 'view') AS replaced, count(*) FILTER (topic NOT IN ('click', 'view')) AS expired FROM messages GROUP BY source")
def _(t):
    event = F.when(c("topic") == "click", "SENT").when(c("topic") == "view", "REPLACED").otherwise("EXPIRED")
    return st.replacement_accounting(t.messages.withColumn("event", event), ["source"])


@query("str_11_run_status", "messages", "SELECT source, count(*) AS received, count(*) FILTER (topic = 'click') AS processed, arg_max(message_id, (ts_ns, message_id)) FILTER (topic = 'click') AS latest, max(ts_ns) FILTER (topic = 'click') AS latest_ns FROM messages GROUP BY source")
def _(t):
    m = t.messages.withColumn("event", F.when(c("topic") == "click", "GEOMETRY_COMPLETE").otherwise("INPUT"))
    return st.run_status(m, ["source"], ["ts_ns", "message_id"])
