"""Scenes with known answers: envelope, objects, tracks, guard, policy, poses, streams and sources."""

import json
import sqlite3

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swathe.functions import numeric
from swathe.operators import envelope as env
from swathe.operators import paths as pth
from swathe.operators import projections as prj
from swathe.operators import windows as win
from swathe.operators.ordered import islands
from swathe.plans import detect, fit
from swathe.plans import objects as ob
from swathe.sources import recordings as rec
from swathe.sources import sinks
from swathe.streaming import stateful as sf

c = F.col

GOLD_POINTS = """SELECT 0 AS run, CAST(l_orderkey % 300 AS INT) AS frame, CAST(row_number() OVER (PARTITION BY l_orderkey % 300 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS point_idx,
 CAST((l_partkey*7 + l_orderkey*3) % 601 AS DOUBLE)/100 - 3 AS x, -(CAST(l_quantity AS DOUBLE)*2 + CAST(l_partkey % 13 AS DOUBLE)/8) AS y, CAST((l_suppkey*37 + l_partkey*11) % 401 AS DOUBLE)/100 - 1 AS z FROM {lineitem}"""


def straight(spark, n=161, run=0):
    rows = [(run, k, k * 0.5, -0.792 + k * k * 1e-4, -0.5 * k, 0.001 * k, 0.792 + k * k * 1e-4, -0.5 * k, 0.001 * k) for k in range(n)]
    return spark.createDataFrame(rows, "run int, k int, s double, lx double, ly double, lz double, rx double, ry double, rz double")


def test_envelope_goldens(spark, mid):
    p = spark.sql(GOLD_POINTS, lineitem=mid.lineitem)
    h = env.envelope_hits(p, env.path_segments(straight(spark)))
    r = h.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("frame").alias("f"), F.sum("range_m").alias("s"), F.count_if("extra").alias("e")).first()
    assert (r["n"], r["f"], round(r["s"], 3), r["e"]) == (10925, 300, 435334.192, 5378)


def test_vertex_order_and_invalid_segments(spark):
    p = straight(spark, 4).withColumn("ly", F.when(c("k") == 3, -100.0).otherwise(c("ly"))).withColumn("ry", c("ly"))
    assert [r["invalid"] for r in env.path_segments(p).orderBy("k").collect()] == [False, False, True]


def obs(spark, rows):
    return spark.createDataFrame([(i, f, g, t, float(x), 0.0, 0.0, 2, 3) for i, (f, g, t, x) in enumerate(rows)],
                                 "obs_id int, source_frame int, generation int, track_id int, wx double, wy double, wz double, voxel_count int, point_count int")


def test_groups_do_not_chain_or_cross_generations(spark):
    g = ob.group_objects(obs(spark, [(0, 0, 1, 0), (1, 0, 1, 9), (1, 0, 2, 18), (2, 0, 2, 18), (2, 1, 3, 0)]))[1].orderBy("group_id").collect()
    assert [(r["first_frame"], r["last_frame"], r["status"]) for r in g] == [(0, 1, "CONFIRMED"), (1, 2, "CONFIRMED"), (2, 2, "SINGLE_FRAME")]


def test_two_pieces_of_one_frame_do_not_confirm(spark):
    g = ob.group_objects(obs(spark, [(10, 0, 3, 0), (10, 0, 4, 1)]))[1].collect()
    assert len(g) == 1 and g[0]["members"] == [3, 4] and g[0]["status"] == "SINGLE_FRAME"


def test_same_frame_is_no_second_confirmation():
    v = np.array([[0.0, 0, 0], [0.1, 0, 0]])
    book = sf.TrackBook()
    seen = [book.observe(f, t, {"a": v})[0] for f, t in ((10, 1.0), (10, 1.0), (11, 1.1))]
    assert [s[2] for s in seen] == [1, 1, 1] and [s[3] for s in seen] == [False, False, True]


def voxels(spark):
    rows = [(0, 0, f, f / 10, n, x + 0.02 * i, 0.02 * f, 0.0) for f in range(6) for n, x in (("a", 0.0), ("b", 5.0)) for i in range(4) if not (n == "b" and f == 3)]
    return spark.createDataFrame(rows, "run int, generation int, frame int, t_s double, component string, x double, y double, z double")


def test_stream_track_equals_batch(spark):
    v = voxels(spark)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    batch, stream = key(sf.track_batch(v)), key(sf.drain(sf.stream_track(sf.as_stream(v, "frame", chunks=3, files=1))))
    assert batch == stream and {r[4] for r in batch} == {1, 2}


def test_motion_trigger_stream_equals_batch(spark, small):
    f = islands(small.frames, ["run"], "frame", c("frame") % 25 == 10, "chain")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    cols = ["run", "chain", "frame", "pose_status", "tx", "ty", "tz"]
    assert key(sf.motion_trigger(f, 1.2)) == key(sf.drain(sf.stream_motion_trigger(sf.as_stream(f.select(*cols), "frame", chunks=3, files=1), 1.2)))


def test_sessions_are_causal(spark, small):
    m = small.messages
    cutoff = 500
    full = win.sessionize(m, ["source"], "message_id", "ts_ns", 3_600_000_000_000).where(c("message_id") < cutoff).select("message_id", "generation")
    part = win.sessionize(m.where(c("message_id") < cutoff), ["source"], "message_id", "ts_ns", 3_600_000_000_000).select("message_id", "generation")
    assert full.exceptAll(part).isEmpty() and part.exceptAll(full).isEmpty()


def rail(spark, sides, upto):
    rows = [(0, x + 0.01 * (i % 3), -8 - 0.1 * i, 0.004 * (i % 4)) for x in sides for i in range(int((upto - 8) * 10))]
    return spark.createDataFrame(rows, "run int, x double, y double, z double")


@pytest.mark.parametrize("sides,upto,good", [((-0.792, 0.792), 28, 10), ((-0.792,), 28, 0), ((-0.792, 0.792), 14.05, 3)])
def test_guard_keeps_only_what_both_heads_support(spark, sides, upto, good):
    rows = [(0, k, 0.1 * k, -0.792, -0.1 * k, 0.0, 0.792, -0.1 * k, 0.0) for k in range(281)]
    path = spark.createDataFrame(rows, "run int, k int, s double, lx double, ly double, lz double, rx double, ry double, rz double")
    out = pth.supported_prefix(rail(spark, sides, upto), path, ["run"], observed_k=80)
    assert out.where("accepted").count() == good and out.count() == 10


def test_path_policy_cases(spark):
    cols = "has_primary boolean, has_fallback boolean, primary_ok boolean, fallback_ok boolean, primary_end double, fallback_end double, prefix_lateral double, prefix_vertical double, contact_status string, reanchored boolean, near_end double"
    rows = [(True, True, True, True, 40.0, 100.0, 0.01, 0.01, "LEFT", False, 8.0), (True, True, True, True, 40.0, 100.0, 0.5, 0.01, "LEFT", False, 8.0), (True, True, True, True, 105.0, 100.0, 0.0, 0.0, "LEFT", False, 8.0),
            (False, True, False, True, 0.0, 100.0, 0.0, 0.0, "NOT_FOUND", True, 8.0), (False, False, False, False, 0.0, 0.0, 0.0, 0.0, "LEFT", False, 8.0), (True, False, False, False, 40.0, 0.0, 0.0, 0.0, "LEFT", False, 8.0), (True, False, True, False, 8.0, 0.0, 0.0, 0.0, "LEFT", False, 8.0)]
    got = [r["scope"] for r in detect.path_policy(spark.createDataFrame(rows, cols)).collect()]
    assert got == ["HELD_OBSERVED_TAIL_AFTER_SHORT_MARCH", "NEAR_ONLY_CONFLICTING_PATHS", "HELD_COMPLETE_PIPELINE_PATH", "RAIL_FALLBACK_AFTER_FULL_STEP2_FAILURE",
                   "NEAR_ONLY_WAITING_FULL_CHAIN", "NEAR_ONLY_RECOMPUTE_CONTRADICTORY_PATH", "NEAR_ONLY_SHORT_PRIMARY"]


def test_reanchor_refuses_a_short_prior(spark):
    p = straight(spark, 161)
    out = pth.reanchor_tail(p.where("k <= 14"), p.where("k <= 16"), ["run"]).collect()
    assert [r["status"] for r in out] == ["INSUFFICIENT_PRIOR_AHEAD"]
    p = p.withColumns({"lx": F.lit(-0.792), "rx": F.lit(0.792)})  # on a bend the two directions have different baselines
    full = pth.reanchor_tail(p, p.where("k <= 16"), ["run"])
    moved = full.join(p.select("k", c("lx").alias("ox"), c("rz").alias("oz")), "k").agg(F.max(F.abs(c("lx") - c("ox"))).alias("e"), F.max(F.abs(c("rz") - c("oz"))).alias("f")).first()
    assert full.count() == 161 and moved["e"] < 1e-9 and moved["f"] < 1e-9


def test_hull_area_is_the_same_for_any_chunk(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "u": [*r.uniform(0, 1, 500), 0, 0, 1, 1], "v": [*r.uniform(0, 2, 500), 0, 2, 0, 2]}))
    assert [round(ob.hull_area(df, ["g"], "u", "v", chunk=n).first()["hull_m2"], 9) for n in (16, 10_000)] == [2.0, 2.0]
    line = spark.createDataFrame([(0, float(i), float(i)) for i in range(5)], "g int, u double, v double")
    assert ob.hull_area(line, ["g"], "u", "v").first()["hull_m2"] == 0


def test_spline_and_normal_equations(spark):
    df = spark.range(40).select(F.lit(0).alias("g"), (c("id") * 0.5).alias("x"))
    df = df.withColumn("y", 2 + 3 * c("x"))
    s = fit.solve(fit.normal_equations(df, ["g"], [F.lit(1.0), c("x")], c("y"), F.lit(1.0)), 2).first()
    assert abs(s["x_0"] - 2) < 1e-9 and abs(s["x_1"] - 3) < 1e-9
    curve = df.select("g", c("x").alias("s"), c("y"), F.lit(0.01).alias("sigma"))
    e = fit.smooth_curves(curve, ["g"], "s", ["y"], "sigma", rounds=1).agg(F.max(F.abs(c("y") - c("y_fit"))).alias("e")).first()["e"]
    assert e < 1e-3


# --- sources -------------------------------------------------------------------------------------


def test_recording_source_and_clouds(spark, tmp_path):
    xyz = np.arange(12, dtype=np.float32).reshape(3, 4)
    db = sqlite3.connect(tmp_path / "a.db3")
    db.execute("CREATE TABLE messages(id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    blobs = [rec.build_cloud(xyz, 5_000_000_007, "lidar", i % 2 == 0) for i in range(5)]
    db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(i + 1, i % 2, 100 - i, b) for i, b in enumerate(blobs)] + [(9, 0, 200, blobs[0][:60])])
    db.commit()
    db.close()
    m = rec.read_recording(spark, str(tmp_path / "a.db3"), partitions=3)
    assert m.count() == 6 and [r["id"] for r in rec.read_messages(m, 0, 2).collect()] == [5, 3]
    p = rec.decode_points(m)
    assert p.where(c("error").isNotNull()).count() == 1 and p.where(c("error").isNull()).count() == 15
    row = p.where("message_id = 2 AND point_row = 1").first()
    assert (row["header_time_ns"], row["frame_id"], row["x"], row["intensity"]) == (5_000_000_007, "lidar", 4.0, 7.0)


def test_point_files_and_journal(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(rec.build_las(np.array([[1.5, -2.25, 3.0], [0.001, 0, 0]])))
    p = rec.read_point_files(spark.read.format("binaryFile").load(str(tmp_path / "a.las")))
    assert [(r["x"], r["y"], r["z"], r["ring"]) for r in p.orderBy("point_row").collect()][0] == (1.5, -2.25, 3.0, -1)
    (tmp_path / "j.jsonl").write_text(json.dumps({"event": "A", "n": 1}) + "\n" + '{"event": "B", "n"')
    assert rec.read_journal(spark, str(tmp_path / "j.jsonl"), "event string, n long").collect()[0]["event"] == "A"
    assert rec.read_journal(spark, str(tmp_path / "j.jsonl"), "event string, n long").count() == 1
    assert rec.read_journal(spark, str(tmp_path / "none.jsonl"), "event string").count() == 0


def test_csv_starts_with_a_byte_order_mark(spark, tmp_path):
    g = ob.group_objects(obs(spark, [(0, 0, 1, 0), (1, 0, 2, 1)]))[1]
    back = sinks.write_object_csv(g.coalesce(1), ["group_id", "members"], str(tmp_path / "csv"))
    text = next(tmp_path.glob("csv/part-*.csv")).read_bytes()
    assert text.startswith("﻿".encode()) and back.first()["members"] == "1+2"


def test_causal_records_hide_the_future(spark, small):
    f = small.frames
    out = rec.causal_records(f, 10, ["header_time_ns", "tx"], ["tx"]).orderBy("frame").collect()
    assert out[-1]["frame"] == 11 and out[-1]["header_time_ns"] is None and out[-1]["tx"] is not None
    with pytest.raises(ValueError):
        prj.require_columns(f, ["frame", "label"])
    with pytest.raises(ValueError):
        prj.require_columns(f, ["frame"], ["run"])


def test_unknown_is_not_clear(spark):
    df = spark.createDataFrame([(False, False, 0), (True, True, 5), (True, False, 1), (True, False, 0)], "ref boolean, late boolean, n int")
    got = [r["s"] for r in df.select(prj.classify_status(c("ref"), c("late"), c("n")).alias("s")).collect()]
    assert got == ["UNKNOWN_NEAR_REFERENCE", "EXPIRED_RESULT", "INTRUSION", "NO_CONFIRMED_COMPONENT_THIS_BATCH"]


def test_vector_cross_product_on_random_rows(spark):
    from swathe.functions.vector import cross, vec

    r = np.random.default_rng(0).normal(size=(500, 6))
    df = spark.createDataFrame(pd.DataFrame(r, columns=["ax", "ay", "az", "bx", "by", "bz"]))
    x = cross(vec("a"), vec("b"))
    got = np.array([tuple(row) for row in df.select(*[e.alias(f"c{i}") for i, e in enumerate(x)]).collect()])
    assert np.abs(got - np.cross(r[:, :3], r[:, 3:])).max() < 1e-12
    assert df.select(numeric.wrap_half_turn(c("ax")).alias("w")).where((c("w") < -np.pi / 2) | (c("w") >= np.pi / 2)).isEmpty()


def test_stations_stay_on_their_leg_of_a_bend(spark):
    """A curve that comes back 1 m beside itself: the expected station decides the leg, unless no segment lies near it."""
    from swathe.operators.paths import assign_stations

    out = [(0, k, 1.0 * k, 0.0, 1.0 * k, 0.0) for k in range(21)]
    back = [(0, 21 + k, 21.0 + k, 1.0, 20.0 - k, 0.0) for k in range(21)]
    curve = spark.createDataFrame(out + back, "run int, k int, s double, vx double, vy double, vz double")
    rows = [(0, "a", 1, 5.0, 0.6, 5.0, 0.0), (0, "b", 1, 36.0, 0.4, 5.0, 0.0), (0, "c", 1, 90.0, 0.1, 5.0, 0.0)]
    points = spark.createDataFrame(rows, "run int, source string, id int, init double, x double, y double, z double")
    got = {r["source"]: r["station"] for r in assign_stations(points, curve, ["run"], "source", "id", "init", 2.0).collect()}
    assert got == {"a": 5.0, "b": 36.0, "c": 5.0}
