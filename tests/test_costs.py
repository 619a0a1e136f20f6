"""What a row, a group or a trigger costs: formulas are taken once, groups are not one call of Python each."""

import os
import random
import re
import uuid
from collections import Counter

from pyspark.sql import functions as F

from swathe.catalog import all_queries
from swathe.operators import envelope as env
from swathe.session import cut, scratch_folder
from swathe.sources import sinks
from swathe.streaming import stateful as sf

from .conftest import SMALL

QUERIES = all_queries()[0]


def test_a_filter_on_coordinates_does_not_repeat_the_formula_of_an_id(spark):
    plan = QUERIES["prj_01_valid_points"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") <= 3  # was 17: in the filter for each use of each coordinate


def plain_sessions(messages, gap):
    last, out = {}, []
    for s, m, ts in messages:
        i, t, g = last.get(s, (-1, -1, 0))
        if m <= i:
            out.append((s, m, None, "SEQUENCE_NOT_INCREASING"))
        elif ts <= 0:
            out.append((s, m, None, "MISSING_STAMP"))
        else:
            g += t >= 0 and not 0 < ts - t < gap
            last[s] = m, ts, g
            out.append((s, m, g, None))
    return sorted(out, key=str)


def test_sessions_of_many_sources_share_a_bounded_number_of_groups(spark):
    rng, folder = random.Random(1), os.path.join(scratch_folder(spark), f"test-{uuid.uuid4().hex}")
    arrived = []
    for trigger in range(3):
        rows = []
        for s in [None, -5, *range(200), 1 << 60]:
            for _ in range(rng.randrange(6)):
                # ids go back, too; repeated ones have one stamp, so their order does not matter
                m = trigger * 8 + rng.randrange(-3, 12)
                rows.append((s, m, 0 if m % 7 == 0 else m * 40 + (m % 5 == 0) * 200))
        spark.createDataFrame(rows, "source long, message_id long, ts_ns long").coalesce(1).write.mode("append").parquet(folder)
        arrived += sorted(rows, key=lambda r: r[1])
    stream = spark.readStream.schema("source long, message_id long, ts_ns long").option("maxFilesPerTrigger", 1).parquet(folder)
    base = os.path.join(scratch_folder(spark), f"test-{uuid.uuid4().hex}")
    q = sf.stream_sessions(stream, 100, buckets=4).writeStream.format("parquet").option("checkpointLocation", base + "/state").trigger(availableNow=True).start(base + "/rows")
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.schema(sf.SESSION_OUT).parquet(base + "/rows").collect()), key=str)
    assert got == plain_sessions(arrived, 100)
    groups = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]
    assert groups <= 5  # one for nulls; was one a source, 203


def test_batches_are_written_in_few_files_that_still_prune_runs_and_targets(spark):
    rows = spark.range(4000).selectExpr("CAST(id / 20 AS INT) AS run", "CAST(id / 4 AS INT) AS target", "id AS point_idx", "id * 0.5D AS sx")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # several files, small as the table is
    try:
        back = sinks.write_batches(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert sorted(back.select(rows.columns).collect()) == sorted(rows.collect())
    files = back.groupBy(F.input_file_name().alias("file")).agg(F.min(F.struct("run", "target")).alias("lo"), F.max(F.struct("run", "target")).alias("hi"))
    spans = sorted((tuple(r.lo), tuple(r.hi)) for r in files.collect())
    assert 1 < len(spans) <= 8  # was one a (run, task): some hundreds
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_clouds_are_encoded_from_sorted_rows_not_a_call_each(spark):
    want = QUERIES["src_04_decode_points"](spark, SMALL)
    assert "FlatMapGroups" not in want._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(want.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # every cloud lies in many batches
    try:
        assert sorted(QUERIES["src_04_decode_points"](spark, SMALL).collect()) == want
        per = Counter(r["message_id"] for r in want)
        assert len(per) > 20 and all(sorted(r["point_row"] for r in want if r["message_id"] == m) == list(range(n)) for m, n in list(per.items())[:20])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_points_outside_the_box_of_all_segments_are_not_moved(small):
    p, seg = cut(small.points), env.path_segments(small.path)
    hits = env.envelope_hits(p, seg)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert all(re.search(rf"\({a}#\d+ (>=|<=) -?[\d.]+\)", plan) for a in "xz")  # y has a bound of its own
    assert hits.count() > 0 and env.envelope_hits(p, seg.where("false")).count() == 0
