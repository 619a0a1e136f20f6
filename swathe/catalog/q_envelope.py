"""Envelope containment and its per-frame summary."""

from pyspark.sql import functions as F

from ..operators import envelope as env
from .registry import query
from .sql import HITS


def hits_of(t):
    return env.envelope_hits(t.points, env.path_segments(t.path))


@query(
    "jon_02_envelope_hits", "points path",
    "WITH " + HITS + " SELECT run, frame, point_idx, k, k >= 80 AS extra, range_m FROM hits",
    rnd="range_m",
)
def jon_02(t):
    return hits_of(t).select("run", "frame", "point_idx", "k", "extra", "range_m")


@query(
    "agg_07_frame_hits", "points path",
    "WITH " + HITS + """,
e AS (SELECT run, frame, count(*) AS eligible_points FROM points GROUP BY run, frame),
h AS (SELECT run, frame, count(*) AS hits, count(*) FILTER (k >= 80) AS extrapolated, min(range_m) AS nearest_m,
  arg_min(point_idx, (range_m, point_idx)) AS nearest_idx,
  array_to_string(list_sort(list(point_idx))[1:256], '+') AS sample_ids FROM hits GROUP BY run, frame)
SELECT run, frame, eligible_points, coalesce(hits, 0) AS hits, coalesce(extrapolated, 0) AS extrapolated,
  nearest_idx, nearest_m, sample_ids FROM e LEFT JOIN h USING (run, frame)""",
    rnd="nearest_m", ints="hits extrapolated eligible_points",
)
def agg_07(t):
    points = t.points
    out = env.frame_hits(points, env.envelope_hits(points, env.path_segments(t.path)))
    return out.withColumn("sample_ids", F.concat_ws("+", "sample_ids"))


@query(
    "jon_03_near_prism_hits", "points path",
    "WITH " + HITS + """,
ref AS (SELECT * FROM seg WHERE k = 0)
SELECT p.run, p.frame, count(*) AS hits, min(sqrt(x*x+y*y+z*z)) AS nearest_m FROM points p JOIN ref r ON p.run = r.run
WHERE x*fx+y*fy+z*fz >= 0 AND x*fx+y*fy+z*fz <= 8 AND abs(x*qx+y*qy+z*qz) < 1.05-0.030001
 AND x*ux+y*uy+z*uz > 0.100001 AND x*ux+y*uy+z*uz < 3.0-0.030001 GROUP BY p.run, p.frame""",
    rnd="nearest_m",
)
def jon_03(t):
    ref = env.path_segments(t.path).where(F.col("k") == 0).withColumn("floor", F.lit(0.0)).drop("cx", "cy", "cz")
    hit = env.prism_hits(t.points, ref, ["run"])
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return hit.groupBy("run", "frame").agg(F.count(F.lit(1)).alias("hits"), F.min(r).alias("nearest_m"))


@query(
    "top_04_nearest_hit", "points path",
    "WITH " + HITS + """ SELECT run, frame, arg_min(point_idx, (range_m, point_idx)) AS point_idx, min(range_m) AS range_m
FROM hits GROUP BY run, frame""",
    rnd="range_m",
)
def top_04(t):
    best = F.min(F.struct("range_m", "point_idx")).alias("b")
    return hits_of(t).groupBy("run", "frame").agg(best).select("run", "frame", "b.point_idx", "b.range_m")


@query(
    "evl_09_saved_hits_check", "points path",
    "WITH " + HITS + """, sv AS (SELECT run, frame, point_idx FROM hits WHERE point_idx % 211 <> 3 UNION SELECT run, frame, point_idx FROM points WHERE point_idx % 389 = 7)
SELECT coalesce(h.run, s.run) AS run, count(s.run) AS saved, count(h.run) AS recomputed, count(*) FILTER (s.run IS NULL) AS missing, count(*) FILTER (h.run IS NULL) AS unexpected
FROM hits h FULL JOIN sv s ON h.run = s.run AND h.frame = s.frame AND h.point_idx = s.point_idx GROUP BY 1""",
)
def evl_09(t):
    """Hits written, some left out and some returns added that are none, read back and recomputed with another cell size."""
    from ..plans.evaluate import saved_rows_check
    from ..session import cut

    points, seg = t.points, env.path_segments(t.path)
    ids = ["run", "frame", "point_idx"]
    kept = env.envelope_hits(points, seg).select(*ids).where("point_idx % 211 <> 3")
    saved = cut(kept.unionByName(points.where("point_idx % 389 = 7").select(*ids)).distinct(), "saved")
    return saved_rows_check(saved, env.envelope_hits(points, seg, cell=0.5), ids, ["run"])
