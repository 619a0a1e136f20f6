"""Accuracy studies."""

from pyspark.sql import functions as F

from ..operators import paths as pth
from ..operators.aggregates import range_bins
from ..operators.quantiles import exact_quantiles, sorted_quantile
from ..plans import evaluate as ev
from .q_aggregates import EDGES, LO
from .registry import query

c = F.col
BLOCKS = [0, 30, 50, 75, 100, 150]
LOB = "CASE " + " ".join(f"WHEN range_m >= {a} AND range_m < {b} THEN {a}.0::DOUBLE" for a, b in zip(BLOCKS[:-1], BLOCKS[1:])) + " END"
REACH = """stp AS (SELECT method, run, frame, floor(station/3) AS step, count(*) AS n, avg(CASE WHEN evaluable THEN 1.0::DOUBLE ELSE 0 END) AS evs, avg(CASE WHEN error_m <= 0.5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (evaluable) AS okf, max(range_m) AS far FROM stations GROUP BY ALL),
prf AS (SELECT *, bool_and(n >= 3 AND evs >= 0.5 AND coalesce(okf, 0) >= 0.6) OVER (PARTITION BY method, run, frame ORDER BY step) AS alive FROM stp),
reach AS (SELECT method, run, frame, coalesce(max(far) FILTER (alive), 0) AS reach_m FROM prf GROUP BY ALL)"""


def reach(t):
    s = t.stations.withColumn("step", F.floor(c("station") / 3))
    return pth.continuous_reach(s, ["method", "run", "frame"], "step", tolerance=0.5, min_evaluated=0.5, min_share=0.6)


@query("evl_01_start_metrics", "stations", f"""WITH {REACH}, m AS (SELECT method, run, frame, count(*) AS points, count(*) FILTER (evaluable) AS scored, quantile_cont(error_m, 0.95) FILTER (evaluable) AS p95, avg(CASE WHEN error_m <= 0.05 THEN 1.0::DOUBLE ELSE 0 END) FILTER (evaluable) AS within_5cm, coalesce(bool_or(error_m > 0.59) FILTER (evaluable), false) AS wrong FROM stations GROUP BY ALL)
SELECT m.*, reach_m, scored >= 12 AS eligible, CASE WHEN wrong THEN 'WRONG_STRUCTURE' WHEN reach_m < 145 THEN 'UNRESOLVED' ELSE 'GT_UNAVAILABLE_AHEAD' END AS terminal_reason FROM m JOIN reach USING (method, run, frame)""", rnd="p95 within_5cm reach_m")
def _(t):
    s, k = t.stations, ["method", "run", "frame"]
    ok = c("evaluable")
    m = s.groupBy(*k).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(ok).alias("scored"), F.percentile(F.when(ok, c("error_m")), F.lit(0.95)).alias("p95"),
        F.avg(F.when(ok, (c("error_m") <= 0.05).cast("double"))).alias("within_5cm"), F.coalesce(F.bool_or(F.when(ok, c("error_m") > 0.59)), F.lit(False)).alias("wrong"))
    out = m.join(reach(t), k)
    reason = F.when(c("wrong"), "WRONG_STRUCTURE").when(c("reach_m") < 145, "UNRESOLVED").otherwise("GT_UNAVAILABLE_AHEAD")
    return out.withColumns({"eligible": c("scored") >= 12, "terminal_reason": reason})


@query("evl_02_variant_ablation", "stations", "WITH m AS (SELECT run, method, quantile_cont(error_m, 0.5) AS median, count(*) AS n FROM stations GROUP BY ALL) SELECT m.run, m.method, m.median, m.n, CASE WHEN m.median > 0 THEN b.median/m.median END AS speedup FROM m JOIN m b ON b.run = m.run AND b.method = 'A'", rnd="median speedup")
def _(t):
    return ev.variant_ablation(t.stations, "method", ["run"], "A", "error_m")


@query("evl_03_split_cohort", "stations", "SELECT run, CASE WHEN run % 3 = 0 THEN 'held_out' ELSE 'development' END AS cohort, count(*) AS n, false AS leaks FROM stations GROUP BY ALL")
def _(t):
    s = t.stations
    split = s.select("run").distinct().withColumn("cohort", F.when(c("run") % 3 == 0, "held_out").otherwise("development"))
    return ev.split_cohort(s, split, "run").groupBy("run", "cohort").agg(F.count(F.lit(1)).alias("n"), F.bool_or("leaks").alias("leaks"))


@query("evl_04_compare_builds", "stations", """WITH b AS (SELECT row_id, CASE WHEN row_id % 1001 = 7 THEN station+1 ELSE station END AS station, error_m + CASE WHEN row_id % 3 = 0 THEN 0.00000001 ELSE 0 END AS error_m FROM stations WHERE row_id % 997 <> 5),
j AS (SELECT a.station AS sa, b.station AS sb, a.error_m AS ea, b.error_m AS eb, b.row_id IS NULL AS lone FROM stations a LEFT JOIN b ON a.row_id = b.row_id)
SELECT count(*) AS rows, count(*) FILTER (lone) AS one_sided, count(*) FILTER (NOT lone AND sa <> sb) AS unequal, round(max(abs(ea-eb))*1e8, 1) AS err_e8, false AS same FROM j""", rnd="err_e8")
def _(t):
    a = t.stations.select("row_id", "station", "error_m")
    b = a.where(c("row_id") % 997 != 5).select("row_id", F.when(c("row_id") % 1001 == 7, c("station") + 1).otherwise(c("station")).alias("station"),
                                                (c("error_m") + F.when(c("row_id") % 3 == 0, 1e-8).otherwise(0.0)).alias("error_m"))
    out = ev.compare_builds(a, b, ["row_id"], ["station"], ["error_m"])
    return out.select("rows", "one_sided", "unequal", F.round(c("max_err_error_m") * 1e8, 1).alias("err_e8"), "same")


@query("evl_05_causality_audit", "frames", """WITH u AS (SELECT f.run, f.frame, g.frame AS source, false AS dir FROM frames f JOIN frames g ON g.run = f.run AND g.frame BETWEEN f.frame-3 AND f.frame
UNION ALL SELECT f.run, f.frame, g.frame, true FROM frames f JOIN frames g ON g.run = f.run AND g.frame = f.frame+1
UNION ALL SELECT run, frame, frame+2, frame % 2 = 0 FROM frames WHERE run % 3 = 1 AND frame % 25 IN (5, 24)),
j AS (SELECT u.*, CASE WHEN dir THEN source <> u.frame+1 ELSE source > u.frame END AS late, k.frame IS NULL AS unknown FROM u LEFT JOIN frames k ON k.run = u.run AND k.frame = u.source)
SELECT run, count(*) AS used, count(DISTINCT frame) AS starts, count(*) FILTER (late) AS not_causal, min(frame) FILTER (late) AS first_start, count(*) FILTER (unknown) AS unknown, count(*) FILTER (late OR unknown) = 0 AS causal FROM j GROUP BY run""")
def _(t):
    """Clouds and directions as starts use them; every third run has starts that look two frames ahead, once beyond its end."""
    f = t.frames.select("run", "frame")
    at = lambda source: f.withColumn("source", source)
    recorded = f.select("run", c("frame").alias("source"))
    clouds = at(F.explode(F.sequence(c("frame") - 3, c("frame")))).join(recorded, ["run", "source"]).withColumn("role", F.lit("cloud"))
    directions = at(c("frame") + 1).join(recorded, ["run", "source"]).withColumn("role", F.lit("direction"))
    ahead = at(c("frame") + 2).where((c("run") % 3 == 1) & (c("frame") % 25).isin(5, 24))
    ahead = ahead.withColumn("role", F.when(c("frame") % 2 == 0, "direction").otherwise("cloud"))
    return ev.causality_audit(clouds.unionByName(directions).unionByName(ahead), f, ["run"])


@query("evl_06_overlap_failures", "stations", """WITH q AS (SELECT run, frame, quantile_cont(error_m, 0.9) FILTER (method = 'A') AS first_p90, quantile_cont(error_m, 0.9) FILTER (method = 'B') AS new_p90 FROM stations GROUP BY ALL)
SELECT *, CASE WHEN first_p90 > 0.55 THEN 'OVERLAP_FIRST' WHEN new_p90 > 0.55 THEN 'OVERLAP_NEW_ANCHOR' ELSE '' END AS gate FROM q""", rnd="first_p90 new_p90")
def _(t):
    errors = lambda m: F.array_sort(F.collect_list(F.when(c("method") == m, c("error_m"))))
    q = t.stations.groupBy("run", "frame").agg(errors("A").alias("a"), errors("B").alias("b"))
    q = q.select("run", "frame", sorted_quantile(c("a"), 0.9).alias("first_p90"), sorted_quantile(c("b"), 0.9).alias("new_p90"))
    return q.withColumn("gate", F.when(c("first_p90") > 0.55, "OVERLAP_FIRST").when(c("new_p90") > 0.55, "OVERLAP_NEW_ANCHOR").otherwise(""))


@query("evl_08_schedule_replay", "frames", """WITH m AS (SELECT run, generation, frame AS mf, header_time_ns AS mt, 60 - (frame % 5)*10.0::DOUBLE AS h FROM frames WHERE frame % 4 = 0),
j AS (SELECT f.run, f.frame, max(mf) AS mf, arg_max(mt, mf) AS mt, arg_max(h, mf) AS h, any_value(header_time_ns) AS t FROM frames f LEFT JOIN m ON f.run = m.run AND f.generation = m.generation AND mf <= f.frame GROUP BY ALL)
SELECT run, frame, mf AS model, CAST(t-mt AS DOUBLE)/1e6 AS age_ms, (h - 5*CAST(t-mt AS DOUBLE)/1e9)/5 AS time_to_horizon_s, mf IS NOT NULL AND h - 5*CAST(t-mt AS DOUBLE)/1e9 > 0 AS available FROM j""", rnd="age_ms time_to_horizon_s")
def _(t):
    """States published every fourth frame, driven at 5 m/s."""
    from ..operators.joins import asof_model

    f = t.frames
    m = f.where(c("frame") % 4 == 0)
    j = asof_model(f, m, ["run", "generation"], 1e12)
    j = j.withColumn("h", 60 - (c("model") % 5) * 10.0 - 5 * c("age_ms") / 1000)
    return j.select("run", "frame", "model", "age_ms", (c("h") / 5).alias("time_to_horizon_s"), F.coalesce(c("h") > 0, F.lit(False)).alias("available"))


@query("evl_10_strata_metrics", "stations", f"""WITH {REACH}, v AS (SELECT method, run, frame, quantile_cont(sigma_m*0.15/(1+4*(frame%3)), 0.5) AS curvature, quantile_cont(abs((error_m-0.3)*2*(1+3*(frame%4))), 0.5) AS grade FROM stations WHERE evaluable AND frame % 7 <> 6 GROUP BY ALL),
b AS (SELECT reach_m, CASE WHEN curvature IS NULL THEN 'unavailable' WHEN curvature < 0.002 THEN 'near_straight' WHEN curvature < 0.01 THEN 'mild' ELSE 'strong' END AS cb, CASE WHEN grade IS NULL THEN 'unavailable' WHEN grade < 0.5 THEN '<0.5deg' WHEN grade < 1.5 THEN '0.5-1.5deg' ELSE '>=1.5deg' END AS gb FROM reach LEFT JOIN v USING (method, run, frame)),
e AS (SELECT 'curve_bin' AS kind, cb AS bin, reach_m FROM b UNION ALL SELECT 'grade_bin', gb, reach_m FROM b)
SELECT kind, bin, count(reach_m) AS n, max(reach_m) AS most, quantile_cont(reach_m, 0.5) AS p50, quantile_cont(reach_m, 0.9) AS p90, quantile_cont(reach_m, 0.95) AS p95 FROM e GROUP BY ALL""", rnd="most p50 p90 p95")
def _(t):
    s = t.stations.where(c("evaluable") & (c("frame") % 7 != 6))
    s = s.withColumns({"curvature": c("sigma_m") * 0.15 / (1 + 4 * (c("frame") % 3)), "pitch_deg": (c("error_m") - 0.3) * 2 * (1 + 3 * (c("frame") % 4))})
    starts = ev.start_strata(s, reach(t), ["method", "run", "frame"], "curvature", "pitch_deg")
    return ev.strata_metrics(starts, "reach_m", ["curve_bin", "grade_bin"], 1.0)


@query("evl_11_drift_correlation", "stations", """WITH r AS (SELECT method, rank() OVER (PARTITION BY method ORDER BY station) + (count(*) OVER (PARTITION BY method, station)-1)/2.0::DOUBLE AS a, rank() OVER (PARTITION BY method ORDER BY error_m) + (count(*) OVER (PARTITION BY method, error_m)-1)/2.0::DOUBLE AS b FROM stations)
SELECT method, corr(a, b) AS spearman, count(*) AS n FROM r GROUP BY method""", rnd="spearman")
def _(t):
    return ev.rank_correlation(t.stations, ["method"], "station", "error_m")


SHARE = lambda cond: f"avg(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0 END)"
UTILITY = f"""{REACH}, x AS (SELECT method, run, frame, count(*) FILTER (evaluable AND error_m > 0.598) AS bad, max(range_m) FILTER (evaluable) AS gt_m FROM stations GROUP BY ALL),
a AS (SELECT * FROM reach JOIN x USING (method, run, frame) WHERE frame % 11 <> 10),
vr AS (SELECT 'base' AS variant, * FROM a WHERE method = 'A' UNION ALL SELECT 'other', * FROM a WHERE method = 'B'),
g AS (SELECT v.*, v.reach_m - b.reach_m AS d FROM vr v JOIN vr b ON b.variant = 'base' AND b.run = v.run AND b.frame = v.frame),
p AS (SELECT variant, run, count(*) AS n, 2*{SHARE("reach_m >= 50")} + 3*{SHARE("reach_m >= 75")} + 5*{SHARE("reach_m >= 100")} + avg(least(reach_m, 120))/120 - 10*{SHARE("bad > 0")} - 2*{SHARE("d < -4")} AS utility, {SHARE("reach_m >= 50")} AS p50,
  count(*) FILTER (bad > 0) AS cat, count(*) FILTER (gt_m >= 100) AS g100, count(*) FILTER (gt_m >= 100 AND reach_m >= 100) AS r100, count(*) FILTER (d > 4) AS w4, count(*) FILTER (d > 8) AS w8, count(*) FILTER (d > 20) AS w20, count(*) FILTER (d < -4) AS l4, count(*) FILTER (d < -8) AS l8, count(*) FILTER (d < -20) AS l20 FROM g GROUP BY ALL)"""


def variants(t):
    """Method A as the base and once more under another name, method B, and what a start's stations say about it."""
    s = t.stations.groupBy("method", "run", "frame").agg(
        F.count_if(c("evaluable") & (c("error_m") > 0.598)).alias("bad"), F.max(F.when(c("evaluable"), c("range_m"))).alias("gt_m"))
    r = reach(t).join(s, ["method", "run", "frame"]).withColumn("eligible", c("frame") % 11 != 10)
    names = F.when(c("method") == "A", F.array(F.lit("base"), F.lit("copy"))).otherwise(F.array(F.lit("other")))
    return r.withColumn("variant", F.explode(names)).drop("method")


@query("evl_12_variant_ranking", "stations", f"""WITH {UTILITY}, r AS (SELECT variant, sum(n) AS n, avg(utility) AS mean_utility, median(utility) AS median_utility, min(utility) AS worst_run, min(p50) AS worst_p50, sum(cat) AS catastrophic, CASE WHEN sum(g100) > 0 THEN sum(r100)/sum(g100) END AS conditional_100m, sum(w4) AS wins_4m, sum(w8) AS wins_8m, sum(w20) AS wins_20m, sum(l4) AS losses_4m, sum(l8) AS losses_8m, sum(l20) AS losses_20m FROM p GROUP BY variant)
SELECT *, row_number() OVER (ORDER BY round(mean_utility, 9) DESC, round(median_utility, 9) DESC, worst_p50 DESC, catastrophic, variant) AS place FROM r""",
       rnd="mean_utility median_utility worst_run worst_p50 conditional_100m", ints="n catastrophic wins_4m wins_8m wins_20m losses_4m losses_8m losses_20m place")
def _(t):
    return ev.variant_ranking(variants(t), "base")


@query("evl_12b_left_out_ranking", "stations", f"""WITH {UTILITY}, m AS (SELECT h.run, p.variant, round(avg(utility), 9) AS score FROM (SELECT DISTINCT run FROM p) h JOIN p ON p.run <> h.run GROUP BY ALL),
b AS (SELECT run, variant, score FROM m QUALIFY row_number() OVER (PARTITION BY run ORDER BY score DESC, variant) = 1)
SELECT b.run, b.variant, b.score, p.utility AS own_utility FROM b LEFT JOIN p ON p.run = b.run AND p.variant = b.variant""", rnd="score own_utility")
def _(t):
    return ev.left_out_ranking(variants(t), "base")


SCORED = """sv AS (SELECT method, run, frame, range_m, error_m AS far_error, 0.5*error_m + 0.1*sigma_m AS center_error, error_m <= 3*sigma_m AS inside95, sigma_m AS sigma_lateral, 0.5*sigma_m AS sigma_vertical,
  (error_m/sigma_m)*(error_m/sigma_m) AS far_mahal2, CASE WHEN row_id % 97 <> 13 THEN (error_m/sigma_m)*(error_m/sigma_m)*0.8 + (row_id % 5)*0.3 END AS near_mahal2 FROM stations WHERE evaluable)"""
RUN_SCORE = f"""{SCORED}, bs AS (SELECT method, run, CASE WHEN range_m < 50 THEN 30 WHEN range_m < 75 THEN 50 ELSE 75 END AS lo, count(*) AS n, quantile_cont(far_error, 0.95) + 0.5*quantile_cont(center_error, 0.95) + 0.2*{SHARE("far_error > 0.2")} + 0.05*abs(0.95 - {SHARE("inside95")}) + 0.02*quantile_cont(4.895*sigma_lateral + 4.895*sigma_vertical, 0.5)/2 AS v FROM sv WHERE range_m >= 30 AND range_m < 100 GROUP BY ALL),
rs AS (SELECT method, run, avg(v) AS s FROM bs WHERE n >= 3 GROUP BY ALL)"""


def scored(t):
    e = c("error_m") / c("sigma_m")
    return t.stations.where("evaluable").select(
        "method", "run", "frame", "range_m", c("error_m").alias("far_error"), (0.5 * c("error_m") + 0.1 * c("sigma_m")).alias("center_error"),
        (c("error_m") <= 3 * c("sigma_m")).alias("inside95"), c("sigma_m").alias("sigma_lateral"), (0.5 * c("sigma_m")).alias("sigma_vertical"),
        (e * e).alias("far_mahal2"), F.when(c("row_id") % 97 != 13, e * e * 0.8 + (c("row_id") % 5) * 0.3).alias("near_mahal2"))


@query("evl_13_method_score", "stations", f"WITH {RUN_SCORE} SELECT method, 0.7*avg(s)+0.3*max(s) AS score, avg(s) AS mean_run_score, max(s) AS worst_run_score, count(*) AS runs FROM rs GROUP BY method", rnd="score mean_run_score worst_run_score")
def _(t):
    return ev.method_score(ev.run_scores(scored(t)))


@query("evl_13b_left_out_method", "stations", f"""WITH {RUN_SCORE}, m AS (SELECT h.run, rs.method, round(0.7*avg(s)+0.3*max(s), 9) AS score FROM (SELECT DISTINCT run FROM rs) h JOIN rs ON rs.run <> h.run GROUP BY ALL),
b AS (SELECT run, method, score FROM m QUALIFY row_number() OVER (PARTITION BY run ORDER BY score, method) = 1)
SELECT b.run, b.method, b.score, rs.s AS own_score FROM b LEFT JOIN rs ON rs.run = b.run AND rs.method = b.method""", rnd="score own_score")
def _(t):
    from ..session import cut

    return ev.left_out_method(cut(ev.run_scores(scored(t)), "scores"))


@query("evl_14_corridor_calibration", "stations", f"""WITH {SCORED}, d AS (SELECT *, CASE WHEN near_mahal2 IS NOT NULL THEN greatest(near_mahal2, far_mahal2) END AS m FROM sv WHERE range_m >= 30 AND range_m < 100),
o AS (SELECT method, run, frame, sqrt(m/5.991464547) AS z, count(*) OVER (PARTITION BY method, run, frame) AS n FROM d WHERE m IS NOT NULL),
s AS (SELECT method, run, count(DISTINCT frame) AS s FROM o GROUP BY ALL), w AS (SELECT method, run, z, 1.0::DOUBLE/(n*s) AS w FROM o JOIN s USING (method, run)),
h AS (SELECT DISTINCT method, run AS held FROM w UNION ALL SELECT DISTINCT method, NULL FROM w),
p AS (SELECT h.method, held, z, sum(w) OVER (PARTITION BY h.method, held ORDER BY z, w ROWS UNBOUNDED PRECEDING) - w/2 AS pos, 0.95*sum(w) OVER (PARTITION BY h.method, held) AS t FROM h LEFT JOIN w ON w.method = h.method AND (held IS NULL OR run <> held)),
q AS (SELECT *, lead(pos) OVER k AS pos1, lead(z) OVER k AS z1, lag(pos) OVER k IS NULL AS head FROM p WINDOW k AS (PARTITION BY method, held ORDER BY pos)),
g AS (SELECT method, held, greatest(1, coalesce(max(CASE WHEN pos1 IS NULL OR t < pos THEN z ELSE z + (z1-z)*(t-pos)/(pos1-pos) END) FILTER ((head AND t < pos) OR (pos <= t AND (pos1 IS NULL OR t < pos1))), 1)) AS scale FROM q GROUP BY ALL),
e AS (SELECT d.method, d.run, count(*) AS n, count(DISTINCT frame) AS starts, {SHARE("m <= 5.991464547*scale*scale")} AS coverage, quantile_cont(4.895*sigma_lateral*scale, 0.5) AS width_lateral, quantile_cont(4.895*sigma_vertical*scale, 0.5) AS width_vertical FROM d JOIN g ON g.method = d.method AND g.held = d.run GROUP BY ALL)
SELECT g.method, g.held AS held_run, scale, n, starts, coverage, width_lateral, width_vertical FROM g LEFT JOIN e ON e.method = g.method AND e.run = g.held""", rnd="scale coverage width_lateral width_vertical")
def _(t):
    return ev.corridor_calibration(scored(t))


@query("evl_15_signal_gates", "stations", """WITH RECURSIVE s AS (SELECT run, sigma_m AS x, error_m AS y FROM stations WHERE evaluable),
tr AS (SELECT a.run, list({'x': x, 'y': y}) AS l FROM (SELECT DISTINCT run FROM s) a LEFT JOIN s ON s.run <> a.run GROUP BY a.run),
bis AS (SELECT run, -20.0::DOUBLE AS lo, 20.0::DOUBLE AS hi, 0 AS i FROM tr UNION ALL
  SELECT run, CASE WHEN g < 0 THEN mid ELSE lo END, CASE WHEN g < 0 THEN hi ELSE mid END, i+1 FROM (SELECT b.run, lo, hi, (lo+hi)/2 AS mid, i, list_sum(list_transform(l, lambda e: e.x*((lo+hi)/2*e.x-e.y)/0.02/sqrt(1+power(((lo+hi)/2*e.x-e.y)/0.02, 2)))) AS g FROM bis b JOIN tr ON tr.run = b.run WHERE i < 45)),
co AS (SELECT run, CASE WHEN len(list_filter(l, lambda e: e.x <> 0)) > 0 THEN (lo+hi)/2 ELSE 0 END AS coef, l FROM bis JOIN tr USING (run) WHERE i = 45),
ra AS (SELECT run, list_stddev_pop(list_transform(l, lambda e: coef*e.x-e.y)) AS residual_sigma FROM co),
m AS (SELECT s.run, count(*) AS n, any_value(coef) AS coef, CASE WHEN count(*) >= 10 AND stddev_pop(x) > 0.00001 AND stddev_pop(y) > 0.00001 THEN corr(x, y) END AS correlation, quantile_cont(abs(degrees(y)), 0.95) AS baseline_p95_deg, quantile_cont(abs(degrees(coef*x-y)), 0.95) AS prior_p95_deg FROM s JOIN co ON co.run = s.run GROUP BY s.run),
f AS (SELECT m.*, residual_sigma, CASE WHEN n >= 20 THEN (baseline_p95_deg-prior_p95_deg)/greatest(0.01, baseline_p95_deg) END AS gain FROM m JOIN ra USING (run)),
v AS (SELECT coalesce(count(gain) >= 3 AND median(gain) > 0.1 AND avg(CASE WHEN gain > 0 THEN 1.0::DOUBLE WHEN gain IS NOT NULL THEN 0 END) >= 0.75, false) AS slope_supported, coalesce(count(correlation) FILTER (n >= 20) >= 3 AND median(correlation) FILTER (n >= 20) >= 0.35, false) AS signal_supported FROM f)
SELECT f.*, v.* FROM f, v""", rnd="coef correlation residual_sigma baseline_p95_deg prior_p95_deg gain")
def _(t):
    return ev.signal_gates(t.stations.where("evaluable"), "sigma_m", "error_m")


GRAD = lambda f: f"(hb*hb*lead({f}) OVER v + (ha*ha-hb*hb)*{f} - ha*ha*lag({f}) OVER v)/(hb*ha*(hb+ha))"
VEL = ", ".join(f"{GRAD(k + a)} AS v{k}{a}" for k in "pg" for a in "xyz")
SPEED = lambda k: f"greatest(sqrt(v{k}x*v{k}x+v{k}y*v{k}y), 0.00000001)"
KH = lambda k: f"(v{k}x*({GRAD(f'v{k}y')}) - v{k}y*({GRAD(f'v{k}x')}))/power({SPEED(k)}, 3)"
KV = lambda k: GRAD(f"(v{k}z/{SPEED(k)})")


@query("evl_16_curvature_errors", "stations", f"""WITH c0 AS (SELECT *, 20.0::DOUBLE + 2*station AS s FROM stations WHERE evaluable),
c1 AS (SELECT method, run, frame, station, s, 0.001*s*s AS gx, -s AS gy, 0.0005*s*s AS gz, 0.001*s*s + 0.1*error_m AS px, -s AS py, 0.0005*s*s + 0.05*sigma_m AS pz, CASE WHEN station - lag(station) OVER (PARTITION BY method, run, frame ORDER BY station) > 1 THEN 1 ELSE 0 END AS brk FROM c0),
c2 AS (SELECT *, sum(brk) OVER (PARTITION BY method, run, frame ORDER BY station) AS island FROM c1),
c3 AS (SELECT *, s - lag(s) OVER v AS hb, lead(s) OVER v - s AS ha FROM c2 WINDOW v AS (PARTITION BY method, run, frame, island ORDER BY station)),
c4 AS (SELECT *, {VEL} FROM c3 WINDOW v AS (PARTITION BY method, run, frame, island ORDER BY station)),
c5 AS (SELECT method, sqrt(px*px+py*py+pz*pz) AS r, {KH('p')} - ({KH('g')}) AS h, {KV('p')} - ({KV('g')}) AS k FROM c4 WINDOW v AS (PARTITION BY method, run, frame, island ORDER BY station))
SELECT method, CASE WHEN r < 50 THEN 30.0::DOUBLE WHEN r < 75 THEN 50 ELSE 75 END AS lo, count(*) AS stations, quantile_cont(abs(h), 0.95) AS horizontal_p95, quantile_cont(abs(k), 0.95) AS vertical_p95 FROM c5 WHERE h IS NOT NULL AND r >= 30 AND r < 100 GROUP BY ALL""", rnd="horizontal_p95 vertical_p95")
def _(t):
    """Predicted curves: the reference curve with each station's error to the side and upwards."""
    s = 20.0 + 2 * c("station")
    d = t.stations.where("evaluable").withColumn("s", s)
    d = d.withColumns({"gx": 0.001 * c("s") * c("s"), "gy": -c("s"), "gz": 0.0005 * c("s") * c("s"), "py": -c("s"),
                       "px": 0.001 * c("s") * c("s") + 0.1 * c("error_m"), "pz": 0.0005 * c("s") * c("s") + 0.05 * c("sigma_m")})
    return ev.curvature_summary(ev.curvature_errors(d, ["method", "run", "frame"], "s", "station"), ["method"])


@query("evl_17_monte_carlo_covariance", "path")
def _(t):
    """Two hundred draws around every section of the paths."""
    from .q_projections import _section, axes

    p, state = _section(t)
    _, e1, e2 = axes()
    m = ev.monte_carlo(p, ["run"], ["run", "k"], e1, e2, state)
    return m.withColumn("within_3pct", c("relative_error") < 0.03)
