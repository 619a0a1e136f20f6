"""Grouped statistics."""

from pyspark.sql import functions as F

from ..functions.vector import norm, vec
from ..operators import aggregates as agg
from ..operators import joins as jn
from ..operators.ordered import blocked_scan
from ..operators.projections import far_weight
from ..operators.quantiles import exact_quantiles
from .q_joins import TRES, VOX, vox
from .registry import query

c = F.col


def distance():
    """Range of a return; built on call, as columns need a running session."""
    return norm((c("x"), c("y"), c("z")))


@query("agg_01_voxel_first", "points", "SELECT frame, CAST(floor(x) AS BIGINT) AS ci, CAST(floor(y) AS BIGINT) AS cj, CAST(floor(z) AS BIGINT) AS ck, min(point_idx) AS point_idx, arg_min(intensity, point_idx) AS intensity FROM points GROUP BY ALL", rnd="intensity")
def _(t):
    return agg.voxel_first(t.points, ["frame"], 1.0, "point_idx").select("frame", "ci", "cj", "ck", "point_idx", "intensity")


@query("agg_02_voxel_centroid", "points", "SELECT frame, CAST(floor(x) AS BIGINT) AS ci, CAST(floor(y) AS BIGINT) AS cj, CAST(floor(z) AS BIGINT) AS ck, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS n FROM points GROUP BY ALL", rnd="mx my mz")
def _(t):
    return agg.voxel_centroid(t.points, ["frame"], 1.0)


@query("agg_06_weighted_support", "points", """SELECT frame, ring, sum(w) AS weighted_points, min(w) AS weight_min, count(*) FILTER (r > 70) AS far_count, array_to_string(list_sort(list_distinct(list(slot))), '+') AS sources
FROM (SELECT *, least(1.0::DOUBLE, (70/r)*(70/r)) AS w FROM (SELECT *, sqrt(x*x+y*y+z*z) AS r FROM points) a) q GROUP BY frame, ring HAVING sum(w) >= 3""", rnd="weighted_points weight_min")
def _(t):
    p = t.points.withColumn("r", distance())
    out = agg.weighted_support(p, ["frame", "ring"], far_weight(c("r")), "slot", c("r") > 70)
    return out.withColumn("sources", F.concat_ws("+", "sources"))


DENS = """h AS (SELECT run, CAST(floor(x/0.2) AS BIGINT) AS bu, CAST(floor(z/0.2) AS BIGINT) AS bv, count(*) AS n FROM points GROUP BY ALL), k0 AS (SELECT i AS o, exp(-0.5*(i/2.0::DOUBLE)*(i/2.0::DOUBLE)) AS g FROM generate_series(-8, 8) q(i)), kn AS (SELECT o, g/(SELECT sum(g) FROM k0) AS g FROM k0),
d AS (SELECT run, bu+a.o AS bu, bv+b.o AS bv, sum(n*a.g*b.g) AS density FROM h, kn a, kn b GROUP BY ALL)"""


@query("agg_08_density_2d", "points", f"WITH {DENS} SELECT * FROM d", rnd="density")
def _(t):
    return agg.density_2d(t.points, ["run"], "x", "z", 0.2, 2.0)


@query("agg_09_local_maxima", "points", f"WITH {DENS}, dr AS (SELECT run, bu, bv, round(density, 9) AS density FROM d) SELECT * FROM dr a WHERE density > 0 AND NOT EXISTS (SELECT 1 FROM dr b WHERE a.run = b.run AND b.bu BETWEEN a.bu-1 AND a.bu+1 AND b.bv BETWEEN a.bv-1 AND a.bv+1 AND b.density > a.density)", rnd="density")
def _(t):
    d = agg.density_2d(t.points, ["run"], "x", "z", 0.2, 2.0).withColumn("density", F.round("density", 9))
    return agg.local_maxima(d, ["run"])


SEC = """sd AS (SELECT run, CAST(floor(-y/1) AS BIGINT) AS section, CASE WHEN x < 0 THEN 'L' ELSE 'R' END AS side, -y AS u, x AS v, z AS w FROM points),
lm AS (SELECT run, section, side, quantile_cont(w, 0.7) AS q, count(*) AS n FROM sd GROUP BY ALL HAVING count(*) >= 8),
hd AS (SELECT run, section, side, median(u) AS hu, median(v) AS hv, median(w) AS hw, count(*) AS top FROM sd JOIN lm USING (run, section, side) WHERE w >= q GROUP BY ALL HAVING count(*) >= 3),
hb AS (SELECT * FROM hd WHERE (run, section) IN (SELECT (run, section) FROM hd GROUP BY run, section HAVING count(*) = 2))"""


def heads(t):
    p = t.points.select("run", F.when(c("x") < 0, "L").otherwise("R").alias("side"), (-c("y")).alias("u"), c("x").alias("v"), c("z").alias("w"))
    return agg.section_heads(p, ["run"])


@query("agg_10_section_heads", "points", f"WITH {SEC} SELECT run, section, side, hu, hv, hw, top FROM hb", rnd="hu hv hw")
def _(t):
    return heads(t).select("run", "section", "side", "hu", "hv", "hw", "top")


@query("agg_11_ols_line", "points", f"WITH {SEC} SELECT run, side, regr_slope(hv, hu) AS slope, regr_intercept(hv, hu) AS intercept FROM hb GROUP BY ALL", rnd="slope intercept")
def _(t):
    return heads(t).groupBy("run", "side").agg(F.regr_slope("hv", "hu").alias("slope"), F.regr_intercept("hv", "hu").alias("intercept"))


def _irls_sql(rounds):
    out = "f0 AS (SELECT run, side, regr_slope(hv, hu) AS s, regr_intercept(hv, hu) AS i FROM hb GROUP BY ALL)"
    for n in range(1, rounds + 1):
        out += f""", w{n} AS (SELECT hb.*, least(1.0::DOUBLE, 0.01/greatest(abs(hv-s*hu-i), 1e-9)) AS w FROM hb JOIN f{n-1} USING (run, side)),
f{n} AS (SELECT run, side, (sum(w)*sum(w*hu*hv)-sum(w*hu)*sum(w*hv))/(sum(w)*sum(w*hu*hu)-sum(w*hu)*sum(w*hu)) AS s,
 (sum(w*hv)-(sum(w)*sum(w*hu*hv)-sum(w*hu)*sum(w*hv))/(sum(w)*sum(w*hu*hu)-sum(w*hu)*sum(w*hu))*sum(w*hu))/sum(w) AS i FROM w{n} GROUP BY ALL)"""
    return out


@query("agg_12_irls_line", "points", f"WITH {SEC}, {_irls_sql(3)} SELECT run, side, s AS slope, i AS intercept FROM f3", rnd="slope intercept")
def _(t):
    return agg.irls_line(heads(t), ["run", "side"], "hu", "hv")


@query("agg_13_leave_one_out", "points", f"""WITH {SEC}, f AS (SELECT run, side, regr_slope(hv, hu) AS s, regr_intercept(hv, hu) AS i, count(*) AS n FROM hb GROUP BY ALL),
o AS (SELECT a.run, a.side, a.section, regr_slope(b.hv, b.hu) AS s, regr_intercept(b.hv, b.hu) AS i FROM hb a JOIN hb b ON a.run = b.run AND a.side = b.side AND a.section <> b.section GROUP BY ALL)
SELECT f.run, f.side, max(greatest(abs(o.i-f.i), abs(8*o.s+o.i-8*f.s-f.i))) AS endpoint_change, any_value(n) AS n FROM f JOIN o ON f.run = o.run AND f.side = o.side GROUP BY ALL""", rnd="endpoint_change")
def _(t):
    return agg.leave_one_out(heads(t), ["run", "side"], "hu", "hv", (0.0, 8.0))


@query("agg_14_robust_location", "stations", """WITH m AS (SELECT run, frame, median(error_m) AS m, covar_samp(error_m, sigma_m) AS cov FROM stations GROUP BY ALL)
SELECT s.run, s.frame, any_value(m) AS median, median(abs(error_m-m))*1.4826 AS mad, any_value(cov) AS cov FROM stations s JOIN m ON s.run = m.run AND s.frame = m.frame GROUP BY ALL""", rnd="median mad cov")
def _(t):
    s, k = t.stations, ["run", "frame"]
    cov = s.groupBy(*k).agg(F.covar_samp("error_m", "sigma_m").alias("cov"))
    return agg.robust_location(s, k, "error_m").join(cov, k)


def _covariance(t):
    """Sums over each voxel's eight nearest others, made in its row."""
    out = jn.knn_lists(vox(t), ["frame"], "point_idx", 8, 4.0, lambda near: {"s": agg.list_covariance(near)})
    return out.select("frame", "point_idx", "s.*").where("n > 0")


@query("agg_15_local_pca", "points", f"""WITH {VOX}, d AS (SELECT a.frame, a.point_idx, b.x, b.y, b.z, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d, row_number() OVER (PARTITION BY a.frame, a.point_idx ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.point_idx) AS nn
 FROM vox a JOIN vox b ON a.frame = b.frame AND a.point_idx <> b.point_idx)
SELECT frame, point_idx, max(d) AS far, 8*covar_pop(x, x)*count(*) AS sxx8, 8*covar_pop(x, y)*count(*) AS sxy8, 8*covar_pop(z, z)*count(*) AS szz8 FROM d WHERE nn <= 8 GROUP BY ALL""", rnd="far sxx8 sxy8 szz8")
def _(t):
    return _covariance(t).select("frame", "point_idx", "far", *[(8 * c(n)).alias(n + "8") for n in ("sxx", "sxy", "szz")])


@query("agg_15b_normals", "points")
def _(t):
    """Normals per frame: how many pass the planarity and distance tests."""
    e = agg.symmetric_eigen(_covariance(t))
    good = (c("l0") / F.greatest(c("l0") + c("l1") + c("l2"), F.lit(1e-12)) < 0.12) & (c("far") < 3)
    return e.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"), F.round(F.avg(F.abs("nz")), 4).alias("mean_nz"))


@query("agg_16_robust_pca", "points")
def _(t):
    out = agg.robust_pca(t.points, ["frame"], (0.0, -1.0, 0.0))
    return out.select("frame", "n", *[F.round(p, 6).alias(p) for p in ("px", "py", "pz")])


@query("agg_17_frame_balanced_weights", "points", "SELECT run, frame, point_idx, exp(-abs(y)/20)/count(*) OVER (PARTITION BY run, frame) AS weight FROM points", rnd="weight")
def _(t):
    return agg.balanced_weight(t.points, ["run"], "frame", F.abs(c("y")), 20.0).select("run", "frame", "point_idx", "weight")


@query("agg_18_weighted_stats", "points", """WITH w AS (SELECT frame, x, y, z, intensity AS w FROM points), m AS (SELECT frame, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, sum(w) AS sw FROM w GROUP BY frame),
cv AS (SELECT w.frame, any_value(mx) AS mx, sum(w*(x-mx)*(x-mx))/any_value(sw) AS sxx, sum(w*(x-mx)*(y-my))/any_value(sw) AS sxy FROM w JOIN m ON w.frame = m.frame GROUP BY w.frame),
g AS (SELECT frame, z, sum(w) AS w FROM w GROUP BY ALL), p AS (SELECT frame, z, sum(w) OVER (PARTITION BY frame ORDER BY z) - w/2 AS p, 0.5*sum(w) OVER (PARTITION BY frame) AS t FROM g),
n AS (SELECT *, lead(p) OVER q AS p1, lead(z) OVER q AS z1 FROM p WINDOW q AS (PARTITION BY frame ORDER BY z)),
qz AS (SELECT frame, max(z + (z1-z)*(t-p)/(p1-p)) AS quantile FROM n WHERE p <= t AND t < p1 GROUP BY frame)
SELECT cv.frame, mx, sxx, sxy, quantile FROM cv JOIN qz USING (frame)""", rnd="mx sxx sxy quantile")
def _(t):
    p = t.points.select("frame", "x", "y", "z", c("intensity").alias("w"))
    cov = agg.weighted_mean_cov(p, ["frame"], "w").select("frame", "mx", "sxx", "sxy")
    return cov.join(agg.weighted_quantile(p, ["frame"], "z", "w", 0.5), "frame")


@query("agg_19_binned_median", "points", "SELECT frame, CAST(floor(-y/5) AS BIGINT) AS cell, median(x) AS mx, median(z) AS mz, count(*) AS n FROM points GROUP BY ALL", rnd="mx mz")
def _(t):
    return t.points.groupBy("frame", F.floor(-c("y") / 5).alias("cell")).agg(F.median("x").alias("mx"), F.median("z").alias("mz"), F.count(F.lit(1)).alias("n"))


# Evaluation range bins and thresholds in metres.
EDGES = [0, 10, 20, 30, 40, 50, 60, 75, 100, 125, 150]
THRESHOLDS = [0.01, 0.02, 0.03, 0.05, 0.10, 0.20]
BINS = [(0, 10), (10, 20), (20, 30), (30, 40), (40, 50), (50, 60), (60, 75), (75, 100), (100, 125), (125, 150), (30, 50), (50, 75)]
LO = "CASE " + " ".join(f"WHEN range_m >= {a} AND range_m < {b} THEN {a}.0::DOUBLE" for a, b in zip(EDGES[:-1], EDGES[1:])) + " END"
VALUES = "(VALUES " + ", ".join(f"({a}.0::DOUBLE, {b}.0::DOUBLE)" for a, b in BINS) + ") b(lo, hi)"


@query("agg_20_range_bins", "stations", "SELECT run, frame, method, " + LO + " AS lo, count(*) AS n, count(*) FILTER (evaluable) AS scored, "
       + ", ".join(f"avg(CASE WHEN error_m <= {x} THEN 1.0::DOUBLE ELSE 0 END) FILTER (evaluable) AS within_{int(x*100)}cm" for x in THRESHOLDS)
       + " FROM stations WHERE range_m < 150 GROUP BY ALL", rnd=" ".join(f"within_{int(x*100)}cm" for x in THRESHOLDS))
def _(t):
    return agg.range_bins(t.stations, ["run", "frame", "method"], EDGES, THRESHOLDS)


@query("agg_21_method_metrics", "stations", f"""SELECT method, lo, hi, count(DISTINCT (run, frame)) AS starts, count(*) AS stations, quantile_cont(error_m, 0.5) AS median, quantile_cont(error_m, 0.95) AS p95,
 {', '.join(f'count(*) FILTER (error_m > {x/100}) AS gt{x}cm' for x in (5, 10, 20, 50, 100))}, {', '.join(f'avg(CASE WHEN error_m <= {k}*sigma_m THEN 1.0::DOUBLE ELSE 0 END) AS coverage_{k}s' for k in (1, 2, 3))},
 avg(CASE WHEN (error_m/sigma_m)*(error_m/sigma_m) <= 5.991464547 THEN 1.0::DOUBLE ELSE 0 END) AS inside95, avg(CASE WHEN (error_m/sigma_m)*(error_m/sigma_m) <= 9.210340372 THEN 1.0::DOUBLE ELSE 0 END) AS inside99
FROM stations s JOIN {VALUES} ON range_m >= lo AND range_m < hi WHERE evaluable GROUP BY ALL""", rnd="median p95 coverage_1s coverage_2s coverage_3s inside95 inside99")
def _(t):
    d = agg.overlapping_bins(t.stations.where("evaluable"), BINS)
    k = ["method", "lo", "hi"]
    m2 = (c("error_m") / c("sigma_m")) * (c("error_m") / c("sigma_m"))
    share = lambda e, n: F.avg(e.cast("double")).alias(n)
    out = d.groupBy(*k).agg(
        F.countDistinct("run", "frame").alias("starts"), F.count(F.lit(1)).alias("stations"),
        *[F.count_if(c("error_m") > x / 100).alias(f"gt{x}cm") for x in (5, 10, 20, 50, 100)],
        *[share(c("error_m") <= n * c("sigma_m"), f"coverage_{n}s") for n in (1, 2, 3)],
        share(m2 <= 5.991464547, "inside95"), share(m2 <= 9.210340372, "inside99"))
    return out.join(exact_quantiles(d, k, "error_m", {"median": 0.5, "p95": 0.95}, 0.01), k)


@query("agg_22_point_budget", "points frames", """WITH h AS (SELECT f.run, f.frame AS target, n, g.frame FROM frames f, (VALUES (1), (2), (4), (8), (16)) v(n) JOIN frames g ON true WHERE g.run = f.run AND g.frame BETWEEN f.frame-n+1 AND f.frame)
SELECT target, CAST(n AS INTEGER) AS history, CAST(m AS INTEGER) AS center_m, count(*) AS returns, count(DISTINCT (x, y, z)) AS unique_xyz, count(DISTINCT p.frame) AS sources, count(DISTINCT ring) AS rings FROM h JOIN points p ON p.frame = h.frame, (VALUES (20), (40), (60), (80)) c(m)
WHERE sqrt(x*x+y*y+z*z) >= m-2 AND sqrt(x*x+y*y+z*z) < m+2 GROUP BY ALL""")
def _(t):
    """Budgets around four distances for five history lengths of every start."""
    p = t.points.withColumn("r", distance())
    p = p.withColumn("center_m", F.explode(F.filter(F.array(*[F.lit(m) for m in (20, 40, 60, 80)]), lambda m: (c("r") >= m - 2) & (c("r") < m + 2))))
    return agg.point_budget(p, t.frames.select("run", c("frame").alias("target")), ["run"], "center_m", [1, 2, 4, 8, 16])


@query("agg_23_rank_auc", "", """WITH d AS (SELECT n_chars, quality FROM labels JOIN documents USING (doc_id)), r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1)/2.0::DOUBLE AS r FROM d)
SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, (sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1)*(count(*) FILTER (quality = 1)+1)/2)/(count(*) FILTER (quality = 1)*count(*) FILTER (quality = 0)) AS auc FROM r""", rnd="auc")
def _(t):
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return agg.rank_auc(d, [], "n_chars", c("quality") == 1)


@query("agg_24_latency_stats", "stations", """WITH u AS (SELECT 'error' AS stage, error_m AS ms FROM stations UNION ALL SELECT 'range', range_m FROM stations UNION ALL SELECT 'sigma', sigma_m FROM stations)
SELECT stage, count(*) AS n, quantile_cont(ms, 0.5) AS median, quantile_cont(ms, 0.95) AS p95, max(ms) AS max_ms FROM u GROUP BY stage""", rnd="median p95 max_ms")
def _(t):
    u = t.stations.selectExpr("stack(3, 'error', error_m, 'range', range_m, 'sigma', sigma_m) AS (stage, ms)")
    out = u.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.max("ms").alias("max_ms"))
    return out.join(exact_quantiles(u, ["stage"], "ms", {"median": 0.5, "p95": 0.95}, 0.05), "stage")


PAIR = """st AS (SELECT run, frame, method, bool_or(error_m > 0.1) AS g10, bool_or(error_m > 0.2) AS g20, bool_or(error_m > 0.5) AS g50, bool_or(error_m > 0.59) AS g59 FROM stations WHERE evaluable GROUP BY ALL)"""


def _any_over(t):
    s = t.stations.where("evaluable").groupBy("run", "frame", "method")
    return s.agg(*[F.bool_or(c("error_m") > x / 100).alias(f"g{x}") for x in (10, 20, 50, 59)])


@query("agg_25_any_over", "stations", f"WITH {PAIR} SELECT a.run, count(*) AS starts, count(*) FILTER (a.g50) AS a_g50, count(*) FILTER (b.g50) AS b_g50, count(*) FILTER (b.g59 AND NOT a.g59) AS newly_bad FROM st a JOIN st b ON a.run = b.run AND a.frame = b.frame AND a.method = 'A' AND b.method = 'B' GROUP BY a.run")
def _(t):
    s = _any_over(t)
    a = s.where("method = 'A'").select("run", "frame", c("g50").alias("a50"), c("g59").alias("a59"))
    b = s.where("method = 'B'").select("run", "frame", c("g50").alias("b50"), c("g59").alias("b59"))
    return a.join(b, ["run", "frame"]).groupBy("run").agg(F.count(F.lit(1)).alias("starts"), F.count_if("a50").alias("a_g50"), F.count_if("b50").alias("b_g50"), F.count_if(c("b59") & ~c("a59")).alias("newly_bad"))


@query("agg_26_acceptance_gate", "stations", f"""WITH {PAIR}, p AS (SELECT count(*) AS n, count(*) FILTER (b.g59 AND NOT a.g59) AS extra FROM st a JOIN st b ON a.run = b.run AND a.frame = b.frame AND a.method = 'A' AND b.method = 'B'),
q AS (SELECT lo, quantile_cont(error_m, 0.95) FILTER (method = 'B') - quantile_cont(error_m, 0.95) FILTER (method = 'A') AS d FROM (SELECT *, {LO} AS lo FROM stations WHERE evaluable) s GROUP BY lo),
v AS (SELECT avg(CASE WHEN evaluable THEN 1.0::DOUBLE ELSE 0 END) FILTER (method = 'A') - avg(CASE WHEN evaluable THEN 1.0::DOUBLE ELSE 0 END) FILTER (method = 'B') AS loss FROM stations)
SELECT n AS starts, extra, (SELECT max(d) FROM q) AS worst_degradation_m, loss, extra <= n*0.2 AND (SELECT max(d) FROM q) <= 0.05 AND loss <= 0.02 AS passed FROM p, v""", rnd="worst_degradation_m loss")
def _(t):
    from ..plans.evaluate import acceptance_gate

    return acceptance_gate(t.stations, EDGES, over=0.59, extra_share=0.2, degradation=0.05, availability=0.02)


@query("agg_27_correlations", "stations", """WITH r AS (SELECT run, range_m, error_m, rank() OVER (PARTITION BY run ORDER BY range_m) + (count(*) OVER (PARTITION BY run, range_m) - 1)/2.0::DOUBLE AS ra, rank() OVER (PARTITION BY run ORDER BY error_m) + (count(*) OVER (PARTITION BY run, error_m) - 1)/2.0::DOUBLE AS rb FROM stations)
SELECT run, corr(range_m, error_m) AS pearson, corr(ra, rb) AS spearman FROM r GROUP BY run""", rnd="pearson spearman")
def _(t):
    s = t.stations.select("run", "range_m", "error_m")
    r = agg.average_rank(agg.average_rank(s, ["run"], "range_m", "ra"), ["run"], "error_m", "rb")
    return r.groupBy("run").agg(F.corr("range_m", "error_m").alias("pearson"), F.corr("ra", "rb").alias("spearman"))


@query("agg_28_block_bootstrap", "stations", """WITH s AS (SELECT method, run, floor(frame/20) AS blk, error_m FROM stations WHERE evaluable),
b AS (SELECT method, run, blk, row_number() OVER (PARTITION BY method, run ORDER BY blk)-1 AS slot, count(*) OVER (PARTITION BY method, run) AS blocks FROM (SELECT DISTINCT method, run, blk FROM s)),
d AS (SELECT method, run, rep, CAST('0x' || substr(md5(concat_ws(':', method, run, slot, rep, 17)), 1, 8) AS BIGINT) % blocks AS slot FROM b, range(1, 1001) r(rep)),
m AS (SELECT d.method, rep, median(error_m) AS med FROM d JOIN b ON b.method = d.method AND b.run = d.run AND b.slot = d.slot JOIN s ON s.method = d.method AND s.run = d.run AND s.blk = b.blk GROUP BY ALL)
SELECT method, count(*) AS replicates, quantile_cont(med, 0.025) AS lo, quantile_cont(med, 0.5) AS mid, quantile_cont(med, 0.975) AS hi FROM m GROUP BY method""", rnd="lo mid hi")
def _(t):
    from ..plans.evaluate import block_bootstrap

    return block_bootstrap(t.stations.where("evaluable"), ["method"])


@query("agg_29_normal_equations", "points", f"""WITH {SEC} SELECT run, side, sum(1/(1+top)) AS a00, sum(hu/(1+top)) AS a01, sum(hu*hu/(1+top)) AS a11, sum(hv/(1+top)) AS b0, sum(hu*hv/(1+top)) AS b1 FROM hb GROUP BY ALL""", rnd="a00 a01 a11 b0 b1")
def _(t):
    from ..plans.fit import normal_equations

    h = heads(t)
    out = normal_equations(h, ["run", "side"], [F.lit(1.0), c("hu")], c("hv"), 1 / (1 + c("top")))
    return out.select("run", "side", c("a_0_0").alias("a00"), c("a_0_1").alias("a01"), c("a_1_1").alias("a11"), c("b_0").alias("b0"), c("b_1").alias("b1"))


@query("agg_30_scatter_objectives", "points", """WITH c AS (SELECT frame, quantile_cont(x, 0.5) AS mx, quantile_cont(z, 0.5) AS mz FROM points GROUP BY frame),
p AS (SELECT frame, x - mx AS x, z - mz AS z, (x-mx)*(x-mx) + (z-mz)*(z-mz) AS r2 FROM points JOIN c USING (frame)),
q AS (SELECT frame, quantile_cont(r2, 0.9) AS q, quantile_cont(sqrt(r2), 0.5) AS med FROM p GROUP BY frame),
v AS (SELECT frame, avg(x*x) AS vx, avg(z*z) AS vz, avg(x*z) AS cv FROM p JOIN q USING (frame) WHERE r2 <= q + 1e-12 GROUP BY frame),
e AS (SELECT *, greatest((vx+vz)/2 + sqrt((vx-vz)*(vx-vz)/4 + cv*cv), 1e-10) AS e1, greatest((vx+vz)/2 - sqrt((vx-vz)*(vx-vz)/4 + cv*cv), 1e-10) AS e2 FROM v),
d AS (SELECT frame, quantile_cont(((vz+1e-6)*x*x - 2*cv*x*z + (vx+1e-6)*z*z) / ((vx+1e-6)*(vz+1e-6) - cv*cv), 0.9) AS m90, 1.4826*quantile_cont(abs(sqrt(r2)-med), 0.5) AS mad FROM p JOIN e USING (frame) JOIN q USING (frame) GROUP BY frame),
m AS (SELECT frame, avg(r2) FILTER (sqrt(r2) <= med + greatest(0.003, 2.5*mad) + 1e-12) AS mad FROM p JOIN q USING (frame) JOIN d USING (frame) GROUP BY frame)
SELECT frame, e1+e2+1e-9 AS trace, ln(e1+1e-6)+ln(e2+1e-6) AS logdet, pi()*sqrt((e1+1e-6)*(e2+1e-6))*m90 AS ellipse, m.mad+1e-9 AS mad FROM e JOIN d USING (frame) JOIN m USING (frame)""", rnd="trace logdet ellipse mad")
def _(t):
    """Sums of the grid's round coordinates often lie on a rounding tie; both sides shift them by 1e-9."""
    s = agg.scatter_objectives(t.points, ["frame"], "x", "z")
    return s.withColumns({"trace": c("trace") + 1e-9, "mad": c("mad") + 1e-9})


@query("agg_31_fingerprint", "points")
def _(t):
    return agg.fingerprint(t.points.select("run", "frame", "point_idx", "x", "y", "z"), ["run"])


@query("agg_32_template_visibility", "points template", """WITH pt AS (SELECT run, point_idx, frame, x AS v, z AS w, sqrt(x*x+y*y+z*z) AS r FROM points), m AS (SELECT p.run, p.frame, p.point_idx, any_value(r) AS r, arg_min(t.cell, (round(sqrt(power(p.v-t.v,2)+power(p.w-t.w,2)), 9), t.cell)) AS cell, min(round(sqrt(power(p.v-t.v,2)+power(p.w-t.w,2)), 9)) AS d
 FROM pt p JOIN template t ON abs(p.v-t.v) <= 0.051 AND abs(p.w-t.w) <= 0.051 GROUP BY ALL)
SELECT run, CAST(floor(r/20) AS BIGINT) AS bin, count(*) AS returns, count(DISTINCT cell) AS cells FROM m WHERE d <= 0.05 GROUP BY ALL""")
def _(t):
    p = t.points.select("run", "frame", "point_idx", c("x").alias("v"), c("z").alias("w"), F.floor(distance() / 20).alias("bin")).distinct()
    m = jn.template_distance(p, t.template, ["run", "frame", "point_idx", "bin"], cap=0.05, digits=9).where(c("cell").isNotNull())
    return m.groupBy("run", "bin").agg(F.count(F.lit(1)).alias("returns"), F.countDistinct("cell").alias("cells"))


@query("agg_33_residual_gate", "stations", """WITH q AS (SELECT run, frame, method, quantile_cont(error_m, 0.9) AS p90, quantile_cont(error_m, 0.8) AS p80, avg(CASE WHEN error_m <= 0.03 THEN 1.0::DOUBLE ELSE 0 END) AS f3, avg(CASE WHEN error_m <= 0.04 THEN 1.0::DOUBLE ELSE 0 END) AS f4, sqrt(avg(least(error_m, 0.06)*least(error_m, 0.06))) AS robust FROM stations GROUP BY ALL),
n AS (SELECT run, frame, method, error_m, row_number() OVER (PARTITION BY run, frame, method ORDER BY error_m, row_id) AS r, count(*) OVER (PARTITION BY run, frame, method) AS n FROM stations), tr AS (SELECT run, frame, method, quantile_cont(error_m, 0.9) AS trimmed FROM n WHERE r <= greatest(1, floor(0.9*n)) GROUP BY ALL)
SELECT q.*, trimmed, p90 <= 0.55 AS strong, p90 > 0.55 AND p90 <= 0.57 AND robust <= 0.06 AS weak FROM q JOIN tr USING (run, frame, method)""", rnd="p90 p80 f3 f4 robust trimmed")
def _(t):
    from ..plans.evaluate import residual_gate

    return residual_gate(t.stations, ["run", "frame", "method"], "error_m", "row_id", limit=0.55, weak_limit=0.57, weak_robust=0.06)


@query("agg_34_local_quadratic", "path", """WITH j AS (SELECT a.run, a.k, b.s-a.s AS x, b.lx AS v FROM path a JOIN path b ON a.run = b.run AND b.k BETWEEN a.k-5 AND a.k), g AS (SELECT run, k, count(*)::DOUBLE AS m, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(v) AS b0, sum(v*x) AS b1, sum(v*x*x) AS b2 FROM j GROUP BY ALL HAVING count(*) >= 3),
d AS (SELECT *, m*(s2*s4-s3*s3)-s1*(s1*s4-s2*s3)+s2*(s1*s3-s2*s2) AS det FROM g)
SELECT run, k, CAST(m AS BIGINT) AS m, (m*(b1*s4-s3*b2)-b0*(s1*s4-s3*s2)+s2*(s1*b2-b1*s2))/det AS lx_1, 2*(m*(s2*b2-b1*s3)-s1*(s1*b2-b1*s2)+b0*(s1*s3-s2*s2))/det AS lx_2 FROM d""", rnd="lx_1 lx_2")
def _(t):
    return agg.local_quadratic(t.path, ["run"], "s", ["lx"])


@query("agg_35_support_diversity", "points", """WITH d AS (SELECT run, ring, count(DISTINCT (x, y, z)) AS unique_points, count(DISTINCT frame) AS sources, count(DISTINCT CAST(round_even(atan2(y, x)/1e-5, 0) AS INTEGER)) AS azimuths, count(DISTINCT (floor(x/0.01), floor(y/0.01), floor(z/0.01))) AS cells, max(y)-min(y) AS span FROM points GROUP BY ALL)
SELECT *, unique_points >= 3 AND sources >= 2 AND cells >= 3 AND span >= 0.04 AS diverse FROM d""", rnd="span")
def _(t):
    az = F.rint(F.atan2(c("y"), c("x")) / 1e-5).cast("int")
    d = t.points.groupBy("run", "ring").agg(
        F.countDistinct("x", "y", "z").alias("unique_points"), F.countDistinct("frame").alias("sources"), F.countDistinct(az).alias("azimuths"),
        F.countDistinct(*[F.floor(c(a) / 0.01) for a in "xyz"]).alias("cells"), (F.max("y") - F.min("y")).alias("span"))
    return d.withColumn("diverse", (c("unique_points") >= 3) & (c("sources") >= 2) & (c("cells") >= 3) & (c("span") >= 0.04))


@query("agg_36_age_registration", "points template", f"""WITH {TRES}, b AS (SELECT p.frame % 25 AS age, ov, ow, d FROM rs JOIN points p USING (run, point_idx)), s AS (SELECT age, ov, ow, median(d) AS med, quantile_cont(d, 0.9) AS p90, avg(d) AS mean_d FROM b GROUP BY ALL)
SELECT CAST(age AS INTEGER) AS age, max(med) FILTER (abs(ov) < 1e-9 AND abs(ow) < 1e-9) AS median_residual, max(p90) FILTER (abs(ov) < 1e-9 AND abs(ow) < 1e-9) AS p90_residual, min(round(mean_d, 9)) AS best_mean, arg_min(ov, (round(mean_d, 9), ov, ow)) AS best_v, arg_min(ow, (round(mean_d, 9), ov, ow)) AS best_w FROM s GROUP BY age""", rnd="median_residual p90_residual best_mean best_v best_w")
def _(t):
    p = t.points.select("run", "point_idx", (c("frame") % 25).alias("age"), c("x").alias("v"), c("z").alias("w")).distinct()
    d = jn.template_distance(jn.shifted(p, jn.offset_grid(t.spark, 0.04, 0.02)), t.template, ["run", "age", "point_idx", "ov", "ow"])
    k = ["age", "ov", "ow"]
    here = (F.abs("ov") < 1e-9) & (F.abs("ow") < 1e-9)
    q = exact_quantiles(d.where(here), ["age"], "d", {"median_residual": 0.5, "p90_residual": 0.9}, 0.001)
    best = d.groupBy(*k).agg(F.round(F.avg("d"), 9).alias("m")).groupBy("age").agg(F.min(F.struct("m", "ov", "ow")).alias("b"))
    return q.join(best, "age").select("age", "median_residual", "p90_residual", c("b.m").alias("best_mean"), c("b.ov").alias("best_v"), c("b.ow").alias("best_w"))


@query("agg_37_curve_physics", "path", """WITH v AS (SELECT run, k, lx-lag(lx) OVER w AS ax, ly-lag(ly) OVER w AS ay, lz-lag(lz) OVER w AS az, lead(lx) OVER w - lx AS bx, lead(ly) OVER w - ly AS by_, lead(lz) OVER w - lz AS bz FROM path WINDOW w AS (PARTITION BY run ORDER BY k)),
q AS (SELECT run, k, 2*acos(greatest(-1, least(1, (ax*bx+ay*by_+az*bz)/sqrt(ax*ax+ay*ay+az*az)/sqrt(bx*bx+by_*by_+bz*bz))))/(sqrt(ax*ax+ay*ay+az*az)+sqrt(bx*bx+by_*by_+bz*bz)) AS kap, bz/sqrt(bx*bx+by_*by_) AS grade, ax*bx+ay*by_ < 0 AS back FROM v WHERE ax IS NOT NULL AND bx IS NOT NULL)
SELECT run, 1/greatest(max(kap), 1e-9) AS min_radius_m, max(abs(grade)) AS max_grade, count(*) FILTER (back) AS reversals, false AS self_crossing FROM q GROUP BY run""", rnd="min_radius_m max_grade")
def _(t):
    from ..operators.paths import curve_physics

    return curve_physics(t.path, ["run"], ("lx", "ly", "lz")).select("run", "min_radius_m", "max_grade", "reversals", "self_crossing")
