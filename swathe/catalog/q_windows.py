"""Sessions, slots, histories, runs along a path, top-k and set operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vector import norm
from ..operators import paths as pth
from ..operators import windows as win
from ..operators.aggregates import voxel_first
from ..operators.ordered import blocked_scan, islands, sequence_number
from .q_joins import CHAIN, VOX, vox
from .registry import query

c = F.col


@query("win_01_sessionize", "messages", """WITH l AS (SELECT *, lag(ts_ns) OVER w AS p FROM messages WINDOW w AS (PARTITION BY source ORDER BY message_id))
SELECT source, message_id, sum(CASE WHEN p IS NOT NULL AND NOT (ts_ns-p > 0 AND ts_ns-p < 43200000000000) THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY message_id) AS generation FROM l""", ints="generation")
def _(t):
    """Sessions per source broken by a 12 h gap."""
    out = win.sessionize(t.messages, ["source"], "message_id", "ts_ns", max_gap_ns=43_200_000_000_000)
    return out.select("source", "message_id", "generation")


@query("win_02_valid_edges", "frames", f"WITH {CHAIN} SELECT run, frame, edge, CAST(chain AS BIGINT) AS chain, max(frame) OVER (PARTITION BY run, chain) AS chain_end FROM ch")
def _(t):
    f = win.chains(t.frames, ["run"]).select("run", "frame", "edge", "chain")
    return f.join(f.groupBy("run", "chain").agg(F.max("frame").alias("chain_end")), ["run", "chain"])


SLOTS = """f0 AS (SELECT run, frame, ((header_time_ns - min(header_time_ns) OVER (PARTITION BY run))*3)//1000000000 AS slot FROM frames),
f1 AS (SELECT *, max(slot) OVER (PARTITION BY run ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM f0),
f2 AS (SELECT *, pm IS NULL OR slot > pm AS target FROM f1),
tg AS (SELECT run, frame, lag(frame) OVER (PARTITION BY run ORDER BY frame) AS pt FROM f2 WHERE target)"""


@query("win_03_slot_targets", "frames", f"WITH {SLOTS} SELECT f2.run, f2.frame, CAST(slot AS BIGINT) AS slot, target, pt + 1 AS batch_start FROM f2 LEFT JOIN tg ON f2.run = tg.run AND f2.frame = tg.frame", ints="batch_start")
def _(t):
    return win.slot_targets(t.frames, ["run"], 3).select("run", "frame", "slot", "target", "batch_start")


@query("win_04_stride", "frames", "SELECT run, frame FROM frames WHERE frame % 5 = 2")
def _(t):
    return t.frames.where(c("frame") % 5 == 2).select("run", "frame")


@query("win_05_causal_history", "frames", f"WITH {CHAIN} SELECT a.run, a.frame, b.frame AS source, CAST(a.frame-b.frame AS BIGINT) AS age FROM ch a JOIN ch b ON a.run = b.run AND a.chain = b.chain AND b.frame BETWEEN a.frame-11 AND a.frame", ints="age")
def _(t):
    return win.causal_history(win.chains(t.frames, ["run"]), ["run"]).select("run", "frame", "source", "age")


SPANS = "ff AS (SELECT run, chain, min(frame) AS first FROM ch GROUP BY 1, 2), rf AS (SELECT run, min(frame) AS run_first FROM ch GROUP BY 1)"


@query("win_05b_history_span", "frames", f"""WITH {CHAIN}, {SPANS},
o AS (SELECT a.run, a.frame, max(b.frame) AS beyond FROM ch a JOIN ch b ON a.run = b.run AND a.chain = b.chain AND b.frame < a.frame AND sqrt((a.tx-b.tx)*(a.tx-b.tx)+(a.ty-b.ty)*(a.ty-b.ty)) > 3+1e-10 GROUP BY 1, 2)
SELECT run, frame, coalesce(beyond+1, first) AS from_frame, frame-coalesce(beyond+1, first)+1 AS frames, CASE WHEN beyond IS NOT NULL THEN 'DISTANCE_LIMIT' WHEN first > run_first THEN 'TIME_OR_POSE_GAP' ELSE 'RUN_START' END AS reason
FROM ch JOIN ff USING (run, chain) JOIN rf USING (run) LEFT JOIN o USING (run, frame)""", ints="from_frame frames")
def _(t):
    return win.history_span(win.chains(t.frames, ["run"]), ["run"], distance=3.0).select("run", "frame", "from_frame", "frames", "reason")


@query("win_05c_history_frames", "frames", f"""WITH {CHAIN}, {SPANS}
SELECT run, frame, greatest(first, frame-5) AS from_frame, frame-greatest(first, frame-5)+1 AS frames, CASE WHEN frame-5 >= first AND frame-5 > run_first THEN 'FRAME_LIMIT' WHEN first > run_first THEN 'TIME_OR_POSE_GAP' ELSE 'RUN_START' END AS reason
FROM ch JOIN ff USING (run, chain) JOIN rf USING (run)""", ints="from_frame frames")
def _(t):
    return win.history_span(win.chains(t.frames, ["run"]), ["run"], n=6).select("run", "frame", "from_frame", "frames", "reason")


@query("win_06_arc_length", "path", """WITH d AS (SELECT run, k, coalesce(sqrt(power(lx-lag(lx) OVER w,2)+power(ly-lag(ly) OVER w,2)+power(lz-lag(lz) OVER w,2)), 0) AS d FROM path WINDOW w AS (PARTITION BY run ORDER BY k))
SELECT run, k, sum(d) OVER (PARTITION BY run ORDER BY k) AS arc_m FROM d""", rnd="arc_m")
def _(t):
    return pth.arc_length(t.path, ["run"], ("lx", "ly", "lz")).select("run", "k", "arc_m")


@query("win_07_extend_linear", "path", """WITH ce AS (SELECT run, k, (lx+rx)/2 AS x, (ly+ry)/2 AS y, (lz+rz)/2 AS z FROM path),
d AS (SELECT *, coalesce(sqrt(power(x-lag(x) OVER w,2)+power(y-lag(y) OVER w,2)+power(z-lag(z) OVER w,2)), 0) AS d FROM ce WINDOW w AS (PARTITION BY run ORDER BY k)),
a AS (SELECT *, sum(d) OVER (PARTITION BY run ORDER BY k) AS s FROM d), l AS (SELECT *, max(s) OVER (PARTITION BY run) AS sl, lead(s) OVER (PARTITION BY run ORDER BY k) AS sn FROM a),
tl AS (SELECT *, s - sl AS u FROM l WHERE s >= sl - 3 OR sn >= sl - 3), m AS (SELECT *, u - avg(u) OVER (PARTITION BY run) AS uc FROM tl),
e AS (SELECT run, max(k) AS kl, arg_max(x, k) AS x0, arg_max(y, k) AS y0, arg_max(z, k) AS z0, sum(uc*x)/sum(uc*uc) AS dx, sum(uc*y)/sum(uc*uc) AS dy, sum(uc*z)/sum(uc*uc) AS dz FROM m GROUP BY run HAVING count(*) >= 3)
SELECT run, kl + i AS k, x0 + i*0.1*dx/sqrt(dx*dx+dy*dy+dz*dz) AS x, y0 + i*0.1*dy/sqrt(dx*dx+dy*dy+dz*dz) AS y, z0 + i*0.1*dz/sqrt(dx*dx+dy*dy+dz*dz) AS z, true AS added FROM e, generate_series(1, 50) q(i)
UNION ALL SELECT run, k, x, y, z, false FROM ce""", rnd="x y z", ints="k")
def _(t):
    p = t.path.select("run", "k", *[((c("l" + a) + c("r" + a)) / 2).alias(a) for a in "xyz"])
    return pth.extend_linear(p, ["run"], length=5.0)


GUARD = """up AS (SELECT run, k, -(ly+ry)/2 AS u, lx, lz, rx, rz FROM path WHERE k >= 80), sec AS (SELECT *, (k-80)//4 AS section FROM up),
lim AS (SELECT run, section, min(u) AS u0, min(u) + 2 AS u1 FROM sec GROUP BY ALL), ends AS (SELECT run, max(u) AS ue FROM up GROUP BY run), sx AS (SELECT lim.run, section, u0, least(u1, ue) AS u1 FROM lim JOIN ends USING (run) WHERE u0 < ue),
seg AS (SELECT run, k, u, lx, lz, rx, rz, lead(u) OVER w AS un, lead(lx) OVER w AS lx1, lead(lz) OVER w AS lz1, lead(rx) OVER w AS rx1, lead(rz) OVER w AS rz1 FROM up WINDOW w AS (PARTITION BY run ORDER BY k)),
pt AS (SELECT p.run, p.point_idx, p.frame, sx.section, p.x, p.y, p.z, lx+(-p.y-u)/(un-u)*(lx1-lx) AS hlx, lz+(-p.y-u)/(un-u)*(lz1-lz) AS hlz, rx+(-p.y-u)/(un-u)*(rx1-rx) AS hrx, rz+(-p.y-u)/(un-u)*(rz1-rz) AS hrz
 FROM points p JOIN sx ON p.run = sx.run AND -p.y BETWEEN sx.u0 AND sx.u1 JOIN seg ON seg.run = p.run AND un IS NOT NULL AND -p.y >= u AND (-p.y < un OR -p.y = un AND -p.y = (SELECT max(ue) FROM ends e WHERE e.run = p.run))),
hd AS (SELECT run, section, 'L' AS side, x, y, z FROM pt WHERE abs(x-hlx) <= 0.3 AND abs(z-hlz) <= 0.5 UNION ALL SELECT run, section, 'R', x, y, z FROM pt WHERE abs(x-hrx) <= 0.3 AND abs(z-hrz) <= 0.5),
ag AS (SELECT run, section, side, count(*) AS n, max(y)-min(y) AS span, count(DISTINCT (floor(x/0.03), floor(y/0.03), floor(z/0.03))) AS cells FROM hd GROUP BY ALL),
ok AS (SELECT sx.run, sx.section, count(*) FILTER (n >= 3 AND span >= 0.5 AND cells >= 3) = 2 AS ok FROM sx LEFT JOIN ag USING (run, section) GROUP BY ALL)"""


@query("win_08_supported_prefix", "points path", f"WITH {GUARD} SELECT run, section, ok, bool_and(ok) OVER (PARTITION BY run ORDER BY section) AS accepted FROM ok", ints="section")
def _(t):
    """Sections past vertex 80, with bands of 30 x 50 cm that suit the sparse cloud."""
    return pth.supported_prefix(t.points, t.path, ["run"], observed_k=80, lateral=0.3, vertical=0.5)


@query("win_09_longest_run", "points", """WITH n AS (SELECT frame, CAST(floor(x/0.1) AS BIGINT) AS cell, count(*) AS n FROM points GROUP BY ALL HAVING count(*) >= 2),
i AS (SELECT frame, cell - row_number() OVER (PARTITION BY frame ORDER BY cell) AS g FROM n), r AS (SELECT frame, g, count(*) AS len FROM i GROUP BY ALL) SELECT frame, max(len) AS longest FROM r GROUP BY frame""")
def _(t):
    cells = t.points.groupBy("frame", F.floor(c("x") / 0.1).alias("cell")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return pth.longest_run(cells, ["frame"], "cell")


@query("win_10_motion_median", "frames", """WITH v AS (SELECT run, frame, (tx-lag(tx) OVER w)/0.1 AS vx, (ty-lag(ty) OVER w)/0.1 AS vy FROM frames WINDOW w AS (PARTITION BY run ORDER BY frame))
SELECT run, frame, quantile_cont(vx, 0.5) OVER w5 AS mx, quantile_cont(vy, 0.5) OVER w5 AS my, max(frame % 7) OVER (PARTITION BY run ORDER BY frame ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS support FROM v WINDOW w5 AS (PARTITION BY run ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", rnd="mx my", ints="support")
def _(t):
    f = blocked_scan(t.frames, ["run"], "frame", {"px": ("lag", c("tx")), "py": ("lag", c("ty"))})
    f = f.select("run", "frame", ((c("tx") - c("px")) / 0.1).alias("vx"), ((c("ty") - c("py")) / 0.1).alias("vy"), (c("frame") % 7).alias("s"))
    near = win.trailing(f, ["run"], "frame", 5, 0, {"mx": F.median("b_vx"), "my": F.median("b_vy")})
    best = win.trailing(f, ["run"], "frame", 51, 1, {"support": F.max("b_s")})
    return near.join(best, ["run", "frame"], "left")


@query("win_11_unwrap_angle", "path", """WITH a AS (SELECT run, k, k*0.9::DOUBLE - floor((k*0.9::DOUBLE+pi())/(2*pi()))*2*pi() AS a FROM path), d AS (SELECT *, a - lag(a) OVER (PARTITION BY run ORDER BY k) AS d FROM a)
SELECT run, k, a - 2*pi()*sum(coalesce(round(d/(2*pi())), 0)) OVER (PARTITION BY run ORDER BY k) AS angle FROM d""", rnd="angle")
def _(t):
    tau = 2 * F.pi()
    a = c("k") * 0.9
    p = t.path.withColumn("a", a - F.floor((a + F.pi()) / tau) * tau)
    return pth.unwrap(p, ["run"], "a").select("run", "k", c("unwrapped").alias("angle"))


@query("win_12_gap_age", "path", """WITH g AS (SELECT run, k, s, k % 7 < 3 AS sup, sum(CASE WHEN k % 7 < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY k) AS isl, s - lag(s) OVER (PARTITION BY run ORDER BY k) AS ds FROM path)
SELECT run, k, sum(CASE WHEN sup THEN 0 ELSE coalesce(ds, 0) END) OVER (PARTITION BY run, isl ORDER BY k) AS gap_m FROM g""", rnd="gap_m")
def _(t):
    return pth.gap_age(t.path.withColumn("supported", c("k") % 7 < 3), ["run"], "s").select("run", "k", "gap_m")


@query("win_13_top_candidates", "stations", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run, frame ORDER BY error_m DESC, row_id) AS rk FROM stations), b AS (SELECT run, frame, row_id AS bid, error_m AS be, range_m AS br FROM r WHERE rk = 1),
o AS (SELECT r.run, r.frame, max(error_m) AS other FROM r JOIN b USING (run, frame) WHERE rk > 1 AND abs(range_m - br) > 7 GROUP BY ALL)
SELECT r.run, r.frame, rk, row_id, error_m AS score, be - coalesce(other, be - 3) AS margin FROM r JOIN b USING (run, frame) LEFT JOIN o USING (run, frame) WHERE rk <= 3""", rnd="score margin", ints="rk")
def _(t):
    s = t.stations.select("run", "frame", "row_id", c("error_m").alias("score"), "range_m")
    return win.top_candidates(s, ["run", "frame"], "score", "row_id", 3, distinct=F.abs(c("range_m") - c("__best.range_m")) > 7, fields=["range_m"]).select("run", "frame", "rk", "row_id", "score", "margin")


@query("win_14_continuous_reach", "stations", """WITH st AS (SELECT method, run, frame, floor(station/3) AS step, count(*) AS n, avg(CASE WHEN evaluable THEN 1.0::DOUBLE ELSE 0 END) AS ev, avg(CASE WHEN error_m <= 0.5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (evaluable) AS okf, max(range_m) AS far FROM stations GROUP BY ALL),
p AS (SELECT *, bool_and(n >= 3 AND ev >= 0.5 AND coalesce(okf, 0) >= 0.6) OVER (PARTITION BY method, run, frame ORDER BY step) AS alive FROM st)
SELECT method, run, frame, coalesce(max(far) FILTER (alive), 0) AS reach_m FROM p GROUP BY ALL""", rnd="reach_m")
def _(t):
    s = t.stations.withColumn("step", F.floor(c("station") / 3))
    return pth.continuous_reach(s, ["method", "run", "frame"], "step", tolerance=0.5, min_evaluated=0.5, min_share=0.6)


@query("win_15_first_confirm_last", "obs", """WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY generation, track_id ORDER BY source_frame) AS fr FROM obs)
SELECT generation, track_id, min(source_frame) AS first_frame, min(source_frame) FILTER (fr = 2) AS confirmed_frame, max(source_frame) AS last_frame, count(DISTINCT source_frame) AS frames,
 arg_min(wx, (source_frame, obs_id)) AS first_x, arg_min(obs_id, (-voxel_count, -point_count, source_frame, obs_id)) AS size_obs FROM r GROUP BY ALL""", rnd="first_x", ints="first_frame confirmed_frame last_frame frames size_obs")
def _(t):
    return win.first_confirm_last(t.obs, ["generation", "track_id"])


@query("win_16_gap_cluster", "stations", """WITH RECURSIVE v AS (SELECT method, run, frame, row_id, range_m + error_m AS x, row_number() OVER (PARTITION BY method, run, frame ORDER BY range_m + error_m, row_id) AS rn FROM stations),
g AS (SELECT method, run, frame, row_id, x, rn, x AS start, 1 AS grp FROM v WHERE rn = 1
 UNION ALL SELECT v.method, v.run, v.frame, v.row_id, v.x, v.rn, CASE WHEN v.x - g.start > 9 THEN v.x ELSE g.start END, CASE WHEN v.x - g.start > 9 THEN g.grp+1 ELSE g.grp END FROM g JOIN v ON v.method = g.method AND v.run = g.run AND v.frame = g.frame AND v.rn = g.rn+1)
SELECT method, run, frame, grp, count(*) AS n, avg(x) AS mean_x FROM g GROUP BY method, run, frame, grp""", rnd="mean_x", ints="grp n")
def _(t):
    s = t.stations.withColumn("x", c("range_m") + c("error_m"))
    return pth.gap_cluster(s, ["method", "run", "frame"], "x", "row_id", 9.0)


@query("win_17_longest_step", "path", """WITH d AS (SELECT run, sqrt(power(lx-lag(lx) OVER w,2)+power(ly-lag(ly) OVER w,2)+power(lz-lag(lz) OVER w,2)) AS d, ly - lag(ly) OVER w AS dy FROM path WINDOW w AS (PARTITION BY run ORDER BY k))
SELECT run, max(d) AS longest_m, bool_and(d > 1e-6 AND d <= 5) AS continuous, bool_and(dy < -1e-6) AS forward FROM d WHERE d IS NOT NULL GROUP BY run""", rnd="longest_m")
def _(t):
    return pth.step_check(t.path, ["run"], ("lx", "ly", "lz"))


@query("win_18_remaining_horizon", "points path", """WITH seg AS (SELECT run, k, s, lx, ly, lz, lead(s) OVER w AS s1, lead(lx) OVER w AS x1, lead(ly) OVER w AS y1, lead(lz) OVER w AS z1 FROM path WINDOW w AS (PARTITION BY run ORDER BY k)),
g AS (SELECT *, power(x1-lx,2)+power(y1-ly,2)+power(z1-lz,2) AS l2 FROM seg WHERE s1 IS NOT NULL), e AS (SELECT run, max(s) AS s_end FROM path GROUP BY run),
t AS (SELECT p.run, p.frame, p.point_idx, s, s1, k, p.x, p.y, p.z, lx, ly, lz, x1, y1, z1, greatest(0, least(1, ((p.x-lx)*(x1-lx)+(p.y-ly)*(y1-ly)+(p.z-lz)*(z1-lz))/l2)) AS tc FROM points p JOIN g ON p.run = g.run AND abs(p.y-g.ly) <= 2),
d AS (SELECT *, sqrt(power(x-lx-tc*(x1-lx),2)+power(y-ly-tc*(y1-ly),2)+power(z-lz-tc*(z1-lz),2)) AS d FROM t)
SELECT run, frame, point_idx, any_value(s_end) - arg_min(s+tc*(s1-s), (d, k)) AS horizon_m FROM d JOIN e USING (run) WHERE d <= 0.75 GROUP BY run, frame, point_idx""", rnd="horizon_m")
def _(t):
    curve = t.path.select("run", "k", "s", c("lx").alias("vx"), c("ly").alias("vy"), c("lz").alias("vz"))
    return pth.remaining_horizon(t.points, curve, ["run"], ["frame", "point_idx"], 0.75)


@query("win_19_bishop_frames", "path")
def _(t):
    """Rotation-minimising frames of every path; e1 has no component along the tangent."""
    return pth.bishop_frames(t.path, ["run"], ("lx", "ly", "lz"), (1.0, 0.0, 0.0)).select("run", "k", *[F.round(n, 6).alias(n) for n in ("tx", "ty", "tz", "e1x", "e1y", "e1z")])


@query("win_20_curvature", "path", """WITH v AS (SELECT run, k, lx-lag(lx) OVER w AS ax, ly-lag(ly) OVER w AS ay, lz-lag(lz) OVER w AS az, lead(lx) OVER w - lx AS bx, lead(ly) OVER w - ly AS by_, lead(lz) OVER w - lz AS bz FROM path WINDOW w AS (PARTITION BY run ORDER BY k))
SELECT run, k, 2*acos(greatest(-1, least(1, (ax*bx+ay*by_+az*bz)/sqrt(ax*ax+ay*ay+az*az)/sqrt(bx*bx+by_*by_+bz*bz))))/(sqrt(ax*ax+ay*ay+az*az)+sqrt(bx*bx+by_*by_+bz*bz)) AS curvature FROM v WHERE ax IS NOT NULL AND bx IS NOT NULL""", rnd="curvature")
def _(t):
    return pth.curvature(t.path, ["run"], ("lx", "ly", "lz")).select("run", "k", "curvature")


@query("win_21_max_spacing", "points", """WITH r AS (SELECT DISTINCT frame, sqrt(x*x+y*y+z*z) AS r FROM points), d AS (SELECT frame, r - lag(r) OVER (PARTITION BY frame ORDER BY r) AS d FROM r), m AS (SELECT frame, max(d) AS max_gap_m FROM d GROUP BY frame),
b AS (SELECT f.frame, count(*) AS empty_bins FROM (SELECT DISTINCT frame FROM points) f, generate_series(0, 25) g(i) WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT frame, CAST(floor(r/4) AS BIGINT) AS i FROM r) q WHERE q.frame = f.frame AND q.i = g.i) GROUP BY f.frame)
SELECT frame, max_gap_m, coalesce(empty_bins, 0) AS empty_bins FROM m LEFT JOIN b USING (frame)""", rnd="max_gap_m", ints="empty_bins")
def _(t):
    p = t.points.select("frame", norm((c("x"), c("y"), c("z"))).alias("r"))
    return pth.max_spacing(p, ["frame"], "r", bin_m=4.0, bins=26)


# --- top-k and sampling ---------------------------------------------------------------------------


@query("top_01_latest_per_key", "messages", "SELECT source, arg_max(message_id, (ts_ns, message_id)) AS message_id, count(*) - 1 AS replaced FROM messages GROUP BY source")
def _(t):
    m = F.max_by("message_id", F.struct("ts_ns", "message_id")).alias("message_id")
    return t.messages.groupBy("source").agg(m, (F.count(F.lit(1)) - 1).alias("replaced"))


@query("top_02_best_observation", "obs", "SELECT generation, track_id, arg_min(obs_id, (-voxel_count, -point_count, source_frame, obs_id)) AS obs_id, max(voxel_count) AS voxel_count FROM obs GROUP BY ALL")
def _(t):
    best = F.max_by("obs_id", F.struct("voxel_count", "point_count", -c("source_frame"), -c("obs_id"))).alias("obs_id")
    return t.obs.groupBy("generation", "track_id").agg(best, F.max("voxel_count").alias("voxel_count"))


@query("top_03_even_sample", "points", """WITH r AS (SELECT frame, point_idx, row_number() OVER (PARTITION BY frame ORDER BY point_idx) - 1 AS r, count(*) OVER (PARTITION BY frame) AS n FROM points), w AS (SELECT f.frame, CAST(floor(i*(n-1)/49.0::DOUBLE) AS BIGINT) AS r FROM (SELECT DISTINCT frame, n FROM r) f, generate_series(0, 49) g(i) WHERE n > 50)
SELECT DISTINCT r.frame, point_idx FROM r LEFT JOIN w ON r.frame = w.frame AND r.r = w.r WHERE n <= 50 OR w.frame IS NOT NULL""")
def _(t):
    return win.even_sample(t.points.select("frame", "point_idx"), ["frame"], "point_idx", 50, block=10_000_000_000_000)


@query("top_05_top_n_stops", "stations", "SELECT row_id, error_m AS solve_ms, CASE WHEN evaluable THEN 'RANGE_LIMIT' ELSE 'NO_POINTS' END AS reason FROM stations ORDER BY error_m DESC, row_id LIMIT 20", rnd="solve_ms")
def _(t):
    s = t.stations.select("row_id", c("error_m").alias("solve_ms"), F.when(c("evaluable"), "RANGE_LIMIT").otherwise("NO_POINTS").alias("reason"))
    return s.orderBy(c("solve_ms").desc(), "row_id").limit(20)


# --- sets ----------------------------------------------------------------------------------------


@query("set_01_merge_batch", "points frames", f"""WITH {SLOTS}, b AS (SELECT run, frame AS target, coalesce(pt + 1, frame) AS lo FROM tg), bf AS (SELECT f.*, b.target FROM frames f JOIN b ON f.run = b.run AND f.frame BETWEEN b.lo AND b.target)
SELECT bf.target, p.frame AS owner_frame, p.point_idx, g.r00*(bf.r00*x+bf.r01*y+bf.tx-g.tx)+g.r10*(bf.r10*x+bf.r11*y+bf.ty-g.ty) AS sx, g.r01*(bf.r00*x+bf.r01*y+bf.tx-g.tx)+g.r11*(bf.r10*x+bf.r11*y+bf.ty-g.ty) AS sy
FROM points p JOIN bf ON p.frame = bf.frame JOIN frames g ON g.frame = bf.target WHERE bf.pose_status = 'ok' AND g.pose_status = 'ok'""", rnd="sx sy")
def _(t):
    from ..plans.batches import merge_batch

    return merge_batch(t.points, t.frames, ["run"], 3).select("target", "owner_frame", "point_idx", "sx", "sy")


@query("set_02_assert_disjoint_batches", "frames", f"WITH {SLOTS}, b AS (SELECT run, frame AS target, coalesce(pt + 1, frame) AS lo FROM tg) SELECT b.run, count(*) AS used, count(DISTINCT f.frame) AS frames FROM b JOIN frames f ON f.run = b.run AND f.frame BETWEEN b.lo AND b.target GROUP BY b.run")
def _(t):
    from ..plans.batches import batch_frames

    return batch_frames(t.frames, ["run"], 3).groupBy("run").agg(F.count(F.lit(1)).alias("used"), F.countDistinct("frame").alias("frames"))


@query("set_03_distinct_points", "points", "SELECT frame, floor(x*10+0.5)/10 AS x, floor(y*10+0.5)/10 AS y, floor(z*10+0.5)/10 AS z, min(point_idx) AS point_idx FROM points GROUP BY ALL", rnd="x y z")
def _(t):
    p = t.points.select("frame", "point_idx", *[(F.floor(c(a) * 10 + 0.5) / 10).alias(a) for a in "xyz"])
    return p.groupBy("frame", "x", "y", "z").agg(F.min("point_idx").alias("point_idx"))


@query("set_04_voxel_unique_keep_seed", "points", f"WITH {VOX} SELECT frame, point_idx FROM vox UNION SELECT frame, point_idx FROM points WHERE slot % 8 = 1")
def _(t):
    seeds = t.points.where(c("slot") % 8 == 1).select("frame", "point_idx")
    return vox(t).select("frame", "point_idx").union(seeds).distinct()


@query("set_05_missing_frames", "frames points", "WITH e AS (SELECT min(frame) AS a, max(frame) AS b FROM frames), s AS (SELECT CAST(i AS INTEGER) AS frame FROM e, generate_series(a, b) g(i)) SELECT frame FROM s WHERE frame NOT IN (SELECT frame FROM frames WHERE pose_status = 'ok')")
def _(t):
    f = t.frames
    ok = f.where("pose_status = 'ok'").select("frame")
    span = f.agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("frame")).join(ok, "frame", "left_anti")


@query("top_06_beam_top", "stations", """WITH d AS (SELECT run, frame, CAST(floor(range_m/20) AS BIGINT) AS lane, max(error_m) AS score, arg_min(row_id, (-error_m, row_id)) AS row_id FROM stations GROUP BY ALL),
r AS (SELECT run, frame, score, row_id, row_number() OVER (PARTITION BY run, frame ORDER BY score DESC, row_id) AS rank FROM d) SELECT * FROM r WHERE rank <= 3""", rnd="score", ints="rank")
def _(t):
    """Branches in the same 20 m lane count as one."""
    s = t.stations.withColumn("score", c("error_m"))
    return win.beam_top(s, ["run", "frame"], "score", "row_id", [F.floor(c("range_m") / 20)])
