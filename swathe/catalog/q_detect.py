"""Rail and contact detection, policies, fits and marches."""

from pyspark.sql import functions as F

from ..functions import rotation as rot
from ..operators import aggregates as agg
from ..operators import joins as jn
from ..operators import paths as pth
from ..operators import windows as win
from ..plans import detect as de
from ..plans import fit
from ..plans import march as ma
from ..session import cut
from .q_aggregates import SEC, heads
from .q_joins import CHAIN, vox
from .registry import query

c = F.col

# The sparse cloud is pooled per run, and lengths are ten times those of a dense rail cloud.
WIDE = dict(bin=0.2, kernel=0.4, nms=0.65, reach=0.85, vmin=-3.0, vmax=3.0, wmin=-1.0, wmax=3.0, inner=0.3, outer=1.4, height=0.5, half_width=0.3, half_height=0.3, cell=0.1,
            center_max=0.6, gauge_lo=1.0, gauge_hi=2.4, cant_max=1.0, threshold=0.0)


def slab(t):
    return t.points.select("run", (-c("y")).alias("u"), c("x").alias("v"), c("z").alias("w"))


@query("det_01_rail_candidates", "points")
def _(t):
    r = de.rail_candidates(slab(t), ["run"], WIDE)
    return r.select("run", "side", "rank", "n", *[F.round(n, 6).alias(n) for n in ("v", "w", "support", "scatter")])


@query("det_02_rail_surface", "points")
def _(t):
    p = slab(t)
    r = de.rail_surface(de.rail_candidates(p, ["run"], WIDE), p, ["run"], WIDE)
    return r.select("run", "side", "rank", "surface_points", "longest", "surface_ok")


def _pairs(t):
    p = slab(t)
    return de.rail_pairs(de.rail_surface(de.rail_candidates(p, ["run"], WIDE), p, ["run"], WIDE), ["run"], WIDE)


@query("det_03_rail_pairs", "points")
def _(t):
    return _pairs(t).select("run", "status", "reason", *[F.round(n, 6).alias(n) for n in ("lv", "lw", "rv", "rw", "score", "margin", "confidence")])


@query("det_04_near_rail_refit", "points")
def _(t):
    r = de.near_rail_refit(slab(t), _pairs(t), ["run"], WIDE, max_residual=0.5, gauge=(1.0, 2.4), max_slope=0.3)
    return r.select("run", "status", "sections", *[F.round(n, 6).alias(n) for n in ("residual_m", "gauge_m", "l_sv", "r_sv")])


@query("det_05_prior_correction", "points path", f"""WITH {SEC}, pr AS (SELECT run, 'L' AS side, k, -ly AS u, lx AS v, lz AS w FROM path UNION ALL SELECT run, 'R', k, -ry, rx, rz FROM path),
sg AS (SELECT *, lead(u) OVER q AS u1, lead(v) OVER q AS v1, lead(w) OVER q AS w1, max(u) OVER (PARTITION BY run, side) AS ue FROM pr WINDOW q AS (PARTITION BY run, side ORDER BY k)),
d AS (SELECT hb.run, hb.side, hu, hv - (v+(least(hu, ue)-u)/(u1-u)*(v1-v)) AS dv, hw - (w+(least(hu, ue)-u)/(u1-u)*(w1-w)) AS dw FROM hb JOIN sg ON sg.run = hb.run AND sg.side = hb.side AND u1 IS NOT NULL AND least(hu, ue) >= u AND (least(hu, ue) < u1 OR u1 = ue AND least(hu, ue) = ue)),
f AS (SELECT run, side, max(sqrt(dv*dv+dw*dw)) AS shift, regr_slope(dv, hu) AS sv, regr_slope(dw, hu) AS sw FROM d GROUP BY ALL)
SELECT run, side, shift, sv, sw, CASE WHEN max(shift) OVER (PARTITION BY run) > 2.4 OR max(greatest(abs(sv), abs(sw))) OVER (PARTITION BY run) > 0.3 THEN 'CORRECTION_TOO_LARGE' ELSE 'CORRECTED' END AS prior_status FROM f""", rnd="shift sv sw")
def _(t):
    p = t.path
    prior = p.select("run", F.lit("L").alias("side"), "k", (-c("ly")).alias("u"), c("lx").alias("v"), c("lz").alias("w")).unionByName(
        p.select("run", F.lit("R").alias("side"), "k", (-c("ry")).alias("u"), c("rx").alias("v"), c("rz").alias("w")))
    h = heads(t).select("run", "side", "hu", "hv", "hw")
    return de.prior_correction(prior, h, ["run"], max_shift=2.4, max_slope=0.3).select("run", "side", "shift", "sv", "sw", "prior_status")


def _contact(t):
    from ..operators.projections import rail_relative, slab_roi

    p = slab_roi(t.points, 0, 100).withColumns({"lv": F.lit(-0.792), "lw": F.lit(0.0), "rv": F.lit(0.792), "rw": F.lit(0.0)})
    return de.contact_detect(rail_relative(p, (0.4, -0.1), (1.0, 0.4)), t.template, ["run"])


@query("det_06_contact_detect", "points template")
def _(t):
    return _contact(t).select("run", "status", "n", *[F.round(n, 6).alias(n) for n in ("ov", "ow", "score", "margin", "confidence")])


STATE = "CASE row_id % 4 WHEN 0 THEN 'LEFT' WHEN 1 THEN 'RIGHT' WHEN 2 THEN 'NOT_FOUND' ELSE 'AMBIGUOUS' END"


@query("det_07_contact_availability", "stations", f"""SELECT row_id, CASE WHEN NOT evaluable THEN 'UNKNOWN_NEAR_REFERENCE' WHEN row_id % 4 < 2 AND error_m*10000 <= 5000 THEN 'PRIMARY_CONTACT_PATH' WHEN error_m*10000 <= 5000 THEN 'RAIL_FALLBACK' ELSE 'NEAR_ONLY' END AS choice FROM stations""")
def _(t):
    probe = F.element_at(F.array(*[F.lit(s) for s in ("LEFT", "RIGHT", "NOT_FOUND", "AMBIGUOUS")]), (c("row_id") % 4 + 1).cast("int"))
    return t.stations.select("row_id", de.contact_availability(probe, c("evaluable"), c("error_m") * 10000).alias("choice"))


@query("det_08_path_policy", "stations", f"""WITH s AS (SELECT row_id, row_id % 5 <> 0 AS hp, row_id % 3 <> 0 AS hf, error_m < 0.5 AS po, sigma_m < 0.15 AS fo, range_m AS pe, range_m + sigma_m*50 AS fe, error_m/4 AS pl, error_m/5 AS pv, {STATE} AS cs, evaluable AS ra FROM stations),
q AS (SELECT row_id, CASE WHEN hp AND hf AND po AND fo AND fe > pe + 4 AND pl <= 0.1 AND pv <= 0.08 THEN 'HELD_OBSERVED_TAIL_AFTER_SHORT_MARCH' WHEN hp AND hf AND po AND fo AND fe > pe + 4 THEN 'NEAR_ONLY_CONFLICTING_PATHS'
 WHEN cs IN ('NOT_FOUND', 'AMBIGUOUS') AND hf AND ra THEN 'RAIL_FALLBACK_AFTER_FULL_STEP2_FAILURE' WHEN NOT hp THEN 'NEAR_ONLY_WAITING_FULL_CHAIN' WHEN NOT po THEN 'NEAR_ONLY_RECOMPUTE_CONTRADICTORY_PATH' WHEN pe > 8 THEN 'HELD_COMPLETE_PIPELINE_PATH' ELSE 'NEAR_ONLY_SHORT_PRIMARY' END AS scope FROM s)
SELECT row_id, scope, scope NOT IN ('RAIL_FALLBACK_AFTER_FULL_STEP2_FAILURE', 'HELD_COMPLETE_PIPELINE_PATH') AS retry, scope IN ('HELD_OBSERVED_TAIL_AFTER_SHORT_MARCH', 'RAIL_FALLBACK_AFTER_FULL_STEP2_FAILURE') AS fallback FROM q""")
def _(t):
    probe = F.element_at(F.array(*[F.lit(s) for s in ("LEFT", "RIGHT", "NOT_FOUND", "AMBIGUOUS")]), (c("row_id") % 4 + 1).cast("int"))
    s = t.stations.select("row_id", (c("row_id") % 5 != 0).alias("has_primary"), (c("row_id") % 3 != 0).alias("has_fallback"), (c("error_m") < 0.5).alias("primary_ok"), (c("sigma_m") < 0.15).alias("fallback_ok"),
                          c("range_m").alias("primary_end"), (c("range_m") + c("sigma_m") * 50).alias("fallback_end"), (c("error_m") / 4).alias("prefix_lateral"), (c("error_m") / 5).alias("prefix_vertical"),
                          probe.alias("contact_status"), c("evaluable").alias("reanchored"), F.lit(8.0).alias("near_end"))
    return de.path_policy(s).select("row_id", "scope", "retry", "fallback")


@query("det_09_fuse_history", "points frames", f"""WITH {CHAIN}, h AS (SELECT a.run, a.frame AS target, b.frame AS source FROM ch a JOIN ch b ON a.run = b.run AND a.chain = b.chain AND b.frame BETWEEN a.frame-11 AND a.frame)
SELECT h.target, h.source, p.point_idx, g.r00*(f.r00*x+f.r01*y+f.tx-g.tx)+g.r10*(f.r10*x+f.r11*y+f.ty-g.ty) AS sx, g.r01*(f.r00*x+f.r01*y+f.tx-g.tx)+g.r11*(f.r10*x+f.r11*y+f.ty-g.ty) AS sy, CAST(g.header_time_ns-f.header_time_ns AS DOUBLE)/1e9 AS age_s, sqrt(power(f.tx-g.tx,2)+power(f.ty-g.ty,2)) AS age_m
FROM h JOIN frames f ON f.frame = h.source JOIN frames g ON g.frame = h.target JOIN points p ON p.frame = h.source""", rnd="sx sy age_s age_m")
def _(t):
    """Every start with up to twelve causal clouds."""
    f = t.frames
    h = win.causal_history(win.chains(f, ["run"]), ["run"])
    out = de.fuse_history(t.points, h, f)
    return out.select(c("frame").alias("target"), "source", "point_idx", "sx", "sy", "age_s", "age_m")


@query("det_10_history_select", "frames points")
def _(t):
    f = t.frames
    h = win.causal_history(win.chains(f, ["run"]), ["run"])
    g = f.select("run", c("frame").alias("source"), c("tx").alias("sx"), c("ty").alias("sy"))
    d = h.join(g, ["run", "source"]).join(f.select("run", "frame", "tx", "ty"), ["run", "frame"])
    d = d.withColumn("age_m", F.sqrt((c("sx") - c("tx")) ** 2 + (c("sy") - c("ty")) ** 2)).select("run", "frame", "source", "age", "age_m")
    chosen = de.history_select(d, ["run", "frame"], [0, 1, 2, 4], 3)
    cells = t.points.groupBy("run", c("frame").alias("source")).agg(F.collect_set(F.floor(-c("y"))).alias("cells"))
    start = h.select("run", "frame", "source").join(cells, ["run", "source"])
    cover = de.cover_lists(start, ["run", "frame"]).select("run", "frame", "source", F.lit("COVERAGE").alias("rule"))
    return chosen.unionByName(cover)


@query("det_11_future_reference", "points frames", """WITH d AS (SELECT run, frame, tx, ty, r00, r01, r10, r11, coalesce(sqrt(power(tx-lag(tx) OVER w,2)+power(ty-lag(ty) OVER w,2)), 0) AS d FROM frames WINDOW w AS (PARTITION BY run ORDER BY frame)),
a AS (SELECT *, sum(d) OVER (PARTITION BY run ORDER BY frame) AS arc_m FROM d), h AS (SELECT a.run, CAST(floor((arc_m - p.y)/0.5) AS BIGINT) AS bin, r00*p.x+r01*p.y+tx AS x, r10*p.x+r11*p.y+ty AS y FROM points p JOIN a ON a.run = p.run AND a.frame = p.frame),
m AS (SELECT run, bin, median(x) AS ref_x, median(y) AS ref_y, count(*) AS ref_n FROM h GROUP BY ALL HAVING count(*) >= 2)
SELECT m.run, m.bin, any_value(ref_x) AS ref_x, any_value(ref_y) AS ref_y, any_value(ref_n) AS ref_n, median(abs(x-ref_x))*1.4826 AS ref_spread FROM m JOIN h ON h.run = m.run AND h.bin = m.bin GROUP BY m.run, m.bin""", rnd="ref_x ref_y ref_spread")
def _(t):
    from ..functions.vector import named, vec

    f = pth.arc_length(t.frames, ["run"], ("tx", "ty", "tz"), "frame")
    p = t.points.join(f.select("run", "frame", *rot.POSE), ["run", "frame"])
    h = p.select("run", "frame", (-c("y")).alias("u"), *named(rot.to_world(vec("x", "y", "z"), rot.matrix(), vec("t")), "o"))
    out = de.future_reference(h.select("run", "frame", "u", c("ox").alias("x"), c("oy").alias("y")), f)
    return out.select("run", "bin", "ref_x", "ref_y", "ref_n", "ref_spread")


@query("det_12_linked_component", "points")
def _(t):
    p = t.points.select("frame", F.concat(F.lpad(c("frame").cast("string"), 8, "0"), F.lpad(c("point_idx").cast("string"), 16, "0")).alias("id"), "x", "y", "z")
    seeds = p.groupBy("frame").agg(F.min_by(F.struct("x", "y", "z"), "id").alias("s")).select("frame", "s.*")
    out = de.linked_component(p, seeds, ["frame"], voxel=1.0, radius=2.0, max_gap=1.5)
    return out.groupBy("frame").agg(F.count(F.lit(1)).alias("points"), F.min("id").alias("first_id"))


@query("det_13_split_heads", "points")
def _(t):
    p = slab(t).withColumn("section", F.floor("u"))
    out = de.split_heads(p, ["run", "section"], width=(0.8, 5.0))
    return out.select("run", "section", "n_left", "n_right", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


# --- fits ----------------------------------------------------------------------------------------


def _pairs_of_clouds(t):
    """Each frame's voxelised cloud against a copy moved by 5 cm and 0.3 degrees, with normals."""
    v = cut(vox(t), "clouds")
    sums = jn.knn_lists(v, ["frame"], "point_idx", 6, 4.0, lambda near: {"s": agg.list_covariance(near)}).where("s.n > 0")
    target = cut(agg.symmetric_eigen(sums.select("frame", "point_idx", "x", "y", "z", "s.*")).select("frame", "point_idx", "x", "y", "z", "nx", "ny", "nz"), "clouds")
    a = 0.005
    import math

    co, si = math.cos(a), math.sin(a)
    dx, dy, dz = c("x") - 0.05, c("y") + 0.03, c("z") - 0.02
    source = v.select("frame", c("point_idx").alias("sid"), (co * dx + si * dy).alias("x"), (co * dy - si * dx).alias("y"), dz.alias("z"))
    start = v.select("frame").distinct().select("frame", *[F.lit(fit.IDENTITY[n]).alias(n) for n in rot.POSE])
    return source, target, start


@query("itr_04_align_clouds", "points")
def _(t):
    """Recovers the move of every frame; the true shift is (0.05, -0.03, 0.02)."""
    out = fit.align_clouds(*_pairs_of_clouds(t), ["frame"])
    near = F.sqrt((c("tx") - 0.05) ** 2 + (c("ty") + 0.03) ** 2 + (c("tz") - 0.02) ** 2) < 0.02
    return out.select("frame", near.alias("recovered"), (c("overlap") > 0.9).alias("overlaps"), (c("rmse_plane_m") < 0.02).alias("tight"))


def _corridor(t):
    """Every return as one of a rail with the template's profile that bends with its run, and a start for each run.

    Each fifth return is clutter, between 40 and 46 m an even run has no returns of it, and
    behind 72 m the rail is 5 cm off. The scans are dealt into three ages.
    """
    u, j = -c("y"), F.pmod("point_idx", F.lit(10))
    bend = 0.00005 * (1 + F.pmod("run", F.lit(3))) * u * u
    noise = lambda x: (F.pmod(F.floor(c(x) * 100), F.lit(13)) - 6) / 1000
    off = F.when(u > 72, 0.05).otherwise(0.0)
    stray, hidden = F.pmod("slot", F.lit(5)) == 0, (F.pmod("run", F.lit(2)) == 0) & u.between(40, 46)
    v = F.when(hidden, c("x") + 10).when(stray, c("x")).otherwise(j * 0.012 + bend + noise("x") + off)
    w = F.when(stray, c("z")).otherwise(F.pmod(j, F.lit(7)) * 0.008 + noise("z"))
    p = t.points.select("run", F.concat_ws("-", "frame", "point_idx").alias("id"), F.pmod("frame", F.lit(3)).alias("age"), u.alias("u"), v.alias("v"), w.alias("w"))
    starts = p.select("run").distinct().select("run", F.lit(4.0).alias("u"), F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
    return p, starts


@query("itr_05_march_corridor", "points template")
def _(t):
    p, starts = _corridor(t)
    out = ma.march_corridor(p, starts, t.template, ["run"], dict(lead=0.0))
    return out.select("run", "step", "block", "parent", "state", "gap", "n", *[F.round(x, 6).alias(x) for x in ("residual", "overlap_p90", "su", "u", "v", "w", "score")], "reason")


@query("itr_06_smooth_curves", "path")
def _(t):
    """Paths with a 2 cm zigzag and a stray station in forty, smoothed, with the standard deviation of every station."""
    zigzag = F.when(c("k") % 40 == 7, 0.5).when(c("k") % 2 == 0, 0.02).otherwise(-0.02)
    p = t.path.select("run", "k", "s", (c("lx") + zigzag).alias("x"), c("lz").alias("z"), F.lit(0.02).alias("sigma"))
    out = fit.smooth_curves(p, ["run"], "s", ["x", "z"], "sigma", prior=[(0.025, 0.004), (0.015, 0.015)])
    return out.select("run", "k", *[F.round(n, 6).alias(n) for n in ("x_fit", "z_fit")], *[F.round(F.sqrt(n + "_var"), 6).alias(n + "_sd") for n in "xz"])


@query("itr_07_accept_alignment", "stations", """WITH s AS (SELECT row_id, station*100 AS points, range_m AS span, 1000 AS bp, 40.0::DOUBLE AS bs, 1-error_m AS ov, sigma_m*1.5 AS rm, error_m*6000 AS cd, error_m AS er, sigma_m/4 AS an, (row_id % 30)/10.0::DOUBLE AS el, row_id % 6 AS hi FROM stations),
r AS (SELECT *, CASE WHEN points < greatest(1000, 0.65*bp) OR span < greatest(15, 0.5*bs) THEN 'insufficient_spatial_support' WHEN ov < 0.45 OR rm > 0.22 OR cd > 3000 THEN 'weak_registration' WHEN hi >= 3 AND (er > greatest(0.5, el*1.5) OR an > greatest(0.025, el*0.06)) THEN 'inconsistent_motion' ELSE '' END AS reason FROM s)
SELECT row_id, reason, CASE WHEN reason = '' THEN 'ok' ELSE 'unavailable' END AS pose_status, reason <> '' AND el > 2 AS ends_session FROM r""")
def _(t):
    s = t.stations.select("row_id", (c("station") * 100).alias("points"), c("range_m").alias("span_m"), F.lit(1000).alias("base_points"), F.lit(40.0).alias("base_span_m"), (1 - c("error_m")).alias("overlap"),
                          (c("sigma_m") * 1.5).alias("rmse_plane_m"), (c("error_m") * 6000).alias("condition"), "error_m", (c("sigma_m") / 4).alias("angle_rad"), ((c("row_id") % 30) / 10).alias("elapsed_s"), (c("row_id") % 6).alias("history"))
    return fit.accept_alignment(s).select("row_id", "reason", "pose_status", "ends_session")


@query("itr_08_recover_alignment", "points")
def _(t):
    """Every frame after a gap: two references, of which the newer one of every other frame is 100 m away."""
    source, target, still = _pairs_of_clouds(t)
    odd = c("frame") % 2 == 1
    older = target.select((c("frame") * 2).alias("ref"), "x", "y", "z", "nx", "ny", "nz")
    newer = target.select((c("frame") * 2 + 1).alias("ref"), (c("x") + F.when(odd, 100.0).otherwise(0.0)).alias("x"), "y", "z", "nx", "ny", "nz")
    pose = still.select("frame", *[(c(n) + (c("frame") % 25 if n == "tx" else F.lit(0.0))).alias(n) for n in rot.POSE])
    refs = pose.withColumn("ref", F.explode(F.array(c("frame") * 2, c("frame") * 2 + 1)))
    out = fit.recover_alignment(source, older.unionByName(newer), pose, refs, ["frame"])
    return out.select("frame", "accepted", (c("ref") - 2 * c("frame")).alias("newest"), *[F.round(n, 4).alias(n) for n in ("tx", "ty", "tz", "r10", "overlap", "rmse_plane_m")])


@query("itr_09_compose_poses", "frames", """WITH a AS (SELECT run, frame, sum(CASE WHEN frame % 2 = 1 THEN asin(0.28) ELSE 0 END) OVER (PARTITION BY run ORDER BY frame) AS th, tx, ty FROM frames), p AS (SELECT *, coalesce(lag(th) OVER (PARTITION BY run ORDER BY frame), 0) AS q FROM a)
SELECT run, frame, cos(th) AS r00, sin(th) AS r10, sum(cos(q)*tx-sin(q)*ty) OVER (PARTITION BY run ORDER BY frame) AS px, sum(sin(q)*tx+cos(q)*ty) OVER (PARTITION BY run ORDER BY frame) AS py FROM p""", rnd="r00 r10 px py")
def _(t):
    """Frame poses read as relative ones, in blocks of 8 so that the carry between blocks is used."""
    out = fit.compose_poses(t.frames, ["run"], "frame", block=8)
    return out.select("run", "frame", "r00", "r10", c("tx").alias("px"), c("ty").alias("py"))


@query("itr_10_anchor_chain", "frames", "SELECT run, frame, CASE WHEN frame % 25 >= 12 THEN 0.8*r00-0.6*r10 ELSE r00 END AS r00, CASE WHEN frame % 25 >= 12 THEN 0.6*r00+0.8*r10 ELSE r10 END AS r10, CASE WHEN frame % 25 >= 12 THEN 0.8*tx-0.6*ty+1 ELSE tx END AS tx, CASE WHEN frame % 25 >= 12 THEN 0.6*tx+0.8*ty-2 ELSE ty END AS ty FROM frames", rnd="r00 r10 tx ty")
def _(t):
    f = t.frames
    fix = f.where(c("frame") % 25 == 12).select("run", c("frame").alias("since"), *[F.lit(v).alias(n) for n, v in {"c00": 0.8, "c01": -0.6, "c02": 0.0, "c10": 0.6, "c11": 0.8, "c12": 0.0, "c20": 0.0, "c21": 0.0, "c22": 1.0, "cx": 1.0, "cy": -2.0, "cz": 0.0}.items()])
    return fit.anchor_chain(f.select("run", "frame", *rot.POSE), fix, ["run"]).select("run", "frame", "r00", "r10", "tx", "ty")


@query("itr_11_visibility_likelihood", "points template")
def _(t):
    p = t.points.select("run", "frame", c("point_idx").alias("id"), c("x").alias("v"), c("z").alias("w"))
    out = ma.visibility_likelihood(p, t.template, ["run"], "frame")
    return out.select("run", *[F.round(n, 6).alias(n) for n in ("ov", "ow", "cost", "var_v", "var_w")])


def _reach(t, configs, scene=None):
    """How far each configuration gets: one march, the configurations are columns of its starts."""
    p, starts = scene or _corridor(t)
    each = [starts.withColumns({"config": F.lit(name), **{x: F.lit(float(v)) for x, v in gates.items()}}) for name, gates in configs.items()]
    starts = each[0]
    for more in each[1:]:
        starts = starts.unionByName(more, allowMissingColumns=True)
    known = {x: F.coalesce(c(x), F.lit(float(ma.GATES[x]))) for gates in configs.values() for x in gates}
    out = ma.march_corridor(p, starts.withColumns(known), t.template, ["run"], dict(lead=0.0), by=["config"])
    return out.groupBy("run", "config").agg(F.round(F.max("u"), 6).alias("reach_m"), F.max("reason").alias("reason"), F.count_if(c("step") > 0).alias("blocks"))


@query("evl_07_oracle_bound", "points template")
def _(t):
    """Reach with the normal gate and with the gate an evaluator could have admitted."""
    return _reach(t, {"gate": {}, "admitted": dict(overlap_weak=0.1, overlap_rms=0.06, overlap_most=0.1, lead=0.0)})


@query("evl_18_parameter_sweep", "points template")
def _(t):
    """Distinct configurations of the march; equal ones run once."""
    from ..plans.evaluate import distinct_configs

    return _reach(t, distinct_configs({"base": dict(shape=0.04, min_points=3), "same": dict(min_points=3, shape=0.04), "strict": dict(shape=0.004, min_points=12)}))


# --- joining near and far paths ------------------------------------------------------------------


@query("prj_24_attach_near", "path", """WITH p AS (SELECT run, k, 0.5*k AS u, lx, rx FROM path WHERE run % 4 <> 3 OR k <= 16), n AS (SELECT run-1 AS run, k, lx, rx FROM path WHERE k <= 16 AND run >= 1),
e AS (SELECT run, max(lx) FILTER (k = 16) AS l8, max(rx) FILTER (k = 16) AS r8, (max(lx) FILTER (k = 16)-max(lx) FILTER (k = 14)) AS ls, (max(rx) FILTER (k = 16)-max(rx) FILTER (k = 14)) AS rs FROM n GROUP BY run),
a AS (SELECT run, max(u) AS u1, max(lx) FILTER (k = 16) AS al, max(rx) FILTER (k = 16) AS ar, max(lx) FILTER (k = 18)-max(lx) FILTER (k = 16) AS sl, max(rx) FILTER (k = 18)-max(rx) FILTER (k = 16) AS sr FROM p GROUP BY run HAVING max(u) > 8.1),
t AS (SELECT p.*, al, ar, sl, sr, l8, r8, ls, rs, least(4, u1-8) AS len, least(1, (u-8)/least(4, u1-8)) AS t FROM p JOIN a USING (run) JOIN e USING (run) WHERE k > 16)
SELECT run, k, lx + (1-3*t*t+2*t*t*t)*(l8-al) + len*(t-2*t*t+t*t*t)*(ls-sl) AS lx, rx + (1-3*t*t+2*t*t*t)*(r8-ar) + len*(t-2*t*t+t*t*t)*(rs-sr) AS rx, false AS near, 'CURRENT_NEAR_WITH_BLENDED_TAIL' AS status FROM t
UNION ALL SELECT run, k, lx, rx, true, CASE WHEN run IN (SELECT run FROM a) THEN 'CURRENT_NEAR_WITH_BLENDED_TAIL' ELSE 'NEAR_ONLY_SHORT_OR_NONMONOTONIC_PRIOR' END FROM n""", rnd="lx rx")
def _(t):
    """The first 8 m of the next run's path joined to this run's path; every fourth run has only 8 m of it."""
    p = t.path
    near = p.where((c("k") <= 16) & (c("run") >= 1)).withColumn("run", c("run") - 1)
    return pth.attach_near(p.where((c("run") % 4 != 3) | (c("k") <= 16)), near, ["run"]).select("run", "k", "lx", "rx", "near", "status")


@query("prj_25_reanchor_tail", "path")
def _(t):
    p = t.path
    near = p.where((c("k") <= 16) & (c("run") >= 1)).withColumn("run", c("run") - 1)
    out = pth.reanchor_tail(p, near, ["run"])
    return out.select("run", "k", "near", "status", *[F.round(n, 6).alias(n) for n in ("lx", "ly", "rx", "rz")])
