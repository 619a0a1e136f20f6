"""Filters, transforms, statuses and section geometry."""

import math

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import rotation as rot
from ..functions.cells import packed_key
from ..functions.vector import const, cross, dot, named, norm, unit, vec
from ..operators import projections as prj
from .registry import query
from .sql import SEGMENTS

c = F.col

# Returns with a few invalid coordinates, as a sensor produces them.
RAW = """raw AS (SELECT run, frame, point_idx, slot, ring,
  CASE WHEN point_idx % 41 = 0 THEN CAST(0 AS DOUBLE) WHEN point_idx % 43 = 0 THEN CAST('NaN' AS DOUBLE) ELSE x END AS x,
  CASE WHEN point_idx % 41 = 0 THEN CAST(0 AS DOUBLE) ELSE y END AS y,
  CASE WHEN point_idx % 41 = 0 THEN CAST(0 AS DOUBLE) WHEN point_idx % 47 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE z END AS z
  FROM points)"""
VALID = "NOT isnan(x) AND NOT isnan(z) AND abs(x) < CAST('Infinity' AS DOUBLE) AND abs(z) < CAST('Infinity' AS DOUBLE) AND NOT (x = 0 AND y = 0 AND z = 0)"


def raw(t):
    """Coordinates come out of a generator, so that a filter on them reads columns.

    Pushed through a projection, it would hold the whole formula of ``point_idx`` for each use of each coordinate.
    """
    p = t.points
    zero = c("point_idx") % 41 == 0
    x = F.when(zero, 0.0).when(c("point_idx") % 43 == 0, float("nan")).otherwise(c("x"))
    y = F.when(zero, 0.0).otherwise(c("y"))
    z = F.when(zero, 0.0).when(c("point_idx") % 47 == 0, float("inf")).otherwise(c("z"))
    return p.select("run", "frame", "point_idx", "slot", "ring", F.inline(F.array(F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))


def posed(t):
    return t.points.join(t.frames.drop("run"), "frame")


POSED = "posed AS (SELECT p.*, f.r00, f.r01, f.r10, f.r11, f.tx, f.ty, f.tz, f.pose_status, f.generation FROM points p JOIN frames f ON p.frame = f.frame)"


@query("prj_01_valid_points", "points", f"WITH {RAW} SELECT frame, point_idx, x, y, z FROM raw WHERE {VALID}", rnd="x y z")
def _(t):
    return prj.valid_points(raw(t)).select("frame", "point_idx", "x", "y", "z")


@query("prj_02_range_gate", "points",
       "SELECT frame, point_idx, sqrt(x*x+y*y+z*z) AS range_m FROM points WHERE sqrt(x*x+y*y+z*z) > 1.2 AND sqrt(x*x+y*y+z*z) < 140", rnd="range_m")
def _(t):
    return prj.range_gate(t.points).select("frame", "point_idx", "range_m")


@query("prj_03_to_world", "points frames",
       f"WITH {POSED} SELECT frame, point_idx, r00*x+r01*y+tx AS wx, r10*x+r11*y+ty AS wy, z+tz AS wz FROM posed", rnd="wx wy wz")
def _(t):
    return prj.add_world(posed(t)).select("frame", "point_idx", "wx", "wy", "wz")


@query("prj_04_to_sensor", "points frames", f"""WITH {POSED}, w AS (SELECT frame, point_idx, r00*x+r01*y+tx AS wx, r10*x+r11*y+ty AS wy, z+tz AS wz FROM posed)
SELECT w.frame, point_idx, f.r00*(wx-f.tx)+f.r10*(wy-f.ty) AS sx, f.r01*(wx-f.tx)+f.r11*(wy-f.ty) AS sy, wz-f.tz AS sz
FROM w JOIN frames f ON f.frame = w.frame + 1""", rnd="sx sy sz")
def _(t):
    """Each cloud seen from the pose of the following frame."""
    w = prj.add_world(posed(t)).select("frame", "point_idx", "wx", "wy", "wz")
    nxt = t.frames.select((c("frame") - 1).alias("frame"), *rot.POSE)
    return prj.add_sensor(w.join(nxt, "frame")).select("frame", "point_idx", "sx", "sy", "sz")


@query("prj_05_transform_path", "path frames", """SELECT f.frame, k, r00*lx+r01*ly+tx AS lx, r10*lx+r11*ly+ty AS ly, lz+tz AS lz,
 r00*r00*a+r01*r01*b+2*r00*r01*d AS pxx, r10*r00*a+r11*r01*b+(r10*r01+r11*r00)*d AS pxy, r10*r10*a+r11*r11*b+2*r10*r11*d AS pyy, a+b AS pzz
FROM (SELECT *, 0.01 + k*CAST(0.0001 AS DOUBLE) AS a, 0.02 + k*CAST(0.0002 AS DOUBLE) AS b, k*CAST(0.00005 AS DOUBLE) AS d FROM path) p
JOIN frames f ON f.run = p.run""", rnd="lx ly lz pxx pxy pyy pzz")
def _(t):
    """Paths and covariances carried to the map by every pose of its run."""
    k = c("k").cast("double")
    a, b, d = 0.01 + k * 0.0001, 0.02 + k * 0.0002, k * 0.00005
    p = t.path.withColumns({"pxx": a, "pxy": d, "pxz": F.lit(0.0), "pyy": b, "pyz": F.lit(0.0), "pzz": a + b})
    out = prj.transform_path(p.join(t.frames, "run"), ["l"], ["p"])
    return out.select("frame", "k", "lx", "ly", "lz", "pxx", "pxy", "pyy", "pzz")


@query("prj_06_forward_basis", "obs", """WITH n AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS m FROM (SELECT obs_id,
 CASE WHEN obs_id % 11 = 0 THEN 0 ELSE wx END AS dx, CASE WHEN obs_id % 7 = 0 THEN wx/1000 ELSE wy END AS dy,
 CASE WHEN obs_id % 7 = 0 THEN wx*100 WHEN obs_id % 11 = 0 THEN wz ELSE wz/50 END AS dz FROM (SELECT obs_id, CASE WHEN obs_id % 13 = 0 THEN 0 ELSE wx END AS wx,
 CASE WHEN obs_id % 13 = 0 THEN 0 ELSE wy END AS wy, CASE WHEN obs_id % 13 = 0 THEN 0.001 ELSE wz END AS wz FROM obs) o) q),
f AS (SELECT *, dx/m AS fx, dy/m AS fy, dz/m AS fz FROM n),
u AS (SELECT *, sqrt(fz*fx*fz*fx + fz*fy*fz*fy + (1-fz*fz)*(1-fz*fz)) AS un FROM f),
s AS (SELECT *, CASE WHEN m < 0.01 THEN 'stationary_or_invalid_direction' WHEN un < 0.1 THEN 'near_vertical_direction' ELSE '' END AS reason FROM u),
l AS (SELECT *, -fy/sqrt(fx*fx+fy*fy) AS lx, fx/sqrt(fx*fx+fy*fy) AS ly FROM s)
SELECT obs_id, reason, CASE WHEN reason='' THEN fx END AS fx, CASE WHEN reason='' THEN fz END AS fz, CASE WHEN reason='' THEN lx END AS lx,
 CASE WHEN reason='' THEN ly END AS ly, CASE WHEN reason='' THEN fx*ly-fy*lx END AS uz FROM l""", rnd="fx fz lx ly uz")
def _(t):
    o = t.obs
    still = c("obs_id") % 13 == 0
    o = o.withColumns({"wx": F.when(still, 0.0).otherwise(c("wx")), "wy": F.when(still, 0.0).otherwise(c("wy")), "wz": F.when(still, 0.001).otherwise(c("wz"))})
    m7, m11 = c("obs_id") % 7 == 0, c("obs_id") % 11 == 0
    o = o.withColumns({
        "dx": F.when(m11, 0.0).otherwise(c("wx")), "dy": F.when(m7, c("wx") / 1000).otherwise(c("wy")),
        "dz": F.when(m7, c("wx") * 100).when(m11, c("wz")).otherwise(c("wz") / 50),
    })
    return prj.forward_basis(o).select("obs_id", "reason", "fx", "fz", "lx", "ly", "uz")


@query("prj_07_slab_roi", "points", "SELECT frame, point_idx, -y AS u, x AS v, z AS w FROM points WHERE -y >= 0 AND -y <= 8", rnd="u v w")
def _(t):
    return prj.slab_roi(t.points).select("frame", "point_idx", "u", "v", "w")


@query("prj_08_derive_range_azimuth", "points",
       "SELECT frame, point_idx, sqrt(x*x+y*y+z*z) AS range_m, CAST(round_even(atan2(y, x) / 1e-5, 0) AS INTEGER) AS azimuth FROM points", rnd="range_m")
def _(t):
    return prj.range_azimuth(t.points).select("frame", "point_idx", "range_m", "azimuth")


@query("prj_09_far_weight", "points", "SELECT frame, point_idx, least(1.0::DOUBLE, (70/sqrt(x*x+y*y+z*z))*(70/sqrt(x*x+y*y+z*z))) AS weight FROM points", rnd="weight")
def _(t):
    return t.points.select("frame", "point_idx", prj.far_weight(norm(vec("x", "y", "z"))).alias("weight"))


@query("prj_10_point_key", "points", "SELECT frame, slot, point_idx, CAST(frame AS BIGINT) * 4294967296 + slot AS owner, frame AS frame_back, CAST(slot AS BIGINT) AS slot_back FROM points")
def _(t):
    p = t.points.select("frame", "slot", "point_idx", prj.pack_owner(c("frame"), c("slot")).alias("owner"))
    f, s = prj.unpack_owner(c("owner"))
    return p.select("*", f.alias("frame_back"), s.alias("slot_back"))


@query("prj_11_corridor_box", "points path", f"""WITH {SEGMENTS}, o AS (SELECT * FROM seg WHERE k = 20),
q AS (SELECT p.frame, p.point_idx, (p.x-cx)*fx+(p.y-cy)*fy+(p.z-cz)*fz AS u, (p.x-cx)*qx+(p.y-cy)*qy+(p.z-cz)*qz AS v, (p.x-cx)*ux+(p.y-cy)*uy+(p.z-cz)*uz AS w
 FROM points p JOIN o ON o.run = p.run)
SELECT * FROM q WHERE u >= 0 AND u <= 8 AND v >= -0.5-0.14 AND v <= 0.7+0.14 AND w >= -0.2-0.14 AND w <= 0.9+0.14""", rnd="u v w")
def _(t):
    """The box 10 m ahead along each run's path."""
    from ..operators.envelope import path_segments

    seg = path_segments(t.path).where(c("k") == 20)
    j = t.points.join(seg.drop("k"), "run")
    out = prj.corridor_box(j, vec("c"), (vec("f"), vec("q"), vec("u")), (-0.5, -0.2), (0.7, 0.9))
    return out.select("frame", "point_idx", "u", "v", "w")


@query("prj_12_self_mask", "points", """SELECT frame, point_idx, x, y, z FROM points
WHERE NOT (x BETWEEN -1.5 AND 1.5 AND y BETWEEN -30 AND 0 AND z BETWEEN -1 AND 1.5) OR slot % 5 = 0""", rnd="x y z")
def _(t):
    p = t.points
    seeds = p.where(c("slot") % 5 == 0)
    return prj.self_mask(p, (-1.5, -30, -1), (1.5, 0, 1.5), seeds, ["frame", "point_idx"]).select("frame", "point_idx", "x", "y", "z")


@query("prj_13_classify_status", "stations", """SELECT row_id, CASE WHEN NOT evaluable THEN 'UNKNOWN_NEAR_REFERENCE' WHEN sigma_m > 0.12 THEN 'EXPIRED_RESULT'
 WHEN error_m > 0.3 THEN 'INTRUSION' ELSE 'NO_CONFIRMED_COMPONENT_THIS_BATCH' END AS status,
 CASE WHEN range_m < 5 THEN 'UNKNOWN_NO_RETURNS' WHEN sigma_m > 0.12 THEN (CASE WHEN error_m > 0.3 THEN 'EXPIRED_INTRUSION' ELSE 'UNKNOWN_EXPIRED_RESULT' END)
 WHEN evaluable THEN (CASE WHEN error_m > 0.3 THEN 'INTRUSION' ELSE 'NO_HITS_IN_MODELED_PRISMS' END)
 WHEN error_m > 0.3 THEN 'NEAR_ONLY_INTRUSION' ELSE 'NEAR_ONLY_FAR_UNAVAILABLE' END AS far_status FROM stations""")
def _(t):
    late, some = c("sigma_m") > 0.12, F.when(c("error_m") > 0.3, 1).otherwise(0)
    return t.stations.select(
        "row_id", prj.classify_status(c("evaluable"), late, some).alias("status"),
        prj.classify_far(F.when(c("range_m") < 5, 0).otherwise(1), late, some, c("evaluable")).alias("far_status"),
    )


@query("prj_14_rail_relative", "points", """WITH r AS (SELECT frame, point_idx, side, CASE WHEN side = 'LEFT' THEN -(x - -0.792) ELSE x - 0.792 END AS d, z - 0.1 AS h
 FROM points, (VALUES ('LEFT'), ('RIGHT')) s(side) WHERE -y >= 0 AND -y <= 8)
SELECT * FROM r WHERE d BETWEEN 0.2 AND 1.5 AND h BETWEEN -0.5 AND 1.0""", rnd="d h")
def _(t):
    p = prj.slab_roi(t.points).withColumns({"lv": F.lit(-0.792), "lw": F.lit(0.1), "rv": F.lit(0.792), "rw": F.lit(0.1)})
    return prj.rail_relative(p, (0.2, -0.5), (1.5, 1.0)).select("frame", "point_idx", "side", "d", "h")


@query("prj_15_validate_gauge", "stations", """WITH g AS (SELECT row_id, error_m, CASE WHEN row_id % 17 = 0 THEN NULL ELSE -0.75 - sigma_m END AS lv, error_m/10 AS lw,
 CASE WHEN row_id % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 0.7 END AS rv, CAST(0 AS DOUBLE) AS rw FROM stations),
d AS (SELECT *, sqrt((rv-lv)*(rv-lv)+(rw-lw)*(rw-lw)) AS gap FROM g),
r AS (SELECT *, CASE WHEN lv IS NULL THEN 'reference_unavailable' WHEN isnan(rv) THEN 'reference_nonfinite' WHEN gap < 1.48 THEN 'reference_too_narrow'
 WHEN gap > 1.62 THEN 'reference_too_wide' ELSE 'passed' END AS gauge_reason FROM d)
SELECT row_id, gauge_reason, CASE WHEN gauge_reason NOT IN ('reference_unavailable', 'reference_nonfinite') THEN gap END AS separation_m,
 gauge_reason = 'passed' AS gauge_valid, CASE WHEN gauge_reason = 'passed' THEN error_m END AS error_m FROM r""", rnd="separation_m error_m")
def _(t):
    s = t.stations.withColumns({
        "lv": F.when(c("row_id") % 17 != 0, -0.75 - c("sigma_m")), "lw": c("error_m") / 10,
        "rv": F.when(c("row_id") % 19 == 0, float("nan")).otherwise(0.7), "rw": F.lit(0.0),
    })
    return prj.validate_gauge(s, metrics=["error_m"]).select("row_id", "gauge_reason", "separation_m", "gauge_valid", "error_m")


@query("prj_16_require_columns", "points", "SELECT frame, count(*) AS n FROM points GROUP BY frame")
def _(t):
    p = prj.require_columns(t.points, ["x", "y", "z", "intensity"], ["run", "frame", "point_idx", "slot", "ring"])
    return p.groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("prj_17_null_non_finite", "points", f"""WITH {RAW} SELECT frame, point_idx, CASE WHEN NOT isnan(x) THEN x END AS x, y,
 CASE WHEN abs(z) < CAST('Infinity' AS DOUBLE) THEN z END AS z FROM raw""", rnd="x y z")
def _(t):
    return num.null_non_finite(raw(t).select("frame", "point_idx", "x", "y", "z"))


@query("prj_18_assign_labels", "points", """SELECT frame, point_idx, CASE WHEN slot % 6 = 1 THEN 2 WHEN slot % 10 = 0 THEN 1 ELSE 0 END AS label,
 CASE WHEN slot % 6 = 1 AND slot % 10 = 0 THEN 1 ELSE 0 END AS conflicts FROM points""")
def _(t):
    p, k = t.points, ["frame", "point_idx"]
    return prj.assign_labels(p.select(*k), {1: p.where(c("slot") % 10 == 0), 2: p.where(c("slot") % 6 == 1)}, k)


@query("prj_19_cross_section", "points path", f"""WITH {SEGMENTS}, a AS (SELECT run, k, len, coalesce(sum(len) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM seg),
o AS (SELECT s.*, s.cx+s.fx*(20.2-s0) AS ox, s.cy+s.fy*(20.2-s0) AS oy, s.cz+s.fz*(20.2-s0) AS oz FROM a JOIN seg s USING (run, k) WHERE s0 <= 20.2 AND s0 + a.len > 20.2),
q AS (SELECT p.run, p.frame, p.point_idx, (p.x-ox)*qx+(p.y-oy)*qy+(p.z-oz)*qz AS v, (p.x-ox)*fx+(p.y-oy)*fy+(p.z-oz)*fz AS u, (p.x-ox)*ux+(p.y-oy)*uy+(p.z-oz)*uz AS h
 FROM points p JOIN o ON o.run = p.run)
SELECT frame, point_idx, v, h, abs(v) < 1.02 AND h > 0.10 AND h < 2.97 AS hit FROM q WHERE abs(u) <= 0.5 AND abs(v) <= 5 AND h >= -1 AND h <= 5""", rnd="v h")
def _(t):
    from ..operators.paths import cross_section

    return cross_section(t.points, t.path, 20.2).select("frame", "point_idx", "v", "h", "hit")


def _section(t):
    """A station per path vertex with an exact frame: tangent -Y, axes X and Z."""
    p = t.path.withColumns({"alpha": c("k") * 0.001, "d": 0.7 + c("k") * 0.0001, "h": F.lit(0.15), "g": F.lit(1.584), "hf": F.lit(0.16)})
    return p, {n: c(n) for n in ("alpha", "d", "h", "g", "hf")}



def axes():
    """Tangent and cross axes of the exact stations."""
    return const(0, -1, 0), const(-1, 0, 0), const(0, 0, -1)


RAILS = """st AS (SELECT *, k*CAST(0.001 AS DOUBLE) AS alpha, 0.7+k*CAST(0.0001 AS DOUBLE) AS d FROM path),
ax AS (SELECT *, -cos(alpha) AS bx, -sin(alpha) AS bz, sin(alpha) AS nx, -cos(alpha) AS nz FROM st),
rl AS (SELECT *, cx-d*bx-0.15*nx AS ax, cy AS ay, cz-d*bz-0.15*nz AS az, cx-(d+1.584)*bx-0.16*nx AS fx, cy AS fy, cz-(d+1.584)*bz-0.16*nz AS fz FROM ax)"""


@query("prj_20_rails_from_contact", "path", f"WITH {RAILS} SELECT run, k, ax AS nearx, az AS nearz, fx AS farx, fz AS farz FROM rl", rnd="nearx nearz farx farz")
def _(t):
    p, state = _section(t)
    tan, e1, e2 = axes()
    near, far = prj.rails_from_contact(vec("c"), e1, e2, state, F.lit(1.0))
    return p.select("run", "k", near[0].alias("nearx"), near[2].alias("nearz"), far[0].alias("farx"), far[2].alias("farz"))


@query("prj_21_section_offsets", "path", "SELECT run, k, k*CAST(0.001 AS DOUBLE) AS alpha, 0.7+k*CAST(0.0001 AS DOUBLE) AS d, CAST(0.15 AS DOUBLE) AS h, CAST(1.584 AS DOUBLE) AS g, CAST(0.15 AS DOUBLE) AS hf FROM path", rnd="alpha d h g hf")
def _(t):
    """A state through rails and back again."""
    p, state = _section(t)
    tan, e1, e2 = axes()
    near, far = prj.rails_from_contact(vec("c"), e1, e2, dict(state, hf=c("h")), F.lit(1.0))
    p = p.select("run", "k", *[p2 + a for p2 in "c" for a in "xyz"], *named(near, "a"), *named(far, "b"))
    out = prj.section_offsets(p, "c", "a", "b", tan, e1, e2, 1.0)
    return out.select("run", "k", "alpha", "d", "h", "g", "hf")


@query("prj_22_rail_covariance", "path", f"""WITH {RAILS}, j AS (SELECT *, -d*bx-0.15*nx AS rx_, -d*bz-0.15*nz AS rz_, -d*nx+0.15*bx AS jax, -d*nz+0.15*bz AS jaz, 0.001+k*CAST(0.00001 AS DOUBLE) AS va FROM rl)
SELECT run, k, 0.0004 + jax*jax*va + bx*bx*0.002 + nx*nx*0.003 AS cxx, jax*jaz*va + bx*bz*0.002 + nx*nz*0.003 AS cxz,
 0.0004 + jaz*jaz*va + bz*bz*0.002 + nz*nz*0.003 AS czz, 0.0004 + ((bz*rx_-bx*rz_)*(bz*rx_-bx*rz_) + (nz*rx_-nx*rz_)*(nz*rx_-nx*rz_))*0.0001 AS cyy FROM j""", rnd="cxx cxz czz cyy")
def _(t):
    p, state = _section(t)
    tan, e1, e2 = axes()
    var = [0.001 + c("k") * 0.00001, F.lit(0.002), F.lit(0.003), F.lit(0.0), F.lit(0.0)]
    cov = prj.rail_covariance(e1, e2, state, F.lit(1.0), var, F.lit(0.02), F.lit(0.01), far=False)
    return p.select("run", "k", *[cov[n].alias("c" + n) for n in ("xx", "xz", "zz", "yy")])


@query("prj_23_continue_rails", "path", """WITH s AS (SELECT run, k, s, greatest(s-8, 0) AS dist, k*0.5-floor(k/10)*5 AS gap FROM path),
e AS (SELECT *, dist*dist*dist/(dist*dist+4) AS el FROM s), z AS (SELECT *, least(el/50, 1) AS z FROM e)
SELECT run, k, 0.01 + 0.002*50*(z - z*z + z*z*z/3) AS alpha_spline, 0.01 + 0.002*50*(1-exp(-el/50)) AS alpha_smooth,
 0.0001 + dist*power(radians(0.05),2) + power(50*(1-exp(-dist/50))*0.0005,2) + power(radians(0.1),2)*gap AS variance FROM z""", rnd="alpha_spline alpha_smooth variance")
def _(t):
    p = t.path.withColumn("dist", F.greatest(c("s") - 8, F.lit(0.0)))
    gap = c("k") * 0.5 - F.floor(c("k") / 10) * 5
    x0, slope = F.lit(0.01), F.lit(0.002)
    return p.select(
        "run", "k", prj.continue_alpha(x0, slope, c("dist"), "spline").alias("alpha_spline"),
        prj.continue_alpha(x0, slope, c("dist"), "smooth").alias("alpha_smooth"),
        prj.continue_variance(F.lit(0.0001), F.lit(0.0005), c("dist"), gap).alias("variance"),
    )


@query("prj_26_perturb_points", "points")
def _(t):
    """Per run and scenario, the kept share and the mean shift of the disturbed cloud."""
    p = t.points
    scen = t.spark.createDataFrame([("base", 0.0, 0.0, 1000), ("shift_3cm", 0.03, 0.0, 1000), ("drop_20pct", 0.0, 0.0, 800)], "scenario string, shift_x double, shift_z double, keep_permille int")
    out = prj.perturb_points(p, scen, c("point_idx"))
    return out.groupBy("run", "scenario").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean_x"))


def _lim(name, steps):
    return f"greatest({name}, CASE level WHEN 0 THEN {steps[0]} WHEN 1 THEN {steps[1]} WHEN 2 THEN {steps[2]} WHEN 3 THEN {steps[3]} END)"


@query("prj_27_adaptive_limits", "stations", f"""WITH l AS (SELECT row_id, CASE WHEN station*2 >= 24 THEN (CASE WHEN range_m >= 80 THEN 3 WHEN range_m >= 60 THEN 2 WHEN range_m >= 40 THEN 1 ELSE 0 END) END AS level FROM stations)
SELECT row_id, {_lim('0.02', (.025, .03, .04, .05))}::DOUBLE AS shape_limit, {_lim('0.03', (.03, .05, .08, .12))}::DOUBLE AS gate_limit, {_lim('0.03', (.03, .035, .04, .05))}::DOUBLE AS overlap_limit FROM l""", rnd="shape_limit gate_limit overlap_limit")
def _(t):
    s = t.stations.withColumn("maturity_m", c("station") * 2.0)
    return prj.adaptive_limits(s, "range", 0.02, 0.03, 0.03).select("row_id", "shape_limit", "gate_limit", "overlap_limit")


@query("prj_28_dewarp", "points", "SELECT frame, point_idx, x - 0.5*power(floor(-y/4)*4+2, 2)*0.002 AS v, z - 0.5*power(floor(-y/4)*4+2, 2)*0.0005 AS w FROM points", rnd="v w")
def _(t):
    v, w = prj.dewarp(-c("y"), c("x"), c("z"), F.lit(0.002), F.lit(0.0005))
    return t.points.select("frame", "point_idx", v.alias("v"), w.alias("w"))


PARTS = """r AS (SELECT *, round(v, 3) AS rv, round(w, 3) AS rw FROM template),
mv AS (SELECT rv FROM r GROUP BY rv ORDER BY count(*) DESC, rv LIMIT 1), mw AS (SELECT rw FROM r GROUP BY rw ORDER BY count(*) DESC, rw LIMIT 1)"""


@query("prj_29_template_part", "template", f"""WITH {PARTS}
SELECT cell, abs(v-rv0) < 0.004 AS vertical, abs(w-rw0) < 0.004 AS horizontal, sqrt((v-rv0)*(v-rv0)+(w-rw0)*(w-rw0)) <= 0.04 AS corner
FROM template, (SELECT rv AS rv0 FROM mv) a, (SELECT rw AS rw0 FROM mw) b""")
def _(t):
    from ..operators.aggregates import template_parts

    return template_parts(t.template).select("cell", "vertical", "horizontal", "corner")


# --- scalar families -----------------------------------------------------------------------------


@query("scl_01_vector", "path", """SELECT run, k, lx*rx+ly*ry+lz*rz AS d, ly*rz-lz*ry AS cx_, lz*rx-lx*rz AS cy_, lx*ry-ly*rx AS cz_, sqrt(lx*lx+ly*ly+lz*lz) AS n,
 lx/sqrt(lx*lx+ly*ly+lz*lz) AS ux, CASE WHEN sqrt(ly*ly+lz*lz) >= 1e-10 THEN ly/sqrt(ly*ly+lz*lz) END AS gy FROM path""", rnd="d cx_ cy_ cz_ n ux gy")
def _(t):
    l, r = vec("l"), vec("r")
    x = cross(l, r)
    return t.path.select("run", "k", dot(l, r).alias("d"), x[0].alias("cx_"), x[1].alias("cy_"), x[2].alias("cz_"), norm(l).alias("n"),
                         unit(l)[0].alias("ux"), unit((F.lit(0.0), c("ly"), c("lz")))[1].alias("gy"))


@query("scl_02_rotations", "frames", "SELECT f.frame, f.r00*g.r00+f.r01*g.r10 AS c00, f.r10*g.r00+f.r11*g.r10 AS c10, abs(asin(f.r10*g.r00-f.r00*g.r10)) AS geodesic, cos(f.frame*0.01) AS z00, sin(f.frame*0.01) AS z10 FROM frames f JOIN frames g ON g.frame = f.frame + 1", rnd="c00 c10 geodesic z00 z10")
def _(t):
    f = t.frames.select("frame", *rot.R_NAMES)
    g = t.frames.select((c("frame") - 1).alias("frame"), *[c(n).alias("s" + n[1:]) for n in rot.R_NAMES])
    a, b = rot.matrix("r"), rot.matrix("s")
    ab, rel = rot.compose(a, b), rot.compose(rot.transpose(a), b)
    z = rot.rodrigues((F.lit(0.0), F.lit(0.0), c("frame") * 0.01))
    return f.join(g, "frame").select("frame", ab[0][0].alias("c00"), ab[1][0].alias("c10"), rot.angle(rel).alias("geodesic"), z[0][0].alias("z00"), z[1][0].alias("z10"))


@query("scl_03_slerp_pose", "frames", """WITH e AS (SELECT f.frame, f.tx, f.ty, g.tx AS gx, g.ty AS gy, atan2(f.r10, f.r00) AS a, atan2(g.r10, g.r00) AS b FROM frames f JOIN frames g ON g.frame = f.frame + 1),
s AS (SELECT *, CAST(i AS DOUBLE)/4 AS w FROM e, generate_series(1, 3) q(i))
SELECT frame, w AS t, tx+w*(gx-tx) AS px, ty+w*(gy-ty) AS py, cos(a+w*(b-a)) AS m00, sin(a+w*(b-a)) AS m10, true AS estimated FROM s""", rnd="t px py m00 m10")
def _(t):
    """Three estimated poses between every two neighbouring frames."""
    f = t.frames.select("frame", *rot.POSE)
    g = t.frames.select((c("frame") - 1).alias("frame"), *[c(n).alias("s" + n[1:]) for n in rot.R_NAMES], c("tx").alias("gx"), c("ty").alias("gy"))
    j = f.join(g, "frame").select("*", *[q.alias(f"a{i}") for i, q in enumerate(rot.quaternion(rot.matrix("r")))],
                                  *[q.alias(f"b{i}") for i, q in enumerate(rot.quaternion(rot.matrix("s")))])
    j = j.select("*", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("t"))
    q = rot.slerp([c(f"a{i}") for i in range(4)], [c(f"b{i}") for i in range(4)], c("t"))
    j = j.select("*", *[x.alias(f"q{i}") for i, x in enumerate(q)])
    m = rot.from_quaternion([c(f"q{i}") for i in range(4)])
    return j.select("frame", "t", (c("tx") + c("t") * (c("gx") - c("tx"))).alias("px"), (c("ty") + c("t") * (c("gy") - c("ty"))).alias("py"),
                    m[0][0].alias("m00"), m[1][0].alias("m10"), F.lit(True).alias("estimated"))


@query("scl_04_wrap_angle", "points", "SELECT frame, point_idx, (x + pi()/2) - floor((x + pi()/2)/pi())*pi() - pi()/2 AS a FROM points", rnd="a")
def _(t):
    return t.points.select("frame", "point_idx", num.wrap_half_turn(c("x")).alias("a"))


@query("scl_05_cell_keys", "points", """SELECT frame, point_idx, (CAST(floor(x/0.22) AS BIGINT)+1048576)*4398046511104 + (CAST(floor(y/0.22) AS BIGINT)+1048576)*2097152 + CAST(floor(z/0.22) AS BIGINT)+1048576 AS key,
 CAST(NULL AS BIGINT) AS outside FROM points""")
def _(t):
    v = vec("x", "y", "z")
    far = (c("x") + 1e9, c("y"), c("z"))
    return t.points.select("frame", "point_idx", packed_key(v, 0.22).alias("key"), packed_key(far, 0.22).alias("outside"))


@query("scl_06_robust_weights", "stations", """SELECT row_id, least(1.0::DOUBLE, 1.5/greatest(r, 1e-12)) AS huber, 1/(1+(r/2)*(r/2)) AS cauchy, power(greatest(0, 1-(r/4.685)*(r/4.685)), 2) AS tukey, 5/(4+r*r) AS student
FROM (SELECT row_id, greatest(error_m/sigma_m, 1e-12) AS r FROM stations) q""", rnd="huber cauchy tukey student")
def _(t):
    r = c("error_m") / c("sigma_m")
    return t.stations.select("row_id", *[num.robust_weight(r, n).alias(n) for n in ("huber", "cauchy", "tukey", "student")])


@query("scl_07_confidence", "stations", """SELECT row_id, (1-exp(-range_m/20))*(1-exp(-error_m/0.25)) AS pair_confidence,
 (1-exp(-station/5.0::DOUBLE))*(0.3+0.7*error_m)*(0.4+0.6*sigma_m)*(1-exp(-greatest(0, error_m-0.1)/0.3)) AS contact_confidence FROM stations""", rnd="pair_confidence contact_confidence")
def _(t):
    return t.stations.select("row_id", num.pair_confidence(c("range_m"), c("error_m")).alias("pair_confidence"),
                             num.contact_confidence(c("station"), c("error_m"), c("sigma_m"), c("error_m") - 0.1).alias("contact_confidence"))


@query("scl_08_payload_hash", "messages", "SELECT message_id, sha256(props) AS digest FROM messages")
def _(t):
    return t.messages.select("message_id", F.sha2("props", 256).alias("digest"))


@query("scl_09_json_attributes", "messages", "SELECT topic, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM messages GROUP BY 1, 2")
def _(t):
    attrs = F.from_json("props", "struct<k: bigint>")
    return t.messages.groupBy("topic", attrs["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("scl_10_arrays", "", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 1)) AS a FROM embeddings)
SELECT vec_id, len(list_distinct(a)) AS n_distinct, list_contains(a, 0.1::DOUBLE) AS has, list_min(a) AS lo, list_max(a) AS hi FROM e""", rnd="lo hi", ints="n_distinct")
def _(t):
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 1)).alias("a"))
    return e.select("vec_id", F.size(F.array_distinct("a")).alias("n_distinct"), F.array_contains("a", 0.1).alias("has"),
                    F.element_at(F.array_sort("a"), 1).alias("lo"), F.element_at(F.slice(F.array_sort("a"), -1, 1), 1).alias("hi"))


@query("scl_11_time", "messages", """WITH b AS (SELECT source, min(ts_ns) AS first_ns FROM messages GROUP BY source)
SELECT message_id, CAST(m.ts_ns - first_ns AS DOUBLE)/1e6 AS age_ms, CAST(((m.ts_ns - first_ns)*3) // 1000000000 AS BIGINT) AS slot FROM messages m JOIN b USING (source)""", rnd="age_ms")
def _(t):
    m = t.messages
    j = m.join(m.groupBy("source").agg(F.min("ts_ns").alias("first_ns")), "source")
    return j.select("message_id", num.age_ms(c("ts_ns"), c("first_ns")).alias("age_ms"), num.slot_number(c("ts_ns"), c("first_ns"), 3).alias("slot"))


@query("scl_12_safe_numerics", "points", f"""WITH {RAW} SELECT frame, point_idx, coalesce(NOT isnan(x), false) AND abs(x) < CAST('Infinity' AS DOUBLE) AS finite_x, greatest(-1, least(1, y)) AS clipped,
 round_even(y*2, 0) AS nearest FROM raw""", rnd="clipped nearest")
def _(t):
    return raw(t).select("frame", "point_idx", num.is_finite(c("x")).alias("finite_x"), num.clip(c("y"), -1, 1).alias("clipped"), F.rint(c("y") * 2).alias("nearest"))
