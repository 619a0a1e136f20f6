"""Joins in space, along paths and in time."""

from pyspark.sql import functions as F

from ..functions import rotation as rot
from ..functions.numeric import is_finite
from ..functions.vector import norm, vec
from ..operators import joins as jn
from ..operators.aggregates import voxel_centroid, voxel_first
from ..operators.ordered import blocked_scan, islands
from .registry import query

c = F.col
VOX = """vox AS (SELECT frame, min(point_idx) AS point_idx, arg_min(x, point_idx) AS x, arg_min(y, point_idx) AS y, arg_min(z, point_idx) AS z
 FROM points GROUP BY frame, floor(x), floor(y), floor(z))"""


def vox(t):
    return voxel_first(t.points.select("frame", "point_idx", "x", "y", "z"), ["frame"], 1.0, "point_idx").drop("ci", "cj", "ck")


@query("jon_01_with_pose", "points frames", "SELECT p.frame, p.point_idx, f.tx, f.ty FROM points p JOIN frames f ON p.run = f.run AND p.frame = f.frame WHERE pose_status = 'ok'", rnd="tx ty")
def _(t):
    return jn.with_pose(t.points, t.frames).select("frame", "point_idx", "tx", "ty")


@query("jon_04_knn", "points", f"""WITH {VOX}, d AS (SELECT a.frame, a.point_idx, b.point_idx AS near_point_idx, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d,
 row_number() OVER (PARTITION BY a.frame, a.point_idx ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.point_idx) AS nn
 FROM vox a JOIN vox b ON a.frame = b.frame AND a.point_idx <> b.point_idx)
SELECT frame, point_idx, nn, near_point_idx, d FROM d WHERE nn <= 4""", rnd="d", ints="nn")
def _(t):
    return jn.knn(vox(t), ["frame"], "point_idx", 4, 4.0)


CENT = """cent AS (SELECT frame, min(point_idx) AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY frame, floor(x/0.05), floor(y/0.05), floor(z/0.05))"""


@query("jon_05_radius_pairs", "points", f"""WITH {CENT} SELECT a.frame, a.id AS a_id, b.id AS b_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d
FROM cent a JOIN cent b ON a.frame = b.frame AND a.id < b.id AND abs(a.y-b.y) <= 0.5 AND abs(a.x-b.x) <= 0.5 WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.25""", rnd="d")
def _(t):
    return jn.voxel_pairs(t.points, ["frame"], "point_idx", 0.05, 0.5)


@query("jon_06_bounded_nn", "points", f"""WITH {VOX}, n AS (SELECT a.frame, a.point_idx, arg_min(b.point_idx, ((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.point_idx)) AS near_point_idx,
 min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS d FROM vox a JOIN (SELECT frame - 1 AS frame, point_idx, x, y, z FROM vox) b ON a.frame = b.frame
 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 1 GROUP BY a.frame, a.point_idx)
SELECT frame, point_idx, near_point_idx, d FROM vox LEFT JOIN n USING (frame, point_idx)""", rnd="d")
def _(t):
    """Nearest return of the next frame within 1 m."""
    v = vox(t)
    return jn.bounded_nearest(v, v.withColumn("frame", c("frame") - 1), ["frame"], "point_idx", 1.0).select("frame", "point_idx", "near_point_idx", "d")


@query("jon_07_asof_model", "frames", """WITH m AS (SELECT run, generation, frame AS mf, header_time_ns AS mt FROM frames WHERE frame % 7 = 0),
j AS (SELECT f.run, f.generation, f.frame, max(mf) AS mf, arg_max(mt, mf) AS mt, any_value(header_time_ns) AS t FROM frames f LEFT JOIN m ON f.run = m.run AND f.generation = m.generation AND mf <= f.frame GROUP BY 1, 2, 3)
SELECT run, generation, frame, CASE WHEN CAST(t-mt AS DOUBLE)/1e6 <= 400 THEN mf END AS model, CASE WHEN CAST(t-mt AS DOUBLE)/1e6 <= 400 THEN CAST(t-mt AS DOUBLE)/1e6 END AS age_ms FROM j""", rnd="age_ms")
def _(t):
    f = t.frames
    return jn.asof_model(f, f.where(c("frame") % 7 == 0), ["run", "generation"], 400.0)


@query("jon_08_interp_at", "path", """WITH seg AS (SELECT run, k, s, lx, lz, lead(s) OVER w AS s1, lead(lx) OVER w AS lx1, lead(lz) OVER w AS lz1, max(s) OVER (PARTITION BY run) AS hi FROM path WINDOW w AS (PARTITION BY run ORDER BY k)),
q AS (SELECT run, k AS id, k*0.53::DOUBLE - 1 AS a, greatest(0, least(max(s) OVER (PARTITION BY run), k*0.53::DOUBLE - 1)) AS q FROM path)
SELECT q.run, id, a AS at_m, lx+(q-s)/(s1-s)*(lx1-lx) AS lx, lz+(q-s)/(s1-s)*(lz1-lz) AS lz FROM q JOIN seg ON q.run = seg.run AND s1 IS NOT NULL AND q >= s AND (q < s1 OR (q = s1 AND s1 = hi))""", rnd="at_m lx lz")
def _(t):
    p = t.path
    q = p.select("run", c("k").alias("id"), (c("k") * 0.53 - 1).alias("at_m"))
    return jn.interp_at(p, q, ["run"], "s", ["lx", "lz"], "at_m")


@query("jon_09_nearest_segment", "points path", """WITH seg AS (SELECT run, k AS seg, s, lx, ly, lz, lead(s) OVER w AS s1, lead(lx) OVER w AS x1, lead(ly) OVER w AS y1, lead(lz) OVER w AS z1 FROM path WINDOW w AS (PARTITION BY run ORDER BY k)),
g AS (SELECT *, sqrt((x1-lx)*(x1-lx)+(y1-ly)*(y1-ly)+(z1-lz)*(z1-lz)) AS len FROM seg WHERE s1 IS NOT NULL),
t AS (SELECT p.run, p.frame, p.point_idx, seg, s, s1, len, lx, ly, lz, x1, y1, z1, p.x, p.y, p.z, ((p.x-lx)*(x1-lx)+(p.y-ly)*(y1-ly)+(p.z-lz)*(z1-lz))/(len*len) AS t FROM points p JOIN g ON p.run = g.run AND abs(p.y-g.ly) <= 2 WHERE len <= 1 AND s1-s <= 0.8),
d AS (SELECT *, greatest(0, least(1, t)) AS tc FROM t),
e AS (SELECT *, sqrt(power(x-lx-tc*(x1-lx),2)+power(y-ly-tc*(y1-ly),2)+power(z-lz-tc*(z1-lz),2)) AS d, greatest(0, -t, t-1)*len AS excess FROM d),
b AS (SELECT run, frame, point_idx, arg_min({'seg': seg, 'd': d, 'st': s+tc*(s1-s), 'ex': excess}, (d, seg)) AS m FROM e WHERE d <= 0.75 GROUP BY 1, 2, 3)
SELECT run, frame, point_idx, m.seg AS seg, CASE WHEN m.ex <= 0.3 THEN m.d END AS d, CASE WHEN m.ex <= 0.3 THEN m.st END AS station FROM b""", rnd="d station")
def _(t):
    curve = t.path.select("run", "k", "s", c("lx").alias("vx"), c("ly").alias("vy"), c("lz").alias("vz"))
    return jn.nearest_segment(t.points, curve, ["run"], ["frame", "point_idx"], 0.75)


@query("jon_10_section_intersections", "path", """WITH st AS (SELECT a.run, a.k, (a.lx+a.rx)/2 AS x, (a.ly+a.ry)/2 - 0.2 AS y, (a.lz+a.rz)/2 AS z FROM path a),
rl AS (SELECT run, k, s, 'L' AS side, lx AS x, ly AS y, lz AS z FROM path UNION ALL SELECT run, k, s, 'R', rx, ry, rz FROM path),
sg AS (SELECT *, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM rl WINDOW w AS (PARTITION BY run, side ORDER BY k)),
ro AS (SELECT st.run, st.k, side, -(sg.y-st.y) AS u0, -(y1-st.y) AS u1, s, s1, sg.x AS ax, sg.y AS ay, sg.z AS az, x1, y1, z1, st.x AS cx, st.y AS cy, st.z AS cz FROM st JOIN sg ON st.run = sg.run AND s1 IS NOT NULL WHERE (-(sg.y-st.y))*(-(y1-st.y)) <= 0 AND abs(y1-sg.y) > 1e-5),
rp AS (SELECT run, k, side, cx, cy, cz, s + (-u0/(u1-u0))*(s1-s) AS station, ax + (-u0/(u1-u0))*(x1-ax) AS px, ay + (-u0/(u1-u0))*(y1-ay) AS py, az + (-u0/(u1-u0))*(z1-az) AS pz FROM ro),
pr AS (SELECT a.run, a.k, (a.station+b.station)/2 AS station, a.px AS lx, a.pz AS lz, b.px AS rx, b.pz AS rz, sqrt(power((a.px+b.px)/2-a.cx,2)+power((a.py+b.py)/2-a.cy,2)+power((a.pz+b.pz)/2-a.cz,2)) AS dist FROM rp a JOIN rp b ON a.run = b.run AND a.k = b.k AND a.side = 'L' AND b.side = 'R' WHERE abs(a.station-b.station) <= 0.8)
SELECT run, k, station, lx, lz, rx, rz, true AS forward FROM pr WHERE dist < 5""", rnd="station lx lz rx rz")
def _(t):
    from ..operators.paths import section_intersections

    p = t.path
    st = p.select("run", "k", ((c("lx") + c("rx")) / 2).alias("ox"), ((c("ly") + c("ry")) / 2 - 0.2).alias("oy"), ((c("lz") + c("rz")) / 2).alias("oz"),
                                         F.lit(0.0).alias("tgx"), F.lit(-1.0).alias("tgy"), F.lit(0.0).alias("tgz"))
    return section_intersections(st, p, ["run"]).select("run", "k", "station", "lx", "lz", "rx", "rz", "forward")


CHAIN = """vf AS (SELECT *, lag(header_time_ns) OVER w AS pt, lag(tx) OVER w AS px, lag(ty) OVER w AS py, lag(pose_status) OVER w AS ps FROM frames WINDOW w AS (PARTITION BY run ORDER BY frame)),
ve AS (SELECT *, coalesce(pose_status = 'ok' AND ps = 'ok' AND header_time_ns-pt > 0 AND header_time_ns-pt <= 300000000 AND sqrt((tx-px)*(tx-px)+(ty-py)*(ty-py)) <= 5
  AND sqrt((tx-px)*(tx-px)+(ty-py)*(ty-py)) / (CAST(header_time_ns-pt AS DOUBLE)/1e9) <= 50, false) AS edge FROM vf),
ch AS (SELECT *, sum(CASE WHEN edge THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY frame) AS chain FROM ve)"""


@query("jon_11_first_displaced_pose", "frames", f"""WITH {CHAIN}, m AS (SELECT a.run, a.frame, min(b.frame) AS moved_frame, arg_min(CAST(b.header_time_ns-a.header_time_ns AS DOUBLE)/1e6, b.frame) AS latency_ms
 FROM ch a JOIN ch b ON a.run = b.run AND a.chain = b.chain AND b.frame > a.frame AND sqrt((a.tx-b.tx)*(a.tx-b.tx)+(a.ty-b.ty)*(a.ty-b.ty)) >= 2.2 GROUP BY 1, 2)
SELECT ch.run, CAST(chain AS BIGINT) AS chain, ch.frame, moved_frame, latency_ms, CASE WHEN moved_frame IS NULL THEN 'no_displacement_in_chain' ELSE '' END AS reason FROM ch LEFT JOIN m ON ch.run = m.run AND ch.frame = m.frame""", rnd="latency_ms")
def _(t):
    from ..operators.windows import chains

    return jn.first_displaced(chains(t.frames, ["run"]), ["run", "chain"], 2.2, step=2)


@query("jon_12_direction_pose", "frames", "SELECT f.frame, g.frame AS direction_frame, g.tx, g.ty FROM frames f LEFT JOIN frames g ON g.run = f.run AND g.frame = f.frame+1 AND g.generation = f.generation", rnd="tx ty")
def _(t):
    f = t.frames
    g = f.select("run", "generation", (c("frame") - 1).alias("frame"), c("frame").alias("direction_frame"), "tx", "ty")
    return f.select("run", "generation", "frame").join(g, ["run", "generation", "frame"], "left").select("frame", "direction_frame", "tx", "ty")


@query("jon_13_support", "points", "SELECT frame, point_idx, slot % 4 = 0 AS supported FROM points")
def _(t):
    p, k = t.points.select("frame", "point_idx", "slot"), ["frame", "point_idx"]
    sup = p.where(c("slot") % 4 == 0).select(*k)
    semi = p.join(sup, k, "left_semi").withColumn("supported", F.lit(True))
    anti = p.join(sup, k, "left_anti").withColumn("supported", F.lit(False))
    return semi.unionByName(anti).drop("slot")


@query("jon_14_match_payload", "messages", """WITH s AS (SELECT *, props || '|' || CAST(message_id AS VARCHAR) AS data FROM messages),
r AS (SELECT CASE WHEN message_id % 101 = 0 THEN message_id - 150 ELSE message_id END AS seq, message_id, source FROM s WHERE message_id % 9 <> 0),
o AS (SELECT source, message_id <= lag(message_id) OVER (PARTITION BY source ORDER BY seq, message_id) AS late FROM r),
v AS (SELECT source, count(*) FILTER (late) AS order_breaks, count(*) AS matched FROM o GROUP BY 1), m AS (SELECT source, count(*) FILTER (message_id % 9 = 0) AS missing FROM s GROUP BY 1)
SELECT source, coalesce(matched, 0) AS matched, missing, coalesce(order_breaks, 0) AS order_breaks FROM m LEFT JOIN v USING (source)""")
def _(t):
    s = t.messages.withColumn("digest", F.sha2(F.concat_ws("|", "props", c("message_id").cast("string")), 256))
    seq = F.when(c("message_id") % 101 == 0, c("message_id") - 150).otherwise(c("message_id"))
    r = s.where(c("message_id") % 9 != 0).select("digest", seq.alias("seq"), "source")
    src = s.select("digest", "message_id", c("source").alias("src"))
    hit = r.join(src.drop("src"), "digest")
    order = blocked_scan(hit, ["source"], "seq", {"before": ("lag", c("message_id"))}, ties=["message_id"])
    v = order.groupBy("source").agg(F.count_if(c("message_id") <= c("before")).alias("order_breaks"), F.count(F.lit(1)).alias("matched"))
    missing = src.join(r, "digest", "left_anti").groupBy(c("src").alias("source")).agg(F.count(F.lit(1)).alias("missing"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    everyone = src.select(c("src").alias("source")).distinct()
    return everyone.join(v, "source", "left").join(missing, "source", "left").select("source", zero("matched"), zero("missing"), zero("order_breaks"))


@query("jon_15_paired_methods", "stations", """WITH a AS (SELECT * FROM stations WHERE method = 'A' AND evaluable), b AS (SELECT * FROM stations WHERE method = 'B' AND evaluable)
SELECT coalesce(a.run, b.run) AS run, coalesce(a.frame, b.frame) AS frame, coalesce(a.station, b.station) AS station, a.error_m AS error_a, b.error_m AS error_b, a.run IS NOT NULL AND b.run IS NOT NULL AS paired
FROM a FULL OUTER JOIN b ON a.run = b.run AND a.frame = b.frame AND a.station = b.station""", rnd="error_a error_b")
def _(t):
    s = t.stations.where("evaluable")
    k = ["run", "frame", "station"]
    a = s.where("method = 'A'").select(*k, c("error_m").alias("error_a"))
    b = s.where("method = 'B'").select(*k, c("error_m").alias("error_b"))
    return a.join(b, k, "full_outer").withColumn("paired", c("error_a").isNotNull() & c("error_b").isNotNull())


COMP = "comp AS (SELECT run, 0 AS generation, frame, ring, frame*10+ring AS id, CAST(frame AS DOUBLE)/10 AS t_s, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY run, frame, ring, floor(x), floor(y), floor(z))"


@query("jon_16_match_components", "points", f"""WITH {COMP}, pr AS (SELECT a.run, a.id AS component, b.id AS track, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d
 FROM comp a JOIN comp b ON a.run = b.run AND a.frame > b.frame AND a.t_s-b.t_s BETWEEN 0 AND 3),
na AS (SELECT run, component, track, ax, ay, az, min(d) AS d FROM pr GROUP BY ALL), nb AS (SELECT run, component, track, bx, by_, bz, min(d) AS d FROM pr GROUP BY ALL),
fa AS (SELECT run, component, track, avg(CASE WHEN d <= 1.5 THEN 1.0::DOUBLE ELSE 0 END) AS f, quantile_cont(d, 0.5) AS m FROM na GROUP BY ALL), fb AS (SELECT run, component, track, avg(CASE WHEN d <= 1.5 THEN 1.0::DOUBLE ELSE 0 END) AS f, quantile_cont(d, 0.5) AS m FROM nb GROUP BY ALL)
SELECT run, component, track, greatest(fa.f, fb.f) AS fraction, least(fa.m, fb.m) + (1-greatest(fa.f, fb.f))*0.1 AS score FROM fa JOIN fb USING (run, component, track) WHERE greatest(fa.f, fb.f) >= 0.2""", rnd="fraction score")
def _(t):
    """Components per (frame, ring) against all those of the 3 s before; 1.5 m suits the sparse cloud."""
    v = voxel_centroid(t.points, ["run", "frame", "ring"], 1.0, out=("x", "y", "z")).withColumns({
        "generation": F.lit(0), "id": c("frame") * 10 + c("ring"), "t_s": c("frame").cast("double") / 10})
    out = jn.match_components(v, v, radius=1.5).where(F.floor(c("component") / 10) > F.floor(c("track") / 10))
    return out.select("run", "component", "track", "fraction", "score")


TRES = """off AS (SELECT i*0.02::DOUBLE AS ov, j*0.02::DOUBLE AS ow FROM generate_series(-2, 2) a(i), generate_series(-2, 2) b(j)),
pt AS (SELECT run, point_idx, x AS v, z AS w FROM points),
rs AS (SELECT run, point_idx, ov, ow, least(0.05, min(sqrt(power(p.v-ov-t.v,2)+power(p.w-ow-t.w,2)))) AS d FROM pt p, off, (SELECT DISTINCT v, w FROM template) t GROUP BY run, point_idx, ov, ow)"""


@query("jon_17_template_residual", "points template", f"WITH {TRES} SELECT run, ov, ow, count(*) AS n, avg(d) AS residual, avg(CASE WHEN d < 0.02 THEN 1.0::DOUBLE ELSE 0 END) AS support FROM rs GROUP BY run, ov, ow", rnd="ov ow residual support")
def _(t):
    p = t.points.select("run", "point_idx", c("x").alias("v"), c("z").alias("w")).distinct()
    rows = jn.shifted(p, jn.offset_grid(t.spark, 0.04, 0.02))
    d = jn.template_distance(rows, t.template, ["run", "point_idx", "ov", "ow"])
    return d.groupBy("run", "ov", "ow").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("residual"), F.avg((c("d") < 0.02).cast("double")).alias("support"))


@query("jon_18_agreement", "path", """WITH g AS (SELECT run, i/2.0::DOUBLE AS g FROM (SELECT DISTINCT run FROM path WHERE run + 1 IN (SELECT run FROM path)) r, generate_series(4, 16) q(i)),
seg AS (SELECT run, k, s, lx, lz, rx, rz, lead(s) OVER w AS s1, lead(lx) OVER w AS lx1, lead(lz) OVER w AS lz1, lead(rx) OVER w AS rx1, lead(rz) OVER w AS rz1 FROM path WINDOW w AS (PARTITION BY run ORDER BY k)),
v AS (SELECT g.run AS base, seg.run, g, lx+(g-s)/(s1-s)*(lx1-lx) AS lx, lz+(g-s)/(s1-s)*(lz1-lz) AS lz, rx+(g-s)/(s1-s)*(rx1-rx) AS rx, rz+(g-s)/(s1-s)*(rz1-rz) AS rz FROM g JOIN seg ON seg.run IN (g.run, g.run+1) AND s1 IS NOT NULL AND g >= s AND g < s1),
d AS (SELECT a.base, a.g, abs(a.lx-b.lx) AS dl, abs(a.rx-b.rx) AS dr, abs(a.lz-b.lz+0.0) AS zl, abs(a.rz-b.rz+0.0) AS zr FROM v a JOIN v b ON a.base = b.base AND a.g = b.g AND a.run = a.base AND b.run = b.base+1),
f AS (SELECT base, dl AS dx, zl AS dz FROM d UNION ALL SELECT base, dr, zr FROM d)
SELECT base AS run, quantile_cont(dx, 0.9) AS lateral_p90, quantile_cont(dz, 0.9) AS vertical_p90, quantile_cont(dx, 0.9) <= 0.02 AND quantile_cont(dz, 0.9) <= 0.03 AS accepted FROM f GROUP BY base""", rnd="lateral_p90 vertical_p90")
def _(t):
    """Each run's path against the next run's."""
    p = t.path
    out = jn.agreement(p, p.withColumn("run", c("run") - 1), ["run"], lateral=0.02)
    return out.select("run", "lateral_p90", "vertical_p90", "accepted")


@query("jon_19_transverse_error", "points path", """WITH st AS (SELECT run, k, (lx+rx)/2 AS sx, (ly+ry)/2 AS sy, (lz+rz)/2 AS sz, lead((lx+rx)/2) OVER w - (lx+rx)/2 AS dx, lead((ly+ry)/2) OVER w - (ly+ry)/2 AS dy, lead((lz+rz)/2) OVER w - (lz+rz)/2 AS dz FROM path WINDOW w AS (PARTITION BY run ORDER BY k)),
s AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS l FROM st WHERE dx IS NOT NULL),
d AS (SELECT p.run, p.frame, p.point_idx, k, (p.x-sx)*(p.x-sx)+(p.y-sy)*(p.y-sy)+(p.z-sz)*(p.z-sz) AS d2, ((p.x-sx)*dx+(p.y-sy)*dy+(p.z-sz)*dz)/l AS ax FROM points p JOIN s ON p.run = s.run AND abs(p.y-s.sy) <= 1 WHERE (p.x-sx)*(p.x-sx)+(p.y-sy)*(p.y-sy)+(p.z-sz)*(p.z-sz) <= 1),
b AS (SELECT run, frame, point_idx, arg_min({'d2': d2, 'ax': ax, 'k': k}, (d2, k)) AS m FROM d GROUP BY 1, 2, 3)
SELECT run, frame, point_idx, m.k AS k, abs(m.ax) AS axial, sqrt(greatest(0, m.d2-m.ax*m.ax)) AS transverse FROM b""", rnd="axial transverse")
def _(t):
    from ..operators.envelope import path_segments

    seg = path_segments(t.path).select("run", "k", c("cx").alias("x"), c("cy").alias("y"), c("cz").alias("z"), "fx", "fy", "fz", *[c("c" + a).alias("s" + a) for a in "xyz"])
    p = t.points.select("run", "frame", "point_idx", "x", "y", "z")
    near = [*["s" + a for a in "xyz"], "fx", "fy", "fz"]
    j = jn.bounded_nearest(p, seg, ["run"], "k", 1.0, left_ids=["frame", "point_idx"], carry=near, inner=True).withColumnsRenamed({"near_" + n: n for n in ["k", *near]})
    ax = sum(((c(a) - c("s" + a)) * c("f" + a) for a in "yz"), (c("x") - c("sx")) * c("fx"))
    j = j.withColumn("ax", ax)
    return j.select("run", "frame", "point_idx", "k", F.abs("ax").alias("axial"), F.sqrt(F.greatest(F.lit(0.0), c("d") * c("d") - c("ax") * c("ax"))).alias("transverse"))


@query("jon_20_assign_stations", "points path", """WITH seg AS (SELECT run, k AS seg, s, lx, ly, lz, lead(s) OVER w AS s1, lead(lx) OVER w AS x1, lead(ly) OVER w AS y1, lead(lz) OVER w AS z1 FROM path WINDOW w AS (PARTITION BY run ORDER BY k)),
g AS (SELECT *, power(x1-lx,2)+power(y1-ly,2)+power(z1-lz,2) AS l2 FROM seg WHERE s1 IS NOT NULL),
t AS (SELECT p.run, p.frame, p.point_idx, -p.y AS init, seg, s, s1, p.x, p.y, p.z, lx, ly, lz, x1, y1, z1, greatest(0, least(1, ((p.x-lx)*(x1-lx)+(p.y-ly)*(y1-ly)+(p.z-lz)*(z1-lz))/l2)) AS tc FROM points p JOIN g ON p.run = g.run AND abs(p.y-g.ly) <= 2),
d AS (SELECT *, s+tc*(s1-s) AS st, sqrt(power(x-lx-tc*(x1-lx),2)+power(y-ly-tc*(y1-ly),2)+power(z-lz-tc*(z1-lz),2)) AS d FROM t),
b AS (SELECT run, frame, point_idx, any_value(init) AS init, arg_min(st, (CASE WHEN abs(st-init) > 8 THEN 1 ELSE 0 END, d, seg)) AS st FROM d WHERE d <= 0.75 GROUP BY 1, 2, 3)
SELECT run, frame, point_idx, max(st) OVER (PARTITION BY frame ORDER BY init, point_idx ROWS UNBOUNDED PRECEDING) AS station FROM b""", rnd="station")
def _(t):
    from ..operators.paths import assign_stations

    curve = t.path.select("run", "k", "s", c("lx").alias("vx"), c("ly").alias("vy"), c("lz").alias("vz"))
    p = t.points.withColumn("init", -c("y"))
    return assign_stations(p, curve, ["run"], "frame", "point_idx", "init", 0.75).select("run", "frame", "point_idx", "station")
