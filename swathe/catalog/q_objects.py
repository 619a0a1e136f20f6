"""Components, groups and the views built on them."""

from pyspark.sql import functions as F

from ..operators import envelope as env
from ..operators import graph
from ..operators import joins as jn
from ..operators.graph import connected_components
from ..plans import objects as ob
from .registry import query
from .sql import HITS, SEGMENTS

c = F.col

# Components of envelope hits per run: voxels of 1 m, linked within 1.5 m, labelled by their least id.
COMPONENTS = HITS + """,
hp AS (SELECT run, frame*10000000000000000 + point_idx AS id, frame, x, y, z FROM (SELECT run, CAST(frame AS HUGEINT) AS frame, point_idx, x, y, z FROM hits) q),
hv AS (SELECT run, frame, floor(x) AS i, floor(y) AS j, floor(z) AS k, min(id) AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM hp GROUP BY ALL),
ed AS (SELECT a.id AS u, b.id AS v FROM hv a JOIN hv b ON a.frame = b.frame AND a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 2.25),
rc AS (SELECT id AS n, id AS root FROM hv UNION SELECT e.v, rc.root FROM rc JOIN ed e ON e.u = rc.n),
cm AS (SELECT n AS id, min(root) AS component FROM rc GROUP BY n)"""
MEMBERS = COMPONENTS + """,
mb AS (SELECT hp.run, CAST(hp.frame AS INTEGER) AS frame, hp.id, cm.component, hp.x, hp.y, hp.z, hv.id AS vid FROM hp JOIN hv ON hv.frame = hp.frame AND hv.i = floor(hp.x) AND hv.j = floor(hp.y) AND hv.k = floor(hp.z) JOIN cm ON cm.id = hv.id),
sz AS (SELECT component, count(*) AS points, count(DISTINCT vid) AS voxels FROM mb GROUP BY component HAVING count(*) >= 3 AND count(DISTINCT vid) >= 2)"""


def components(t):
    h = env.envelope_hits(t.points, env.path_segments(t.path))
    # Frame and row together outgrow 64 bits here, so the id is their padded text; it sorts the same way.
    h = h.withColumn("gid", F.concat(F.lpad(c("frame").cast("string"), 8, "0"), F.lpad(c("point_idx").cast("string"), 16, "0")))
    return ob.cluster_components(h.select("run", "frame", "gid", "x", "y", "z"), ["run", "frame"], "gid", voxel=1.0, radius=1.5)


@query("agg_03_cluster_components", "points path", f"WITH RECURSIVE {MEMBERS} SELECT any_value(frame) AS frame, lpad(CAST(sz.component // 10000000000000000 AS VARCHAR), 8, '0') || lpad(CAST(sz.component % 10000000000000000 AS VARCHAR), 16, '0') AS component, any_value(points) AS points, any_value(voxels) AS voxels FROM mb JOIN sz USING (component) GROUP BY sz.component", ints="points voxels")
def _(t):
    return components(t).select("frame", "component", "points", "voxels").distinct()


@query("agg_04_component_measures", "points path", f"""WITH RECURSIVE {MEMBERS}, ct AS (SELECT mb.run, component, median(x) AS mx, median(y) AS my, median(z) AS mz, count(*) AS count, min(sqrt(x*x+y*y+z*z)) AS nearest_m FROM mb JOIN sz USING (component) GROUP BY ALL),
nr AS (SELECT ct.run, component, arg_min(s, (power(mx-s.cx,2)+power(my-s.cy,2)+power(mz-s.cz,2), s.k)) AS s FROM ct JOIN seg s ON s.run = ct.run GROUP BY ALL),
pr AS (SELECT component, (x-s.cx)*s.qx+(y-s.cy)*s.qy+(z-s.cz)*s.qz AS lat, (x-s.cx)*s.fx+(y-s.cy)*s.fy+(z-s.cz)*s.fz AS dep, (x-s.cx)*s.ux+(y-s.cy)*s.uy+(z-s.cz)*s.uz AS hei FROM mb JOIN nr USING (component)),
ms AS (SELECT component, max(lat)-min(lat) AS width_m, max(dep)-min(dep) AS depth_m, max(hei)-min(hei) AS height_m FROM pr GROUP BY component)
SELECT lpad(CAST(component // 10000000000000000 AS VARCHAR), 8, '0') || lpad(CAST(component % 10000000000000000 AS VARCHAR), 16, '0') AS component, mx, my, mz, count, nearest_m, width_m, depth_m, height_m, width_m*height_m AS bbox_m2 FROM ct JOIN ms USING (component)""", rnd="mx my mz nearest_m width_m depth_m height_m bbox_m2")
def _(t):
    m = components(t)
    out = ob.component_measures(m, env.path_segments(t.path).where(~c("invalid")), ["run"])
    return out.select("component", "mx", "my", "mz", "count", "nearest_m", "width_m", "depth_m", "height_m", "bbox_m2")


@query("agg_05_hull_area", "points")
def _(t):
    out = ob.hull_area(t.points, ["frame"], "x", "z", chunk=128)
    return out.select("frame", F.round("hull_m2", 6).alias("hull_m2"))


OBS_EDGES = """e AS (SELECT a.obs_id AS u, b.obs_id AS v FROM obs a JOIN obs b ON a.generation = b.generation AND a.obs_id <> b.obs_id AND (a.wx-b.wx)*(a.wx-b.wx)+(a.wy-b.wy)*(a.wy-b.wy)+(a.wz-b.wz)*(a.wz-b.wz) <= 100)"""


@query("itr_01_connected_components", "obs", f"WITH RECURSIVE {OBS_EDGES}, r AS (SELECT obs_id AS n, obs_id AS root FROM obs UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.n) SELECT n AS obs_id, min(root) AS component FROM r GROUP BY n")
def _(t):
    o = t.obs.select("generation", c("obs_id").alias("id"), c("wx").alias("x"), c("wy").alias("y"), c("wz").alias("z"))
    return connected_components(o, jn.radius_pairs(o, ["generation"], ["id"], 10.0)).withColumnRenamed("id", "obs_id")


GREEDY = """od AS (SELECT *, row_number() OVER (ORDER BY source_frame, track_id, obs_id) AS n FROM obs),
pr AS (SELECT a.n AS a, b.n AS b FROM od a JOIN od b ON a.generation = b.generation AND b.n < a.n AND (a.wx-b.wx)*(a.wx-b.wx)+(a.wy-b.wy)*(a.wy-b.wy)+(a.wz-b.wz)*(a.wz-b.wz) <= 100),
nb AS (SELECT od.n, coalesce(list(pr.b) FILTER (pr.b IS NOT NULL), []) AS bs FROM od LEFT JOIN pr ON pr.a = od.n GROUP BY od.n),
gr AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT gr.n+1, CASE WHEN len(list_intersect(nb.bs, gr.kept)) = 0 THEN list_append(gr.kept, nb.n) ELSE gr.kept END FROM gr JOIN nb ON nb.n = gr.n+1),
kp AS (SELECT unnest(kept) AS n FROM gr WHERE n = (SELECT max(n) FROM od)),
an AS (SELECT od.*, row_number() OVER (ORDER BY od.n) AS group_id FROM od JOIN kp ON kp.n = od.n)"""
GROUPS = GREEDY + """,
ma AS (SELECT o.n, arg_min(an.group_id, (sqrt(power(o.wx-an.wx,2)+power(o.wy-an.wy,2)+power(o.wz-an.wz,2)), an.group_id)) AS group_id FROM od o JOIN an ON an.generation = o.generation AND an.n <= o.n AND (o.wx-an.wx)*(o.wx-an.wx)+(o.wy-an.wy)*(o.wy-an.wy)+(o.wz-an.wz)*(o.wz-an.wz) <= 100 GROUP BY o.n),
gp AS (SELECT group_id, generation, count(DISTINCT source_frame) AS frames, min(source_frame) AS first_frame, max(source_frame) AS last_frame, count(*) AS observations, array_to_string(list_sort(list_distinct(list(track_id))), '+') AS members,
 arg_min(obs_id, (-voxel_count, -point_count, source_frame, track_id, obs_id)) AS size_obs, CASE WHEN count(DISTINCT source_frame) >= 2 THEN 'CONFIRMED' ELSE 'SINGLE_FRAME' END AS status FROM od JOIN ma USING (n) GROUP BY group_id, generation)"""


@query("itr_02_greedy_select", "obs", f"WITH RECURSIVE {GREEDY} SELECT obs_id, generation, source_frame FROM an")
def _(t):
    p = t.obs.withColumnsRenamed({"wx": "x", "wy": "y", "wz": "z"})
    out = graph.greedy_select(p, ["generation"], ["source_frame", "track_id", "obs_id"], 10.0)
    return out.select("obs_id", "generation", "source_frame")


@query("itr_03_group_objects", "obs", f"WITH RECURSIVE {GROUPS} SELECT * FROM gp", ints="group_id frames observations first_frame last_frame size_obs")
def _(t):
    g = ob.group_objects(t.obs)[1]
    return g.withColumn("members", F.concat_ws("+", "members"))


def as_of(t, through):
    return ob.group_objects(t.obs.where(c("source_frame") <= through))


@query("str_08_as_of_view", "obs", "WITH RECURSIVE " + GROUPS.replace("FROM obs)", "FROM obs WHERE source_frame <= 25)") + " SELECT group_id, generation, frames, status FROM gp", ints="group_id frames")
def _(t):
    """Groups as they stood when frame 25 was the last published one."""
    return as_of(t, 25)[1].select("group_id", "generation", "frames", "status")


@query("str_07_current_assessment", "obs", "WITH RECURSIVE " + GROUPS.replace("FROM obs)", "FROM obs WHERE source_frame <= 40)") + """,
cur AS (SELECT generation, count(DISTINCT gp.group_id) AS objects FROM od JOIN ma USING (n) JOIN gp USING (group_id, generation) WHERE source_frame = 40 AND status = 'CONFIRMED' GROUP BY generation),
gens AS (SELECT DISTINCT generation FROM obs)
SELECT generation, coalesce(objects, 0) AS objects, generation <> 2 AS assessment_available, CASE WHEN generation <> 2 THEN coalesce(objects, 0) > 0 END AS obstacle_detected FROM gens LEFT JOIN cur USING (generation)""", ints="objects")
def _(t):
    """Only confirmed groups seen in the published frame; generation 2 has gone stale."""
    from ..plans.status import current_assessment

    member, groups = as_of(t, 40)
    published = t.obs.select("generation").distinct().withColumns({
        "source_frame": F.lit(40), "age_ms": F.when(c("generation") == 2, 1500.0).otherwise(300.0), "snapshot_frame": F.lit(41)})
    out = current_assessment(published, member, groups, ["generation"])
    return out.select("generation", "objects", "assessment_available", "obstacle_detected")


@query("snk_01_object_csv", "obs", f"WITH RECURSIVE {GROUPS} SELECT CAST(group_id AS VARCHAR) AS id, status, members, CAST(first_frame AS VARCHAR) AS first_frame FROM gp")
def _(t):
    """Objects written as CSV and read back as text."""
    from ..sources.sinks import write_object_csv

    return write_object_csv(ob.group_objects(t.obs)[1], ["group_id", "status", "members", "first_frame"]).withColumnRenamed("group_id", "id")


@query("snk_02_object_json", "obs", f"WITH RECURSIVE {GROUPS} SELECT group_id, status, observations FROM gp", ints="group_id observations")
def _(t):
    from ..sources.sinks import write_object_json

    member, groups = ob.group_objects(t.obs)
    return write_object_json(member, groups).select("group_id", "status", F.size("observations").alias("observations"))
