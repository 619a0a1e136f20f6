"""Findings of the fourth review: results at size, and what rounds, files and pairs cost."""

from pyspark.sql import functions as F

c = F.col


def test_a_point_off_a_shared_vertex_takes_the_segment_of_the_sql(spark):
    """both segments are as far but for the last bit, which came from another order of the same sums."""
    from swathe.operators.joins import nearest_segment

    b = 0.0001 * 3
    curve = spark.createDataFrame([(0, k, k * 0.5, -0.792 + k * k * b, k * -0.5, k * 0.001) for k in range(60, 70)], "run int, k int, s double, vx double, vy double, vz double")
    point = spark.createDataFrame([(0, 1, 242 / 100 + 1 - 3, -32.0, 171 / 100 - 1)], "run int, id long, x double, y double, z double")
    r = nearest_segment(point, curve, ["run"], ["id"], 0.75).first()
    assert (r["seg"], round(r["d"], 6), round(r["station"], 6)) == (64, 0.646218, 32.0)


def test_a_march_is_a_few_jobs_however_many_rounds(spark):
    """every round of every branch was six tables written and read; batches and odd rows change nothing."""
    import random

    from swathe.plans import march as ma

    from .test_march import found, frames, rail, search

    rng = random.Random(21)
    scenes = {0: rail(rng, 8, 34, 260, lambda u: (0.0003 * u * u, 0.001 * u)), 1: rail(rng, 8, 16, 60) + rail(rng, 16, 28, 90, lambda u: (0.06, 0.0)), 2: [(50.0, 0.0, 0.0, 0)]}
    points, starts, template = frames(spark, scenes)
    nan = float("nan")
    odd = [(0, 900, 1, nan, 0.0, 0.0), (0, 901, 1, None, 0.0, 0.0), (0, 902, 1, 12.0, nan, 0.0), (1, 903, 1, 20.0, 0.0, None), (None, 904, 1, 12.0, 0.0, 0.0), (7, 905, 1, 12.0, 0.0, 0.0), (0, 906, 0, float("inf"), 0.0, 0.0)]
    points = points.unionByName(spark.createDataFrame(odd, points.schema)).unionByName(points.where("run = 1 and id = 0"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.sparkContext.setJobGroup("march", "march")
    try:
        out = ma.march_corridor(points, starts, template, ["run"])
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("march")
        got = found(out)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {run: search(rows) for run, rows in scenes.items()} and len(got[0][0]) > 4
    assert len(jobs) < 15


def test_ranges_of_many_small_files_share_tasks(spark, tmp_path, monkeypatch):
    """every range was a task, so a small file cost one or more."""
    import numpy as np

    from swathe.sources import point_files as pf

    monkeypatch.setattr(pf, "TASKS", 6, raising=False)
    xyz = np.round(np.random.default_rng(3).uniform(-50, 50, (90, 3)), 3)
    for i in range(9):
        (tmp_path / f"{i}.las").write_bytes(pf.build_las(xyz[: 10 * i]))
    got = pf.read_point_ranges(spark, str(tmp_path), 20)
    assert got.rdd.getNumPartitions() == 6
    rows = sorted((r["path"][-5], r["point_row"], round(r["x"], 3), round(r["z"], 3)) for r in got.collect())
    assert rows == sorted((str(i), j, float(xyz[j, 0]), float(xyz[j, 2])) for i in range(9) for j in range(10 * i))
    monkeypatch.setattr(pf, "RANGE", 40)
    assert pf.read_point_ranges(spark, str(tmp_path), 20).rdd.getNumPartitions() == 9  # 360 records


def nearby(rows, k):
    """Per (frame, id) its k nearest others by (d2, id), by brute force."""
    off = lambda a, b: sum((p - q) * (p - q) for p, q in zip(a[2:], b[2:]))
    return {a[:2]: sorted((off(a, b), b[1], *b[2:]) for b in rows if b[0] == a[0] and b[1] != a[1])[:k] for a in rows}


def test_neighbours_are_lists_in_rows(spark):
    """Rows were copied eight times, and pairs shuffled for their rank, for their places and for their sums."""
    import numpy as np

    from swathe.catalog import all_queries
    from swathe.operators import aggregates as agg
    from swathe.operators import joins as jn

    from .conftest import SMALL
    from .test_growth import cloud

    _, rows = cloud(spark, 150)
    rows += [(5, 900, 0.0, 0.0, 0.0), (5, 901, 30.0, 0.0, 0.0), (6, 902, 1.0, 1.0, 1.0)]  # found by the last search; alone
    odd = [(0, 903, float("nan"), 0.0, 0.0), (0, 904, None, 0.0, 0.0), (None, 905, 0.0, 0.0, 0.0), (0, 906, float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "frame int, id long, x double, y double, z double")
    want = nearby(rows, 5)
    got = {}
    for r in jn.knn(df, ["frame"], "id", 5, 1.5).orderBy("frame", "id", "nn").collect():
        got.setdefault((r["frame"], r["id"]), []).append((r["nn"], r["near_id"], round(r["d"], 9)))
    assert got == {a: [(i + 1, m[1], round(m[0] ** 0.5, 9)) for i, m in enumerate(near)] for a, near in want.items() if near}
    lists = jn.knn_lists(df, ["frame"], "id", 5, 1.5, lambda near: {"s": agg.list_covariance(near)})
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    for r in lists.where("s.n > 1").collect():
        near = np.array([m[2:] for m in want[r["frame"], r["id"]]])
        c_ = np.cov(near.T, bias=True) * len(near)
        assert r["s"]["n"] == len(near) and np.allclose([r["s"]["sxx"], r["s"]["sxy"], r["s"]["syz"], r["s"]["szz"]], [c_[0, 0], c_[0, 1], c_[1, 2], c_[2, 2]], atol=1e-9)
    plan = all_queries()[0]["agg_15_local_pca"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_nearest_rows_are_found_without_a_join(spark):
    """left rows were copied eight times and joined, grouped and joined again."""
    from swathe.operators import joins as jn

    from .test_growth import cloud

    df, rows = cloud(spark, 120)
    nan = float("nan")
    odd = [(0, 903, nan, 0.0, 0.0), (0, 904, None, 0.0, 0.0), (None, 905, 0.0, 0.0, 0.0)]
    other = [(f, i + 1, x + 0.5, y, z) for f, i, x, y, z in rows if i % 3]
    left = df.unionByName(spark.createDataFrame(odd, df.schema))
    right = spark.createDataFrame(other + odd, df.schema).withColumn("w", c("id") * 2)
    near = jn.bounded_nearest(left, right, ["frame"], "id", 2.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    off = lambda a, b: sum((p - q) * (p - q) for p, q in zip(a[2:], b[2:]))
    want = {a[1]: min(((off(a, b), b[1]) for b in other if b[0] == a[0] and off(a, b) <= 4), default=(None, None)) for a in rows} | {i: (None, None) for i in (903, 904, 905)}
    got = {r["id"]: (r["near_id"], r["d"] if r["d"] is None else round(r["d"], 9)) for r in near.collect()}
    assert near.count() == len(want) and got == {i: (m, d if d is None else round(d ** 0.5, 9)) for i, (d, m) in want.items()}
    inner = jn.bounded_nearest(left, right, ["frame"], "id", 2.0, carry=["w"], inner=True).collect()
    assert {r["id"]: (r["near_id"], r["near_w"], r["x"]) for r in inner} == {a[1]: (want[a[1]][1], 2 * want[a[1]][1], a[2]) for a in rows if want[a[1]][1] is not None}
    assert jn.bounded_nearest(left, right.where("false"), ["frame"], "id", 2.0, inner=True).isEmpty()


def test_alignment_is_a_few_jobs_and_equals_plain_steps(spark, monkeypatch):
    """every round joined all points with 27 copies of their targets, and wrote the poses."""
    import numpy as np

    from swathe.functions import rotation as rot
    from swathe.plans import fit

    from .test_recovery import GATE, nearest, room, turn

    rng, rounds = np.random.default_rng(5), 6
    source, target, start, want = [], [], [], {}
    for frame in range(3):
        q, n = room(rng, 200)
        move = turn(np.array([0.002, -0.003, 0.006])), np.array([0.12, -0.08, 0.03])
        s = (q - move[1]) @ move[0] + rng.normal(0, 0.01, q.shape)
        source += [(frame, i, *map(float, p)) for i, p in enumerate(s)]
        target += [(frame, *map(float, (*p, *m))) for p, m in zip(q, n)]
        for seed, dx in ((0, 0.0), (1, 0.2)):
            start.append((frame, seed, *map(float, np.eye(3).ravel()), dx, 0.0, 0.0))
            r, t = np.eye(3), np.array([dx, 0.0, 0.0])
            for i in range(rounds):
                p = s @ r.T + t
                d, j = nearest(p, q)
                keep = d < max(GATE[1], GATE[0] * (1 - i / rounds))
                p, m = p[keep], n[j[keep]]
                res = np.einsum("ij,ij->i", p - q[j[keep]], m)
                w, a = np.minimum(1, 0.1 / np.maximum(np.abs(res), 1e-10)), np.hstack([np.cross(p, m), m])
                x = fit.solutions(((a * w[:, None]).T @ a)[None], (-(a * w[:, None]).T @ res)[None], 1e-6)[0][0]
                r, t = turn(x[:3]) @ r, turn(x[:3]) @ t + x[3:]
                if np.linalg.norm(x[:3]) < 2e-5 and np.linalg.norm(x[3:]) < 8e-4:
                    break
            d, _ = nearest(s @ r.T + t, q)
            want[frame, seed] = r, t, float((d < 0.5).mean())
    source.append((8, 0, 0.0, 0.0, 0.0))  # no target
    start.append((8, 0, *map(float, np.eye(3).ravel()), 0.0, 0.0, 0.0))
    numbers = ", ".join(f"{n} double" for n in rot.POSE)
    frames = (spark.createDataFrame(source, "frame int, sid int, x double, y double, z double"), spark.createDataFrame(target, "frame int, x double, y double, z double, nx double, ny double, nz double"),
              spark.createDataFrame(start, f"frame int, seed int, {numbers}"))
    for least in (20_000, 10):
        monkeypatch.setattr(fit, "ROWS", least, raising=False)
        spark.sparkContext.setJobGroup(f"align{least}", "align")
        got = {(x["frame"], x["seed"]): x for x in fit.align_clouds(*frames, ["frame"], ["seed"], rounds=rounds).collect()}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"align{least}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got.keys() == want.keys() and len(jobs) < 10
        for k, (r, t, overlap) in want.items():
            assert np.abs(np.array([got[k][n] for n in rot.R_NAMES]).reshape(3, 3) - r).max() < 1e-9 and abs(got[k]["overlap"] - overlap) < 1e-12
            assert np.abs(np.array([got[k]["t" + a] for a in "xyz"]) - t).max() < 1e-9 and got[k]["rmse_plane_m"] < 0.05


def test_components_are_matched_inside_stretches_of_time(spark, monkeypatch):
    """pairs of voxels were shuffled for each side, and all pairs of voxels of the open pairs of components."""
    import math
    import random
    from statistics import median

    from swathe.operators import joins as jn
    from swathe.operators import support

    rng = random.Random(4)
    rows = []
    for run in (0, 1):
        for frame in range(60):  # 30 s, over several stretches of 4 s
            for part in range(2):
                at = rng.uniform(0, 6)
                rows += [(run, 0, frame / 2, f"{run}-{frame}-{part}", round(at + rng.uniform(0, 3), 3), round(rng.uniform(0, 2), 3), 0.0) for _ in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "run int, generation int, t_s double, id string, x double, y double, z double")
    odd = spark.createDataFrame([(0, 0, 1.0, "nan", float("nan"), 0.0, 0.0), (None, 0, 1.0, "none", 0.0, 0.0, 0.0)], df.schema)
    monkeypatch.setattr(support, "CHUNK", 5)
    out = jn.match_components(df.unionByName(odd), df, radius=0.5, fraction=0.2, max_gap_s=1.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    clouds = {}
    for run, _, t, i, *p in rows:
        clouds.setdefault((run, t, i), []).append(p)
    want = {}
    for (r, t, i), p in clouds.items():
        for (s, u, j), q in clouds.items():
            if r == s and 0 <= t - u <= 1.0:
                sides = [min(math.dist(x, y) for y in q) for x in p], [min(math.dist(x, y) for x in p) for y in q]
                share = max(sum(d <= 0.5 for d in x) / len(x) for x in sides)
                if share >= 0.2:
                    want[r, i, j] = round(share, 9), round(min(map(median, sides)) + (1 - share) * 0.1, 9)
    got = {(x["run"], x["component"], x["track"]): (round(x["fraction"], 9), round(x["score"], 9)) for x in out.collect()}
    assert got == want and len(want) > 200 and out.count() == len(want)


def test_voxels_are_linked_where_they_lie_before_the_search(spark, monkeypatch):
    """the rounds of the search over all moved every voxel and every pair of near ones."""
    import math
    import random

    from swathe.plans import detect as de

    search, seen = de.connected_components, []
    monkeypatch.setattr(de, "connected_components", lambda v, e: seen.append((v.count(), e.count())) or search(v, e))
    rng = random.Random(6)
    rows = [(f, f"{f}-{i}", rng.uniform(-25, 25), rng.uniform(-4, 4), rng.uniform(-3, 3)) for f in range(3) for i in range(500)]
    rows += [(9, f"9-{i}", i + 0.5, 0.5, 0.5) for i in range(60)]  # a chain through several cells
    p = spark.createDataFrame(rows, "frame int, id string, x double, y double, z double")
    seeds = spark.createDataFrame([(f, 0.2, 0.1, 0.3) for f in (0, 1, 2, 9)], "frame int, x double, y double, z double")
    radius, gap = 1.5, 3.0
    want = {}
    for f in (0, 1, 2, 9):
        cells = {}
        for _, i, *at in (r for r in rows if r[0] == f):
            cells.setdefault(tuple(map(math.floor, at)), []).append(i)
        centre = {k: tuple(x + 0.5 for x in k) for k in cells}
        near = min((math.dist((0.2, 0.1, 0.3), m), min(cells[k]), k) for k, m in centre.items())
        assert near[0] <= gap
        found, todo = {near[2]}, [near[2]]
        while todo:
            a = todo.pop()
            new = [k for k in cells if k not in found and math.dist(centre[a], centre[k]) <= radius]
            found |= set(new)
            todo += new
        for k in found:
            for i in cells[k]:
                want[i] = min(min(cells[k]) for k in found)
    got = {r["id"]: r["component"] for r in de.linked_component(p, seeds, ["frame"], voxel=1.0, radius=radius, max_gap=gap).collect()}
    assert got == want and len([i for i in want if i.startswith("9-")]) == 60
    assert len(seen) == 1 and seen[0][0] < 0.5 * len(rows)


def test_eras_are_dealt_to_many_tasks(spark, small, monkeypatch):
    """eras of few bytes were coalesced into a task or two, whatever work they are."""
    from swathe.catalog import q_sources
    from swathe.streaming import tracks as tr

    cut, tasks = tr.cut, {}
    monkeypatch.setattr(tr, "cut", lambda df, tag="step": tasks.setdefault(tag, df.rdd.getNumPartitions()) and cut(df, tag))
    rows = tr.track_batch(q_sources._voxels(small), {"radius": 1.5, "voxel": 1.0})
    assert rows.count() == 57 and tasks["tracks"] >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 2
