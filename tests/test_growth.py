"""What a query moves, and how it is dealt to tasks, grows with its input only."""

import math
import random

from pyspark.sql import functions as F

c = F.col


def cloud(spark, n=400, frames=2, seed=3):
    r = random.Random(seed)
    rows = [(f, f * n + i, r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(-9, 9)) for f in range(frames) for i in range(n)]
    return spark.createDataFrame(rows, "frame int, id long, x double, y double, z double"), rows


def test_draws_of_a_small_file_are_many_tasks(spark):
    """the file of the sections was one task, whatever the number of draws."""
    from swathe.functions.vector import const
    from swathe.plans import evaluate as ev

    sections = spark.range(3000).coalesce(1).selectExpr("0 run", "id k", "0.01D * (id % 7) a", "0.0D cx", "0.0D cy", "0.0D cz")
    state = {"alpha": c("a"), "d": F.lit(0.63), "h": F.lit(0.27), "g": F.lit(1.56), "hf": F.lit(0.28)}
    got = ev.monte_carlo(sections, ["run"], ["run", "k"], const(0, 1, 0), const(0, 0, 1), state, draws=1000)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    from swathe.session import dealt

    assert dealt(sections, ["run", "k"], 1000).rdd.getNumPartitions() == 3


def test_radius_pairs_copies_few_rows(spark, monkeypatch):
    """a row was copied to 14 cells."""
    from swathe.operators import joins as jn

    df, rows = cloud(spark)
    copies, box = [], jn.explode_box
    monkeypatch.setattr(jn, "explode_box", lambda *a: copies.append(box(*a)) or copies[-1])
    got = {(r.frame, r.a_id, r.b_id) for r in jn.radius_pairs(df, ["frame"], ["id"], 2.0).collect()}
    want = {(p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and sum((p[i] - q[i]) ** 2 for i in (2, 3, 4)) <= 4.0}
    assert got == want and len(got) > 100
    assert copies and copies[0].count() < 3.5 * len(rows)


def test_radius_pairs_of_equal_coordinates(spark):
    """Pairs on one x, and on one point, are met once."""
    from swathe.operators.joins import radius_pairs

    df = spark.createDataFrame([(0, i, 8.0, 8.0 * (i % 2), 0.0) for i in range(4)], "frame int, id long, x double, y double, z double")
    assert sorted((r.a_id, r.b_id) for r in radius_pairs(df, ["frame"], ["id"], 8.0).collect()) == [(a, b) for a in range(4) for b in range(a + 1, 4)]


def test_linked_component_searches_numbers(spark, monkeypatch):
    """the rounds of the search moved texts of 24 characters."""
    from swathe.plans import detect as de

    search, types = de.connected_components, []
    monkeypatch.setattr(de, "connected_components", lambda v, e: types.append(dict(v.dtypes)["id"]) or search(v, e))
    xs = [0.5, 1.5, 2.5, 9.5, 10.5]
    p = spark.createDataFrame([(f, f"{f}-{i}", x, 0.5, 0.5) for f in (0, 1) for i, x in enumerate(xs)], "frame int, id string, x double, y double, z double")
    seeds = spark.createDataFrame([(0, 0.4, 0.5, 0.5), (1, 10.4, 0.5, 0.5)], "frame int, x double, y double, z double")
    got = sorted((r.id, r.component) for r in de.linked_component(p, seeds, ["frame"], voxel=1.0, radius=1.5, max_gap=1.0).collect())
    assert got == [("0-0", "0-0"), ("0-1", "0-0"), ("0-2", "0-0"), ("1-3", "1-3"), ("1-4", "1-3")]
    assert types == ["bigint"]


def test_stencils_stay_in_their_task(spark):
    """The copies of a bin were moved, 289 for the density and 9 for the maxima."""
    import math

    from swathe.operators import aggregates as agg

    r = random.Random(5)
    pts = [(k, round(r.gauss(0, 1), 3), round(r.gauss(0, 1), 3)) for k in (0, 1) for _ in range(60)]
    d = agg.density_2d(spark.createDataFrame(pts, "k int, u double, v double"), ["k"], "u", "v", 0.5, 1.0)
    g = [math.exp(-0.5 * i * i) for i in range(-4, 5)]
    want = {}
    for k, u, v in pts:
        for i in range(-4, 5):
            for j in range(-4, 5):
                at = (k, math.floor(u / 0.5) + i, math.floor(v / 0.5) + j)
                want[at] = want.get(at, 0.0) + g[i + 4] * g[j + 4] / sum(g) ** 2
    got = {(x.k, x.bu, x.bv): x.density for x in d.collect()}
    assert got.keys() == want.keys() and all(abs(got[at] - want[at]) < 1e-12 for at in want)
    d = d.withColumn("density", F.round("density", 9))
    near = lambda at: [want.get((at[0], at[1] + i, at[2] + j), 0) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    tops = {at for at in want if round(want[at], 9) > 0 and round(want[at], 9) >= round(max(near(at)), 9)}
    top = agg.local_maxima(d, ["k"])
    assert {(x.k, x.bu, x.bv) for x in top.collect()} == tops
    for df in (d, top):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate") < plan.index("Exchange")  # nothing is moved above the copies


def test_budget_counts_as_plain_python(spark):
    """every point met sixteen targets, and five histories, before it was counted."""
    from swathe.operators import aggregates as agg

    r = random.Random(7)
    pts = [(0, r.choice((1, 2, 3, 7, 9, 20)), r.choice((20, 40)), float(r.randrange(4)), 0.0, 0.0, r.randrange(3)) for _ in range(90)]
    targets = [1, 2, 4, 7, 9, 12, 20, 30]
    p = spark.createDataFrame(pts, "run int, frame int, m int, x double, y double, z double, ring int")
    out = agg.point_budget(p, spark.createDataFrame([(0, t) for t in targets], "run int, target int"), ["run"], "m", [1, 2, 4, 8])
    want = set()
    for t in targets:
        for n in (1, 2, 4, 8):
            for m in (20, 40):
                q = [x for x in pts if t - n < x[1] <= t and x[2] == m]
                if q:
                    want.add((t, n, m, len(q), len({x[3:6] for x in q}), len({x[1] for x in q}), len({x[6] for x in q})))
    assert {tuple(x) for x in out.collect()} == want


def test_block_draws_of_a_small_file_are_many_tasks(spark):
    """a thousand copies of every block were counted in the task that read the blocks' small file."""
    from swathe.plans import evaluate as ev

    df = spark.range(6000).selectExpr("'a' method", "id div 2 run", "(id % 2) * 20 frame", "1.0D error_m")
    draws = ev.block_draws(df, ["method"])
    assert "REPARTITION_BY_NUM" in draws._jdf.queryExecution().executedPlan().toString()
    assert draws.groupBy("rep").agg(F.sum("m").alias("m")).where("m <> 6000").isEmpty()


def test_robust_pca_reads_its_rows_twice(spark):
    """each round computed all earlier ones several times over."""
    import numpy as np

    from swathe.operators import aggregates as agg

    r = random.Random(11)
    rows = [(k, r.gauss(0, 5), r.gauss(0, 0.3) + (4 if r.random() < 0.1 else 0), r.gauss(0, 0.1)) for k in (0, 1) for _ in range(80)]
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(rows, "k int, x double, y double, z double").withColumn("x", F.udf(count, "double")("x"))
    got = {x.k: x for x in agg.robust_pca(df, ["k"], (1.0, 0.0, 0.0)).collect()}
    assert seen.value <= 2 * len(rows)
    for k in (0, 1):
        p = np.array([x[1:] for x in rows if x[0] == k])
        for i in range(3):
            m = p.mean(axis=0)
            v = np.linalg.eigh(np.cov(p.T, bias=True))[1][:, 2]
            if i < 2:
                d = np.sqrt(np.maximum(0, ((p - m) ** 2).sum(axis=1) - ((p - m) @ v) ** 2))
                p = p[d <= np.median(d) + 2.5 * max(1.4826 * np.median(abs(d - np.median(d))), 1e-6)]
        v = v if v[0] >= 0 else -v
        assert got[k].n == len(p) and np.allclose([got[k].px, got[k].py, got[k].pz], v, atol=1e-9)


def test_split_heads_moves_its_rows_once(spark):
    """each of twelve rounds shuffled and wrote."""
    import numpy as np

    from swathe.plans.detect import split_heads

    r = random.Random(13)
    rows = [(k, r.choice((-0.8, 0.8)) + r.gauss(0, 0.3)) for k in range(6) for _ in range(30)] + [(9, 1.0)] * 12
    out = split_heads(spark.createDataFrame(rows, "k int, v double"), ["k"], width=(0.8, 5.0))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {}
    for k in {x[0] for x in rows}:
        q = np.array([x[1] for x in rows if x[0] == k])
        a, b = np.percentile(q, 20), np.percentile(q, 80)
        for _ in range(12):
            left = abs(q - a) <= abs(q - b)
            na, nb = (np.median(p) if len(p) else None for p in (q[left], q[~left]))
            rest = na is not None and nb is not None and max(abs(na - a), abs(nb - b)) < 1e-5
            a, b = a if na is None else na, b if nb is None else nb
            if rest:
                break
        if left.sum() >= 5 and (~left).sum() >= 5 and 0.8 < nb - na < 5:
            want[k] = (int(left.sum()), int((~left).sum()), round(na, 9), round(nb, 9))
    assert {x.k: (x.n_left, x.n_right, round(x.left, 9), round(x.right, 9)) for x in out.collect()} == want and len(want) > 3


def test_hulls_are_found_in_rows(spark):
    """two calls of Python with a data frame for every group."""
    from swathe.plans.objects import hull_area

    rows = [(k, float(x), float(y)) for k in range(5) for x in range(k + 1) for y in range(3)] + [(9, 0.0, 0.0)]
    out = hull_area(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y", chunk=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "ArrowEvalPython" in plan
    assert {x.k: x.hull_m2 for x in out.collect()} == {0: 0.0, 1: 2.0, 2: 4.0, 3: 6.0, 4: 8.0, 9: 0.0}


def test_coverage_runs_in_rows(spark):
    """F32: twelve rounds over every cell of every history, each sorted and written."""
    from swathe.plans.detect import greedy_coverage

    r = random.Random(17)
    rows = [(k, s, r.randrange(25)) for k in (0, 1, 2) for s in range(9) for _ in range(12)]
    out = greedy_coverage(spark.createDataFrame(rows, "k int, source int, cell long"), ["k"], rounds=4)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    want = set()
    for k in (0, 1, 2):
        todo = {s: {x[2] for x in rows if x[:2] == (k, s)} for s in range(9)}
        for i in range(4):
            gain, s = max(((len(v), -s) for s, v in todo.items() if v), default=(0, 0))
            if gain:
                want.add((k, i + 1, -s, gain))
                got = todo.pop(-s)
                todo = {n: v - got for n, v in todo.items()}
    assert {tuple(x) for x in out.collect()} == want


def test_voxel_pairs_move_points_once(spark):
    """voxels were shuffled, and again as both sides of a join, with almost four rows each; sorts spilled at 1 GB."""
    from swathe.operators import joins as jn

    df, rows = cloud(spark, 300)
    pairs = jn.voxel_pairs(df, ["frame"], "id", 0.7, 2.0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Join" not in plan
    voxels = {}
    for f, i, *p in rows:
        voxels.setdefault((f, *[math.floor(v / 0.7) for v in p]), []).append((i, *p))
    cent = [(k[0], min(r[0] for r in v), [sum(r[n] for r in v) / len(v) for n in (1, 2, 3)]) for k, v in voxels.items()]
    want = {(a[0], a[1], b[1]): math.dist(a[2], b[2]) for a in cent for b in cent if a[0] == b[0] and a[1] < b[1] and math.dist(a[2], b[2]) <= 2.0}
    got = {(r.frame, r.a_id, r.b_id): r.d for r in pairs.collect()}
    assert got.keys() == want.keys() and len(want) > 100 and pairs.count() == len(want) and len(cent) < len(rows)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_radius_pairs_copy_upwards_only(spark, monkeypatch):
    """a row and its copies were almost four rows."""
    from swathe.operators import joins as jn

    df, rows = cloud(spark)
    copies, box = [], jn.explode_box
    monkeypatch.setattr(jn, "explode_box", lambda *a: copies.append(box(*a)) or copies[-1])
    pairs = jn.radius_pairs(df, ["frame"], ["id"], 1.0)
    assert copies[0].count() < 1.7 * len(rows)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_odd_rows(spark):
    """Rows without key, id or finite place pair with none, and leave the centroids of others alone."""
    from swathe.operators import joins as jn

    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, 0.01, 0.01, 0.01), (0, 2, 0.31, 0.01, 0.01), (0, 3, nan, 0.01, 0.01), (0, 4, 0.3, -inf, 0.0), (0, 5, None, 0.0, 0.0), (None, 6, 0.1, 0.1, 0.1)]
    rows += [(None, 7, 0.2, 0.1, 0.1), (0, None, 0.12, 0.01, 0.01), (0, None, 0.32, 0.01, 0.01), (0, 8, 1e300, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "frame int, id long, x double, y double, z double")
    got = [(r.frame, r.a_id, r.b_id, round(r.d, 9)) for r in jn.voxel_pairs(df, ["frame"], "id", 0.05, 0.5).collect()]
    assert got == [(0, 1, 2, 0.305)]
    assert [(r.a_id, r.b_id) for r in jn.radius_pairs(df, ["frame"], ["id"], 0.5).collect()] == [(1, 2)]
