"""Accuracy studies against plain Python on small made rows."""

import math

import numpy as np
import pandas as pd
import pytest

from swathe.operators.paths import attach_near
from swathe.plans import evaluate as ev

RNG = np.random.default_rng(4)


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


def test_bootstrap_medians_equal_pooled_medians(spark):
    n = 400
    pdf = pd.DataFrame({"method": RNG.choice(["A", "B"], n), "run": RNG.choice([1, 1, 1, 2, 3], n), "frame": RNG.integers(0, 90, n),
                        "error_m": np.round(RNG.normal(0, 1, n), 1)})
    df = frame(spark, pdf)
    draws = ev.block_draws(df, ["method"], replicates=25).cache()
    got = {(r.method, r.rep): r["median"] for r in ev.replicate_medians(df, draws, ["method"], "error_m").collect()}
    d = draws.toPandas()
    blocks = pdf.assign(blk=pdf.frame // 20)
    per_run = blocks.groupby(["method", "run"]).blk.nunique()
    assert (d.groupby(["method", "run", "rep"]).m.sum().unstack("rep").eq(per_run, axis=0)).all().all()
    both = blocks.merge(d, on=["method", "run", "blk"])
    want = both.loc[both.index.repeat(both.m)].groupby(["method", "rep"]).error_m.median().to_dict()
    assert got == pytest.approx(want)


def calibration_brute(rows, q=0.95):
    rr = [r for r in rows if 30 <= r["range_m"] < 100 and all(r[k] is not None and math.isfinite(r[k]) for k in ("near_mahal2", "far_mahal2"))]
    if not rr:
        return 1.0
    frames = pd.Series([(r["run"], r["frame"]) for r in rr])
    per_start, starts = frames.value_counts(), pd.Series([f[0] for f in frames.unique()]).value_counts()
    pairs = sorted((math.sqrt(max(r["near_mahal2"], r["far_mahal2"]) / ev.LIMIT95), 1 / (per_start[(r["run"], r["frame"])] * starts[r["run"]])) for r in rr)
    z, w = (np.array(v) for v in zip(*pairs))
    return max(1.0, float(np.interp(q, (np.cumsum(w) - w / 2) / w.sum(), z)))


@pytest.mark.parametrize("runs", [1, 2, 12])
def test_calibration_without_a_run(spark, runs):
    n = 60 * runs
    pdf = pd.DataFrame({"method": "A", "run": RNG.integers(0, runs, n).astype("int32"), "frame": RNG.integers(0, 9, n), "range_m": RNG.uniform(20, 110, n),
                        "near_mahal2": np.round(RNG.exponential(9, n)), "far_mahal2": np.round(RNG.exponential(9, n)), "sigma_lateral": 0.1, "sigma_vertical": 0.05})
    pdf.loc[3, "near_mahal2"] = np.nan
    pdf.loc[5, "far_mahal2"] = np.inf
    rows = pdf.to_dict("records")
    got = {r.held_run: r for r in ev.corridor_calibration(frame(spark, pdf)).collect()}
    assert set(got) == {None, *pdf.run}
    assert got[None].scale == pytest.approx(calibration_brute(rows))
    for run in set(pdf.run):
        scale = calibration_brute([r for r in rows if r["run"] != run])
        test = [r for r in rows if r["run"] == run and 30 <= r["range_m"] < 100]
        cover = np.mean([math.isfinite(r["near_mahal2"] + r["far_mahal2"]) and max(r["near_mahal2"], r["far_mahal2"]) <= ev.LIMIT95 * scale**2 for r in test])
        assert (got[run].scale, got[run].coverage) == (pytest.approx(scale), pytest.approx(cover))
        assert got[run].n == len(test) and got[run].width_lateral == pytest.approx(4.895 * 0.1 * scale)


def test_slopes_leave_one_run_out(spark):
    n = 300
    x = RNG.normal(0, 1, n)
    pdf = pd.DataFrame({"run": RNG.integers(0, 4, n), "x": x, "y": 0.7 * x + np.where(RNG.random(n) < 0.1, 5, 0.01) * RNG.normal(0, 1, n)})
    got = {r.run: r.coef for r in ev.robust_slopes(frame(spark, pdf), "x", "y").collect()}
    for run in range(4):
        d = pdf[pdf.run != run]
        lo, hi = -20.0, 20.0
        for _ in range(60):
            mid = (lo + hi) / 2
            r = (mid * d.x - d.y) / 0.02
            lo, hi = (mid, hi) if (d.x * r / np.sqrt(1 + r * r)).sum() < 0 else (lo, mid)
        assert got[run] == pytest.approx(lo, abs=1e-7)


def test_gates_open_only_for_a_signal(spark):
    n = 400
    x = RNG.normal(0, 1, n)
    pdf = pd.DataFrame({"run": np.arange(n) % 5, "x": x, "y": 0.3 * x + RNG.normal(0, 0.02, n)})
    r = ev.signal_gates(frame(spark, pdf), "x", "y").first()
    assert r.slope_supported and r.signal_supported and r.gain > 0.5
    r = ev.signal_gates(frame(spark, pdf.assign(y=RNG.normal(0, 0.3, n))), "x", "y").first()
    assert not r.slope_supported and not r.signal_supported
    alone = ev.signal_gates(frame(spark, pdf.assign(run=1)), "x", "y").first()
    assert alone.coef == 0 and alone.residual_sigma is None and not alone.slope_supported
    assert ev.signal_gates(frame(spark, pdf).where("run > 9"), "x", "y").count() == 0


def test_curvature_errors_equal_numpy_gradients_per_island(spark):
    index = np.array([i for i in range(30) if i not in (9, 13)])
    s = 25 + 1.5 * index + RNG.uniform(0, 0.2, len(index))
    g = np.column_stack([0.002 * s * s, -s, 0.001 * s * s])
    p = g + RNG.normal(0, 0.05, g.shape)
    pdf = pd.DataFrame({"k": 1, "i": index, "s": s, **{"p" + a: p[:, j] for j, a in enumerate("xyz")}, **{"g" + a: g[:, j] for j, a in enumerate("xyz")}})
    pdf.loc[pdf.i == 20, "pz"] = np.nan
    got = {r.i: (r.kh_error, r.kv_error) for r in ev.curvature_errors(frame(spark, pdf), ["k"], "s", "i").collect()}

    def bends(s, c):
        v = np.gradient(c, s, axis=0)
        a = np.gradient(v, s, axis=0)
        speed = np.linalg.norm(v[:, :2], axis=1)
        return (v[:, 0] * a[:, 1] - v[:, 1] * a[:, 0]) / speed**3, np.gradient(v[:, 2] / speed, s)

    want = {}
    for part in (range(0, 9), range(10, 13), range(14, 20), range(21, 30)):
        m = np.isin(index, list(part))
        if m.sum() < 5:
            continue
        e = [x - y for x, y in zip(bends(s[m], p[m]), bends(s[m], g[m]))]
        for j in range(2, m.sum() - 2):
            want[int(index[m][j])] = (pytest.approx(e[0][j]), pytest.approx(e[1][j]))
    assert got == want


def test_scores_and_choice_without_a_run(spark):
    rows = []
    for run, method, far in ((1, "A", 0.1), (1, "B", 0.3), (2, "A", 0.2), (2, "B", 0.1), (3, "A", 0.5), (3, "B", 0.1)):
        rows += [(method, run, r, far, far / 2, True, 0.1, 0.05) for r in (31.0, 35.0, 40.0, 60.0, 61.0)]
    df = spark.createDataFrame(rows, "method string, run int, range_m double, far_error double, center_error double, inside95 boolean, sigma_lateral double, sigma_vertical double")
    scores = ev.run_scores(df).cache()
    one = lambda far: far + 0.25 * far + 0.2 * (far > 0.2) + 0.05 * 0.05 + 0.02 * 4.895 * 0.15 / 2  # the block with two rows doesn't count
    assert {(r.method, r.run): r.run_score for r in scores.collect()} == {(m, n): pytest.approx(one(f)) for n, m, f in ((1, "A", 0.1), (1, "B", 0.3), (2, "A", 0.2), (2, "B", 0.1), (3, "A", 0.5), (3, "B", 0.1))}
    total = {r.method: r.score for r in ev.method_score(scores).collect()}
    assert total["B"] == pytest.approx(0.7 * (one(0.3) + 2 * one(0.1)) / 3 + 0.3 * one(0.3))
    left = {r.run: (r.method, r.own_score) for r in ev.left_out_method(scores).collect()}
    assert left == {1: ("B", pytest.approx(one(0.3))), 2: ("B", pytest.approx(one(0.1))), 3: ("A", pytest.approx(one(0.5)))}


def test_ranking_drops_equal_outcomes_and_counts_losses(spark):
    rows = [(v, run, f, True, reach, bad, gt) for run in (1, 2) for f in range(4) for v, reach, bad, gt in (
        ("base", 60.0, 0, 120.0), ("copy", 60.0, 0, 120.0), ("far", 110.0 if f else 50.0, 0, 120.0 if f > 1 else 80.0), ("wrong", 110.0, 1, 120.0))]
    rows.append(("far", 1, 9, True, 200.0, 0, 1.0))  # the base has no such start
    df = spark.createDataFrame(rows, "variant string, run int, frame int, eligible boolean, reach_m double, bad int, gt_m double")
    got = {r.variant: r for r in ev.variant_ranking(df, "base").collect()}
    assert sorted(got, key=lambda v: got[v].place) == ["far", "base", "wrong"]
    far = got["far"]
    assert (far.n, far.wins_20m, far.losses_8m, far.catastrophic, far.conditional_100m) == (8, 6, 2, 0, 1.0)
    assert far.mean_utility == pytest.approx(2 + 3 * 0.75 + 5 * 0.75 + (330 + 50) / 480 - 2 * 0.25)
    assert {r.run: r.variant for r in ev.left_out_ranking(df, "base").collect()} == {1: "far", 2: "far"}


def test_near_rails_stay_without_a_usable_prior(spark):
    def rails(run, ks, **moved):
        return [(run, k, -0.8, -0.5 * k, 0.0, 0.8, moved.get(f"y{k}", -0.5 * k), 0.0) for k in ks]

    schema = "run int, k int, lx double, ly double, lz double, rx double, ry double, rz double"
    near = spark.createDataFrame([r for run in range(5) for r in rails(run, range(9))], schema)
    prior = spark.createDataFrame(rails(0, range(30)) + rails(1, range(9)) + rails(2, range(30), y20=0.0)
                                  + [(3, k, *r[2:]) for k, r in enumerate(rails(3, [0, 4, 8, 9, 25]))], schema)
    out = attach_near(prior, near, ["run"]).toPandas()
    assert out.groupby("run").status.first().to_dict() == {
        0: "CURRENT_NEAR_WITH_BLENDED_TAIL", 1: "NEAR_ONLY_SHORT_OR_NONMONOTONIC_PRIOR", 2: "NEAR_ONLY_SHORT_OR_NONMONOTONIC_PRIOR",
        3: "NEAR_ONLY_INVALID_JOIN", 4: "NEAR_ONLY_SHORT_OR_NONMONOTONIC_PRIOR"}
    assert out.groupby("run").k.count().to_dict() == {0: 30, 1: 9, 2: 9, 3: 9, 4: 9}


def test_sampled_covariance_meets_the_first_order_one(spark):
    from swathe.functions.vector import const
    from pyspark.sql import functions as F

    sections = spark.createDataFrame([(r, k, 0.02 + 0.01 * k) for r in range(2) for k in range(40)], "run int, k int, a double").selectExpr("*", "0.0D cx", "0.0D cy", "0.0D cz")
    state = {"alpha": F.col("a"), "d": F.lit(0.63), "h": F.lit(0.27), "g": F.lit(1.56), "hf": F.lit(0.28)}
    got = ev.monte_carlo(sections, ["run"], ["run", "k"], const(0, 1, 0), const(0, 0, 1), state, draws=1000).collect()
    assert sorted((r.run, r.rail, r.sections) for r in got) == [(r, n, 40) for r in range(2) for n in ("far", "near")]
    assert all(r.relative_error < 0.03 for r in got)


def test_audits_can_fail(spark):
    frames = spark.createDataFrame([(1, f) for f in range(4)], "run int, frame int")
    used = [(1, 2, 1, "cloud"), (1, 2, 2, "cloud"), (1, 2, 3, "direction")]
    schema = "run int, frame int, source int, role string"
    assert ev.causality_audit(spark.createDataFrame(used, schema), frames, ["run"]).first().causal
    for bad in ((1, 2, 3, "cloud"), (1, 2, 2, "direction"), (1, 2, -1, "cloud")):
        assert not ev.causality_audit(spark.createDataFrame([*used, bad], schema), frames, ["run"]).first().causal
    r = ev.saved_rows_check(frames.where("frame <> 1"), frames.where("frame <> 2"), ["run", "frame"], ["run"]).first()
    assert (r.saved, r.recomputed, r.missing, r.unexpected) == (3, 3, 1, 1)


def test_quantiles_at_a_limit_are_the_sqls(spark):
    import random

    import duckdb
    from pyspark.sql import functions as F

    from swathe.operators.quantiles import sorted_quantile
    from swathe.plans.evaluate import residual_gate

    at_limit = [i / 1000 for i in range(520, 546)] + [0.546, 0.586, 0.59, 0.595]  # its 0.9 quantile is 0.55 with one rounding
    rng = random.Random(5)
    groups = [at_limit] + [[rng.randint(0, 600) / 1000 for _ in range(rng.randint(1, 30))] for _ in range(400)]
    table = pd.DataFrame([(g, i, x) for g, xs in enumerate(groups) for i, x in enumerate(xs)], columns=["run", "row_id", "error_m"])
    con = duckdb.connect()
    con.register("t", table)
    want = dict(con.execute("SELECT run, [quantile_cont(error_m, 0.9), quantile_cont(error_m, 0.8)] FROM t GROUP BY run").fetchall())
    rows = spark.createDataFrame(table)
    lists = rows.groupBy("run").agg(F.array_sort(F.collect_list("error_m")).alias("l"))
    got = {r.run: [r.p, r.q] for r in lists.select("run", sorted_quantile(F.col("l"), 0.9).alias("p"), sorted_quantile(F.col("l"), 0.8).alias("q")).collect()}
    assert got == want
    gate = {r.run: r for r in residual_gate(rows, ["run"], "error_m", "row_id", limit=0.55).collect()}
    assert {g: r.strong for g, r in gate.items()} == {g: w[0] <= 0.55 for g, w in want.items()} and gate[0].strong
    assert rows.where("run = 0").agg(F.percentile("error_m", F.lit(0.9))).first()[0] > 0.55  # one unit in the last place above


def test_capped_residuals_stay_at_the_cap_however_rows_are_dealt(spark):
    from swathe.plans.evaluate import residual_gate

    rows = spark.createDataFrame([(n, i, 0.5) for n in range(1, 31) for i in range(n)], "run int, row_id int, error_m double")
    split = residual_gate(rows.repartition(7), ["run"], "error_m", "row_id", limit=0.4, weak_limit=0.6, weak_robust=0.06)


    def one_by_one(n):
        s = 0.0
        for _ in range(n):
            s += 0.06 * 0.06
        return math.sqrt(s / n)

    assert {r.run: (r.robust, r.weak) for r in split.collect()} == {n: (one_by_one(n), one_by_one(n) <= 0.06) for n in range(1, 31)}
