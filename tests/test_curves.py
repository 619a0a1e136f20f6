"""Smoothed curves against a dense fit in another basis, histories against a walk back frame by frame."""

import random

import numpy as np
from pyspark.sql import functions as F

from swathe.operators import windows as win
from swathe.plans import fit

c = F.col


def powers(s, knots, derivative):
    """1, s, s^2, s^3 and a cube from every knot on: the same curves as the B-splines, with derivatives."""
    scale = [1, 1, 1, 1] if derivative == 0 else [0, 0, 2, 6] if derivative == 2 else [0, 0, 0, 6]
    plain = [f * s ** max(0, k - derivative) for k, f in enumerate(scale)]
    cubes = [{0: 1, 2: 6, 3: 6}[derivative] * np.where(s >= k, s - k, 0.0) ** (3 - derivative) * (s >= k) for k in knots]
    return np.stack([*plain, *cubes], axis=1)


def dense_fit(s, y, sigma, asked, priors, loss, rounds=6, spacing=4.0):
    end = max(s.max(), asked.max())
    knots = np.arange(spacing, end - 1e-8, spacing)
    fine = np.append(np.arange(0, end - 1e-7, 0.5), end)
    x, q = powers(s, knots, 0), powers(asked, knots, 0)
    second, third = powers(fine, knots, 2), powers(fine, knots, 3)
    coef = [np.linalg.lstsq(x, y[:, a], rcond=None)[0] for a in range(y.shape[1])]
    for _ in range(rounds):
        r = np.maximum(np.sqrt(sum(((x @ coef[a] - y[:, a]) / sigma[:, a]) ** 2 for a in range(y.shape[1]))), 1e-12)
        w = np.maximum({"huber": np.minimum(1, 1.5 / r), "cauchy": 1 / (1 + (r / 2) ** 2), "tukey": np.maximum(0, 1 - (r / 4.685) ** 2) ** 2, "student": 5 / (4 + r * r)}[loss], 1e-5)
        stack = [np.vstack([x * (np.sqrt(w) / sigma[:, a])[:, None], second / priors[a][0], third / priors[a][1]]) for a in range(y.shape[1])]
        coef = [np.linalg.lstsq(m, np.r_[y[:, a] * np.sqrt(w) / sigma[:, a], np.zeros(2 * len(fine))], rcond=None)[0] for a, m in enumerate(stack)]
    var = []
    for m in stack:
        r = np.linalg.qr(m, mode="r")
        var.append(np.maximum(np.sum(np.linalg.solve(r.T, q.T) ** 2, axis=0), 0.003 ** 2))
    return [q @ k for k in coef], var


def test_smooth_curves_equal_a_dense_fit(spark):
    rng, priors = np.random.default_rng(4), [(0.025, 0.004), (0.015, 0.015)]
    rows, asked, want = [], [], {}
    for curve, (end, n, hole) in enumerate([(40.0, 120, None), (37.3, 60, (12, 24)), (3.0, 9, None), (61.0, 300, (30, 31))]):
        s = np.sort(np.r_[0.0, rng.uniform(0, end, n - 2), end])
        if hole:
            s = s[(s < hole[0]) | (s > hole[1])]
        y = np.stack([0.001 * s * s, 0.02 * s], axis=1) + rng.normal(0, 0.02, (len(s), 2))
        y[rng.random(len(s)) < 0.08] += 0.6
        sigma = rng.uniform(0.01, 0.04, y.shape)
        q = np.r_[np.arange(0, end, 1.0), end]
        want[curve] = (q, dense_fit(s, y, sigma, q, priors, "cauchy"))
        rows += [(curve, *map(float, (a, *b, *e))) for a, b, e in zip(s, y, sigma)]
        asked += [(curve, float(a), i) for i, a in enumerate(q)]
    rows += [(0, None, 1.0, 1.0, 0.01, 0.01), (0, 5.0, None, 1.0, 0.01, 0.01), (0, 5.0, float("nan"), 1.0, 0.01, 0.01), (1, 6.0, 0.0, 0.0, None, 0.01)]
    asked += [(0, None, 99), (9, 1.0, 0)]
    obs = spark.createDataFrame(rows, "g int, s double, y double, z double, ey double, ez double")
    query = spark.createDataFrame(asked, "g int, s double, i int")
    out = fit.smooth_curves(obs, ["g"], "s", ["y", "z"], ["ey", "ez"], prior=priors, loss="cauchy", query=query)
    assert out.columns == ["g", "s", "i", "y_fit", "y_var", "z_fit", "z_var"]
    got = {(r["g"], r["i"]): r for r in out.collect()}
    assert len(got) == len(asked)
    for curve, (q, (values, var)) in want.items():
        for name, v, e in zip("yz", values, var):
            mine = np.array([[got[curve, i][f"{name}_fit"], got[curve, i][f"{name}_var"]] for i in range(len(q))])
            assert np.abs(mine[:, 0] - v).max() < 1e-5
            assert np.abs(mine[:, 1] / e - 1).max() < 1e-3
    # The hole has the widest band; a row without a station and a curve without observations have none.
    assert got[1, 18]["y_var"] > 5 * got[1, 5]["y_var"]
    assert got[0, 99]["y_fit"] is None and got[9, 0]["z_var"] is None


def test_band_solve_equals_dense_inverse():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 7, 30):
        m = np.zeros((2, n, n))
        for a in range(2):
            for i in range(n):
                for j in range(i, min(n, i + 4)):
                    m[a, i, j] = m[a, j, i] = rng.normal() + 9.0 * (i == j)
        bands = np.zeros((2, n, 4))
        for d in range(4):
            for i in range(n - d):
                bands[:, i, d] = m[:, i, i + d]
        b = rng.normal(size=(2, n))
        x, z = fit._band_solve(bands, b)
        inverse = np.linalg.inv(m)
        assert np.allclose(x, np.einsum("aij,aj->ai", inverse, b))
        assert all(np.allclose(z[:, i, d], inverse[:, i, i + d]) for d in range(4) for i in range(n - d))


def test_smooth_curves_of_no_rows(spark):
    obs = spark.createDataFrame([], "g int, s double, y double, e double")
    assert fit.smooth_curves(obs, ["g"], "s", ["y"], "e", rounds=1).collect() == []


def walked_back(chain, places, run_first, distance=None, n=None):
    out = {}
    for i, frame in enumerate(sorted(chain)):
        frames, reason, k = [frame], None, frame - 1
        while reason is None:
            if k < run_first:
                reason = "RUN_START"
            elif n is not None and len(frames) >= n:
                reason = "FRAME_LIMIT"
            elif k not in chain:
                reason = "TIME_OR_POSE_GAP"
            elif distance is not None and np.linalg.norm(np.subtract(places[k], places[frame])) > distance + 1e-10:
                reason = "DISTANCE_LIMIT"
            else:
                frames.append(k)
                k -= 1
        out[frame] = (frames[-1], len(frames), reason)
    return out


def test_history_spans_equal_a_walk_back(spark):
    rng = random.Random(3)
    rows, want, counted = [], {}, {}
    for run in range(4):
        x, y, chain, places, chains = 0.0, 0.0, 0, {}, {}
        for frame in range(5, 205):
            if run == 0:  # straight, with stops
                x += 0.0 if frame % 40 < 25 else 0.5
            elif run == 1:  # to and fro
                x += 0.7 if frame % 30 < 15 else -0.7
            elif run == 2:  # jitter and a circle
                x, y = 6 * np.cos(frame / 9) + rng.uniform(-0.1, 0.1), 6 * np.sin(frame / 9)
            else:
                x, y = x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)
            if frame in (50, 51, 130):
                chain += 1
            places[frame] = (float(x), float(y), 0.0)
            chains.setdefault(chain, set()).add(frame)
            rows.append((run, chain, frame, *places[frame]))
        for members in chains.values():
            want |= {(run, f): v for f, v in walked_back(members, places, 5, distance=4.0).items()}
            counted |= {(run, f): v for f, v in walked_back(members, places, 5, n=12).items()}
    frames = spark.createDataFrame(rows, "run int, chain int, frame int, tx double, ty double, tz double")
    got = {(r["run"], r["frame"]): (r["from_frame"], r["frames"], r["reason"]) for r in win.history_span(frames, ["run"], distance=4.0).collect()}
    assert got == want and len({v[2] for v in want.values()}) == 3
    got = {(r["run"], r["frame"]): (r["from_frame"], r["frames"], r["reason"]) for r in win.history_span(frames, ["run"], n=12).collect()}
    assert got == counted and len({v[2] for v in counted.values()}) == 3
    assert win.history_span(frames.limit(0), ["run"], distance=4.0).collect() == []
