"""The march against a plain Python search, and its rules on small scenes."""

import math
import random

import numpy as np
import pytest

from swathe.plans import march as ma

TEMPLATE = [(0, 0.0, 0.0), (1, 0.012, 0.008), (2, 0.024, 0.016), (3, 0.036, 0.024), (4, 0.09, 0.03), (5, 0.11, 0.0), (6, 0.05, 0.05), (7, 0.0, 0.06)]


def rail(rng, lo, hi, n, course=lambda u: (0.0, 0.0), noise=0.004, age=3):
    out = []
    for _ in range(n):
        u, (_, v, w) = round(rng.uniform(lo, hi), 3), rng.choice(TEMPLATE)
        a, b = course(u)
        out.append((u, round(v + a + rng.uniform(-noise, noise), 5), round(w + b + rng.uniform(-noise, noise), 5), rng.randrange(age)))
    return out


def frames(spark, scenes, gates=""):
    points = [(run, i, age, u, v, w) for run, rows in scenes.items() for i, (u, v, w, age) in enumerate(rows)]
    return spark.createDataFrame(points, "run int, id long, age int, u double, v double, w double"), spark.createDataFrame([(r, 0.0, 0.0, 0.0) for r in scenes], "run int, u double, v double, w double"), spark.createDataFrame(TEMPLATE, "cell int, v double, w double")


def slope(anchors, i):
    a = anchors[-3:]
    u, x = [p[0] for p in a], [p[i] for p in a]
    mu, mx = sum(u) / len(a), sum(x) / len(a)
    down = sum((p - mu) ** 2 for p in u)
    return sum((p - mu) * (q - mx) for p, q in zip(u, x, strict=True)) / down if down else 0.0


def search(points, gates=None):
    """(chain of (parent, step, gap, n, anchor), reason) of the best branch, one branch after the other."""
    g = {**ma.MARCH, **ma.GATES, **(gates or {})}
    tv, tw = np.array([t[1] for t in TEMPLATE]), np.array([t[2] for t in TEMPLATE])
    pts = np.array([p[:3] for p in points])
    ages = np.array([p[3] for p in points])
    m = round(g["gate"] / g["grid"])
    grid = [(i * g["grid"], j * g["grid"]) for i in range(-m, m + 1) for j in range(-m, m + 1)]

    def distance(v, w):
        d = np.hypot(v[:, None] - tv, w[:, None] - tw)
        return np.minimum(d.min(axis=1), g["cap"]), d.argmin(axis=1)

    live = [dict(block=0, parent=None, step=0, gap=0, n=0, su=0.0, score=0.0, pending=0, turn=0.0, s=(0.0, 0.0), anchors=[(0.0, 0.0, 0.0, 2)], support=None, far=0.0, trail=[])]
    ended = []
    for k in range(1, g["rounds"] + 1):
        children = []
        for b in live:
            au, av, aw = b["anchors"][-1][:3]
            rv, rw = pts[:, 1] - (av + b["s"][0] * (pts[:, 0] - au)), pts[:, 2] - (aw + b["s"][1] * (pts[:, 0] - au))
            for gap in range(g["retries"] + 1):
                u0 = b["su"] + g["step"] * (gap + 1)
                own = (pts[:, 0] >= u0) & (pts[:, 0] > b["su"] + g["window"] + 1e-8) & (pts[:, 0] <= u0 + g["window"])
                own &= (rv >= tv.min() - g["margin"]) & (rv <= tv.max() + g["margin"]) & (rw >= tw.min() - g["margin"]) & (rw <= tw.max() + g["margin"])
                if own.sum() >= g["min_points"]:
                    break
            else:
                ended.append({**b, "reason": "NO_POINTS"})
                continue
            own = np.flatnonzero(own)
            old = np.array([i for i in (b["support"] if b["support"] is not None and not b["pending"] else []) if pts[i, 0] >= u0], int)
            cells, overlaps = [], False
            for ov, ow in grid:
                d, cell = distance(rv[own] - ov, rw[own] - ow)
                inside = (rv[own] - ov >= tv.min()) & (rv[own] - ov <= tv.max()) & (rw[own] - ow >= tw.min()) & (rw[own] - ow <= tw.max())
                held = inside & (d <= g["support"])
                od = distance(rv[old] - ov, rw[old] - ow)[0]
                p90 = float(np.percentile(od, 90)) if len(od) else None
                fits = p90 is None or p90 <= g["overlap"] or (p90 <= g["overlap_weak"] and math.sqrt((np.minimum(od, 0.06) ** 2).mean()) <= g["overlap_rms"])
                overlaps |= fits
                if held.sum() < g["min_points"]:
                    continue
                ds = np.sort(d[inside])
                shape = float(ds[: max(1, int(0.7 * len(ds)))].mean())
                templ = round(math.exp(-shape / 0.02) + 0.1 * (1 - math.exp(-held.sum() / 8)), 9)
                us = pts[own[held], 0]
                cells.append((-templ, round(math.hypot(ov, ow), 9), ov, ow, int(held.sum()), shape, p90, fits, len(set(ages[own[held]])), len({x // 4 for x in cell[held]}), float(np.median(us)), float(us.max()), own[held]))
            best = []
            for x in sorted(cells, key=lambda x: x[:4]):
                if len(best) < 3 and not any(math.hypot(x[2] - y[2], x[3] - y[3]) <= g["apart"] for y in best):
                    best.append(x)
            found = []
            for rank, x in enumerate(best):
                rest = [-y[0] for y in best if y[0] != x[0]]
                lead = -x[0] - max(rest) if rest else 1.0
                if not (overlaps and x[5] <= g["shape"] and x[1] <= g["gate"] * 1.42 and lead >= g["lead"] and x[7] and (x[6] or 0) <= g["overlap_most"]):
                    continue
                a = (x[10], av + b["s"][0] * (x[10] - au) + x[2], aw + b["s"][1] * (x[10] - au) + x[3], 1)
                trail = [p for p in b["anchors"] if p[3] == 2][-3:] + [p for p in b["anchors"] if p[3] == 1] + [a]
                waiting, sure = b["pending"] + 1, False
                if waiting >= 2 and len(trail) >= 3 and max(p[0] for p in trail) - min(p[0] for p in trail) >= 2:
                    u = np.array([p[0] for p in trail]) - trail[0][0]
                    miss = [np.array([p[i] for p in trail]) - np.polyval(np.polyfit(u, [p[i] for p in trail], 2), u) for i in (1, 2)]
                    sure = float(np.hypot(*miss).max()) <= g["fit"]
                if sure:
                    trail = [(*p[:3], 2) for p in trail]
                s = slope(trail, 1), slope(trail, 2)
                cos = (1 + b["s"][0] * s[0] + b["s"][1] * s[1]) / math.sqrt((1 + b["s"][0] ** 2 + b["s"][1] ** 2) * (1 + s[0] ** 2 + s[1] ** 2))
                gain = (math.exp(-x[5] / 0.02) + math.exp(-x[1] / g["gate"]) + math.exp(-b["turn"] / 3) + 1 + min(1, x[8] / 3) + min(1, x[9] / 4)) / 6 - 0.3 * max(0, 0.05 - lead) / 0.05
                pending = 0 if sure else waiting
                child = dict(parent=b["block"], rank=rank, step=k, gap=gap, n=x[4], su=u0, score=round(b["score"] + gain - (0 if sure else 0.4), 9), pending=pending, turn=math.degrees(math.acos(min(1, cos))), s=s, anchors=trail, support=x[12], far=max(b["far"], x[11]), trail=[*b["trail"], b])
                child["reason"] = "TENTATIVE_UNCONFIRMED" if pending > g["pending"] else "ORIENTATION_JUMP" if child["turn"] > g["turn"] else "RANGE_LIMIT" if child["far"] >= g["reach"] else None
                found.append(child)
            if not found:
                ended.append({**b, "reason": "TOO_FEW_SUPPORT" if not best else "OVERLAP_FIRST" if not overlaps else "CANDIDATES_REJECTED"})
            children += found
        children.sort(key=lambda x: (-x["score"], x["parent"], x["rank"]))
        live = []
        for i, x in enumerate(children):
            x["block"] = 16 * k + i
            if x["reason"]:
                ended.append(x)
            elif len(live) < 3 and not any(math.dist(x["anchors"][-1][:3], y["anchors"][-1][:3]) < g["same"] for y in live):
                live.append(x)
        if not live:
            break
    ended += [{**x, "reason": "RANGE_LIMIT"} for x in live]
    best = max(ended, key=lambda x: (x["score"], x["far"], -x["block"]))
    return [(x["step"], x["block"], x["parent"], x["gap"], x["n"], *(round(v, 6) for v in x["anchors"][-1][:3])) for x in [*best["trail"], best]], best["reason"], round(best["score"], 6)


def found(out):
    rows = {}
    for r in sorted(out.collect(), key=lambda r: r["step"]):
        rows.setdefault(r["run"], []).append(r)
    return {run: ([(r["step"], r["block"], r["parent"], r["gap"], r["n"], *(round(r[a], 6) for a in "uvw")) for r in rs], rs[0]["reason"], round(rs[0]["score"], 6)) for run, rs in rows.items()}


def test_march_equals_a_plain_search(spark):
    rng = random.Random(4)
    bend = lambda u: (0.0003 * u * u, 0.001 * u)
    scenes = {
        0: rail(rng, 8, 30, 220, bend),
        1: [p for p in rail(rng, 8, 34, 260) if not 12.01 < p[0] < 21],  # an empty strip, crossed by the next window
        2: rail(rng, 8, 24, 120) + rail(rng, 12.5, 24, 110, lambda u: (0.07, 0.05)),  # two rails side by side
        3: rail(rng, 8, 16, 60) + rail(rng, 16, 28, 90, lambda u: (0.06, 0.0)),  # a jump that the overlap refuses
        4: [(rng.uniform(8, 20), rng.uniform(-0.1, 0.2), rng.uniform(-0.1, 0.2), 0) for _ in range(40)],  # clutter
        5: [(50.0, 0.0, 0.0, 0)],
    }
    points, starts, template = frames(spark, scenes)
    out = ma.march_corridor(points, starts, template, ["run"])
    got, want = found(out), {run: search(rows) for run, rows in scenes.items()}
    assert got == want
    assert any(x[3] for x in got[1][0]) and len(got[0][0]) > 3 and got[5] == ([(0, 0, None, 0, 0, 0.0, 0.0, 0.0)], "NO_POINTS", 0.0)


def test_configurations_are_columns_of_the_starts(spark):
    rng = random.Random(9)
    scenes = {0: rail(rng, 8, 22, 120, noise=0.012), 1: rail(rng, 8, 18, 90)}
    points, starts, template = frames(spark, scenes)
    gates = {"loose": dict(min_points=3, shape=0.04), "strict": dict(min_points=40, shape=0.04), "exact": dict(min_points=3, shape=0.004)}
    each = spark.createDataFrame([(name, float(x["min_points"]), x["shape"]) for name, x in gates.items()], "config string, min_points double, shape double")
    out = ma.march_corridor(points, starts.crossJoin(each), template, ["run"], by=["config"])
    for name, x in gates.items():
        assert found(out.where(f"config = '{name}'")) == {run: search(rows, x) for run, rows in scenes.items()}


@pytest.mark.parametrize("bent", [0.0, 0.4])
def test_misfit_of_a_quadratic(spark, bent):
    a = [(4.0 * i, 0.1 * i * i + (bent if i == 2 else 0), 0.3 * i, 2) for i in range(5)]
    got = ma._with_misfit(spark.createDataFrame([(a,)], f"a array<{ma.ANCHOR}>"), "a").first()["misfit"]
    u = [x[0] for x in a]
    want = max(math.hypot(*(x[i] - np.polyval(np.polyfit(u, [y[i] for y in a], 2), x[0]) for i in (1, 2))) for x in a)
    assert got == pytest.approx(want, abs=1e-9)
