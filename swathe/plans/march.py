"""Step-by-step continuation of a profile along the track: a start's points come in order and its whole search runs in one task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.numeric import is_finite
from ..operators.joins import offset_grid, shifted, template_distance
from ..session import cut

c = F.col

# Step, window, offsets, beam and the gates of the march.
MARCH = dict(step=4.0, window=8.0, gate=0.08, grid=0.02, beam=3, rounds=40, retries=2, margin=0.14, cap=0.1, apart=0.04, same=0.008, reach=128.0, pending=2, turn=5.0)
#: Gates that a start may carry as columns of its own, one configuration each.
GATES = dict(support=0.02, min_points=3, shape=0.04, lead=0.01, overlap=0.03, overlap_weak=0.05, overlap_rms=0.04, overlap_most=0.08, fit=0.05)
ANCHOR = "struct<u:double,v:double,w:double,state:int>"
TOLD = "step int, block long, parent long, state int, gap int, n long, residual double, overlap_p90 double, su double, u double, v double, w double, score double, reason string"
STARTS_A_TASK = 8


def _slope(anchors: list[tuple], axis: int) -> float:
    """Least-squares slope of one axis over the last three anchors."""
    last = anchors[-3:]
    mu, mx = (sum(a[i] for a in last) / len(last) for i in (0, axis))
    up = sum((a[0] - mu) * (a[axis] - mx) for a in last)
    down = sum((a[0] - mu) * (a[0] - mu) for a in last)
    return up / down if down > 0 else 0.0


def misfit(anchors: list[tuple]) -> float:
    """The largest distance of the few anchors from the quadratics v(u) and w(u) that fit them best."""
    first = anchors[0][0]
    width = max(1.0, *(abs(a[0] - first) for a in anchors))
    at = [((a[0] - first) / width, a[1], a[2]) for a in anchors]
    power = [sum(x[0] ** k for x in at) for k in range(5)]
    left = [[power[i + j] for j in range(3)] for i in range(3)]
    det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    whole = det(left)
    if abs(whole) <= 1e-13:
        return math.inf
    fits = []
    for axis in (1, 2):
        right = [sum(x[0] ** k * x[axis] for x in at) for k in range(3)]
        fits.append([det([[right[i] if q == j else left[i][q] for q in range(3)] for i in range(3)]) for j in range(3)])
    missed = lambda x, axis: x[axis] - (fits[axis - 1][0] + fits[axis - 1][1] * x[0] + fits[axis - 1][2] * x[0] * x[0]) / whole
    return max(math.hypot(missed(x, 1), missed(x, 2)) for x in at)


def _with_misfit(df: DataFrame, anchors: str) -> DataFrame:
    """``misfit`` of a column of anchors."""
    return df.withColumn("misfit", F.udf(lambda rows: float(misfit([tuple(x) for x in rows])), "double")(anchors))


def _turn(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Angle in degrees between the directions (1, a) and (1, b)."""
    size = math.sqrt((1 + a[0] * a[0] + a[1] * a[1]) * (1 + b[0] * b[0] + b[1] * b[1]))
    return math.degrees(math.acos(min(1.0, (1 + a[0] * b[0] + a[1] * b[1]) / size)))


def _percentile(columns: np.ndarray, q: float) -> np.ndarray:
    """Of each sorted column, weighed as Spark's ``percentile`` does."""
    at = (len(columns) - 1) * q
    lo, hi = columns[math.floor(at)], columns[math.ceil(at)]
    return np.where(lo == hi, lo, (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi)


class Profile:
    """The template's places, and per square of a fine grid those that can be the nearest to a point in it."""

    SQUARES = 64

    def __init__(self, cell: list[int], v: list[float], w: list[float], cap: float):
        order = np.argsort(np.asarray(cell), kind="stable")  # of equal distances the lower cell's wins
        self.cell, self.cap = np.append(np.asarray(cell)[order], -1), cap
        at = [np.asarray(x, float)[order] for x in (v, w)]
        self.box = [(x.min(), x.max()) for x in at]
        self.low = [x.min() - cap for x in at]
        self.size = [(x.max() - x.min() + 2 * cap) / self.SQUARES for x in at]
        side = [low + (np.arange(self.SQUARES) + 0.5) * size for low, size in zip(self.low, self.size)]
        near = []
        for x in side[0]:
            d = np.hypot(x - at[0], side[1][:, None] - at[1])
            near += [np.flatnonzero(row) for row in d <= d.min(axis=1, keepdims=True) + math.hypot(*self.size) + 1e-9]
        self.near = np.full((len(near), max(map(len, near))), len(order))
        for i, row in enumerate(near):
            self.near[i, : len(row)] = row
        self.at = [np.append(x, np.inf) for x in at]

    def distance(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each point to the nearest place, ``cap`` at most, and that place's cell (-1 beyond the cap)."""
        d, cell = np.full(len(v), self.cap), np.full(len(v), -1)
        i, j = (np.floor((x - low) / size) for x, low, size in zip((v, w), self.low, self.size))
        here = np.flatnonzero((i >= 0) & (i < self.SQUARES) & (j >= 0) & (j < self.SQUARES))
        near = self.near[(i[here] * self.SQUARES + j[here]).astype(np.int64)]
        dv, dw = v[here, None] - self.at[0][near], w[here, None] - self.at[1][near]
        far = np.sqrt(dv * dv + dw * dw)
        best = far.argmin(axis=1)
        far = far[np.arange(len(here)), best]
        ok = far <= self.cap
        d[here[ok]], cell[here[ok]] = far[ok], self.cell[near[np.arange(len(here)), best][ok]]
        return d, cell


class March:
    """The search of one start. Points come ordered by u, as columns u, v, w, age and whether they repeat the row before."""

    def __init__(self, own: tuple, at: tuple[float, float, float], gates: dict, profile: Profile, g: dict):
        self.own, self.g, self.profile, self.k, self.ended = own, {**g, **gates}, profile, 0, []
        steps = round(g["gate"] / g["grid"])
        self.offsets = np.array([(i * g["grid"], j * g["grid"]) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1)])
        self.live = [dict(block=0, up=None, step=0, gap=0, n=0, residual=None, p90=None, su=at[0], score=0.0, pending=0, turn=0.0, s=(0.0, 0.0), anchors=[(*at, 2)], support=None, far=at[0])]

    def needs(self) -> float:
        """Points up to here decide the next round."""
        return max(b["su"] for b in self.live) + self.g["step"] * (self.g["retries"] + 1) + self.g["window"]

    def behind(self) -> float:
        """Points up to here are not read again."""
        return min(b["su"] for b in self.live) + self.g["window"]

    def _strip(self, b: dict, points: list[np.ndarray]):
        """New points of a branch's next strip; if too few are there, of the first of the strips behind it that has enough."""
        g, (u, v, w, _, again) = self.g, points
        _, av, aw, _ = b["anchors"][-1]
        for gap in range(g["retries"] + 1):
            u0 = b["su"] + g["step"] * (gap + 1)
            own = np.arange(max(np.searchsorted(u, u0, "left"), np.searchsorted(u, b["su"] + g["window"] + 1e-8, "right")), np.searchsorted(u, u0 + g["window"], "right"))
            rv, rw = self._relative(b, u[own], v[own], w[own])
            m, ((v0, v1), (w0, w1)) = g["margin"], self.profile.box
            near = (rv >= v0 - m) & (rv <= v1 + m) & (rw >= w0 - m) & (rw <= w1 + m)
            if near.sum() >= g["min_points"] and near.any():
                near &= ~again[own]
                return gap, u0, own[near], rv[near], rw[near]
        return None

    @staticmethod
    def _relative(b: dict, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """v and w less the branch's course at their u."""
        au, av, aw, _ = b["anchors"][-1]
        return v - (av + b["s"][0] * (u - au)), w - (aw + b["s"][1] * (u - au))

    def _scored(self, b: dict, points: list[np.ndarray], strip) -> tuple[list[dict], bool]:
        """The up to three best offsets that lie apart, and whether the branch's confirmed support fits under any."""
        g, ((v0, v1), (w0, w1)) = self.g, self.profile.box
        _, u0, own, rv, rw = strip
        ov, ow = self.offsets.T
        sv, sw = rv[:, None] - ov, rw[:, None] - ow
        # Only points that an offset brings into the template's box count for it.
        row, at = np.nonzero((sv >= v0) & (sv <= v1) & (sw >= w0) & (sw <= w1))
        d, cell = self.profile.distance(sv[row, at], sw[row, at])
        inside = np.bincount(at, minlength=len(ov))
        held = d <= g["support"]
        n = np.bincount(at[held], minlength=len(ov))
        sums = np.full(sv.shape, np.inf)
        sums[row, at] = d
        sums = np.cumsum(np.sort(sums, axis=0), axis=0)
        part = np.maximum(1, (inside * 0.7).astype(int))
        shape = np.where(inside > 0, sums[part - 1, np.arange(len(ov))] / part, 0.5)
        p90, fits = None, np.ones(len(ov), bool)
        if b["support"] is not None and not b["pending"]:
            old = [x[b["support"][0] >= u0] for x in b["support"]]
            if len(old[0]):
                qv, qw = self._relative(b, *old)
                od = np.sort(self.profile.distance((qv[:, None] - ov).ravel(), (qw[:, None] - ow).ravel())[0].reshape(-1, len(ov)), axis=0)
                p90 = _percentile(od, 0.9)
                fits = (p90 <= g["overlap"]) | ((p90 <= g["overlap_weak"]) & (np.sqrt((np.minimum(od, 0.06) ** 2).mean(axis=0)) <= g["overlap_rms"]))
        cells = []
        for i in np.flatnonzero(n >= g["min_points"]):
            templ = round(math.exp(-shape[i] / 0.02) + 0.1 * (1 - math.exp(-n[i] / 8.0)), 9)
            cells.append((-templ, round(math.hypot(ov[i], ow[i]), 9), float(ov[i]), float(ow[i]), int(i)))
        best = []
        for x in sorted(cells):
            if len(best) < g["beam"] and not any(math.hypot(x[2] - y[2], x[3] - y[3]) <= g["apart"] for y in best):
                best.append(x)
        out = []
        for o, off, dv, dw, i in best:
            mine = (at == i) & held
            who = own[row[mine]]
            u, age = points[0][who], points[3][who]
            out.append(dict(templ=-o, off=off, ov=dv, ow=dw, n=int(n[i]), shape=float(shape[i]), p90=None if p90 is None else float(p90[i]), fits=bool(fits[i]), ages=len(np.unique(age[age != 0])),
                            bins=len(np.unique(cell[mine] // 4)), u=float(_percentile(np.sort(u), 0.5)), far=float(u.max()), support=[points[a][who] for a in range(3)]))
        return out, bool(fits.any())

    def _children(self, b: dict, best: list[dict], strip) -> list[dict]:
        """Blocks that pass the gates, with the course, state and score of the branch that they end."""
        g, out = self.g, []
        au, av, aw, _ = b["anchors"][-1]
        for rank, x in enumerate(best):
            rest = [y["templ"] for y in best if y["templ"] != x["templ"]]
            lead = x["templ"] - max(rest) if rest else 1.0
            if not (x["shape"] <= g["shape"] and x["off"] <= g["gate"] * 1.42 and lead >= g["lead"] and x["fits"] and (x["p90"] or 0.0) <= g["overlap_most"]):
                continue
            a = (x["u"], av + b["s"][0] * (x["u"] - au) + x["ov"], aw + b["s"][1] * (x["u"] - au) + x["ow"], 1)
            trail = [p for p in b["anchors"] if p[3] == 2][-3:] + [p for p in b["anchors"] if p[3] == 1] + [a]
            waiting, us = b["pending"] + 1, [p[0] for p in trail]
            sure = waiting >= 2 and len(trail) >= 3 and max(us) - min(us) >= 2 and misfit(trail) <= g["fit"]
            anchors = [(*p[:3], 2) for p in trail] if sure else trail
            s = _slope(anchors, 1), _slope(anchors, 2)
            gain = (math.exp(-x["shape"] / 0.02) + math.exp(-x["off"] / g["gate"]) + math.exp(-b["turn"] / 3) + 1 + min(1.0, x["ages"] / 3.0) + min(1.0, x["bins"] / 4.0)) / 6 - 0.3 * max(0.0, 0.05 - lead) / 0.05
            child = dict(up=b, step=self.k, rank=rank, gap=strip[0], n=x["n"], residual=x["shape"], p90=x["p90"], su=strip[1], anchors=anchors, pending=0 if sure else waiting, s=s, turn=_turn(b["s"], s),
                         far=max(b["far"], x["far"]), support=x["support"], score=round(b["score"] + gain - (0.0 if sure else 0.4), 9))
            child["reason"] = "TENTATIVE_UNCONFIRMED" if child["pending"] > g["pending"] else "ORIENTATION_JUMP" if child["turn"] > g["turn"] else "RANGE_LIMIT" if child["far"] >= g["reach"] else None
            out.append(child)
        return out

    def advance(self, points: list[np.ndarray]) -> None:
        """One round: every live branch moves on by a strip, or ends."""
        g, children = self.g, []
        self.k += 1
        for b in self.live:
            found, why = [], "NO_POINTS"
            if strip := self._strip(b, points):
                best, overlaps = self._scored(b, points, strip)
                found = self._children(b, best, strip) if overlaps else []
                why = "TOO_FEW_SUPPORT" if not best else "CANDIDATES_REJECTED" if overlaps else "OVERLAP_FIRST"
            if not found:
                self.ended.append({**b, "reason": why})
            b["support"] = None
            children += found
        children.sort(key=lambda x: (-x["score"], x["up"]["block"], x["rank"]))
        for i, x in enumerate(children):
            x["block"] = 16 * self.k + i
        self.ended += [x for x in children if x["reason"]]
        self.live = []
        for x in children:  # the best open branches, one for each place
            if not x["reason"] and len(self.live) < g["beam"] and not any(math.dist(x["anchors"][-1][:3], y["anchors"][-1][:3]) < g["same"] for y in self.live):
                self.live.append(x)
        if self.k == g["rounds"]:
            self.ended += [{**x, "reason": "RANGE_LIMIT"} for x in self.live]
            self.live = []

    def told(self) -> list[tuple]:
        """The chain of the best end, from its start on; blocks behind the last confirmed one are tentative."""
        best = max(self.ended, key=lambda x: (x["score"], x["far"], -x["block"]))
        out, x = [], best
        while x:
            up = x["up"]
            out.append((x["step"], x["block"], up and up["block"], 1 if x["step"] > best["step"] - best["pending"] else 2, x["gap"], x["n"], x["residual"], x["p90"], x["su"], *x["anchors"][-1][:3], best["score"], best["reason"]))
            x = up
        return [(*self.own, *row) for row in reversed(out)]


def _marched(keys: list[str], template: tuple, g: dict, gates: list[str], by: list[str], out: pa.Schema):
    """Rows sorted by key, a key's starts before its points, these by u: only what live branches may still read is held."""
    def run(batches):
        profile = Profile(*template, g["cap"])
        last, marches, held, rows = None, [], None, []
        empty = lambda: [np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)]

        def follow(upto: float) -> None:
            nonlocal marches, held, rows
            going = []
            for m in marches:
                while m.live and m.needs() < upto:
                    m.advance(held)
                if m.live:
                    going.append(m)
                else:
                    rows += m.told()
            marches = going
            if going:
                keep = np.searchsorted(held[0], min(m.behind() for m in going), "right")
                held = [x[keep:] for x in held]

        for batch in batches:
            if not len(batch):
                continue
            names = batch.schema.names
            new, same = np.zeros(len(batch), bool), np.ones(len(batch), bool)
            for k in keys:
                x = batch.column(names.index(k))
                new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
            first = tuple(batch.column(names.index(k))[0].as_py() for k in keys)
            new[0] = last is None or first != last[0]
            u, v, w, age, id_, kind = (batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in ("u", "v", "w", "__age", "__id", "__kind"))
            for x, old in zip((u, v, w, age, id_, kind), last[1] if last else [None] * 6):
                same[1:] &= x[1:] == x[:-1]
                same[0] &= old is not None and bool(x[0] == old)
            again = same & ~new
            last = tuple(batch.column(names.index(k))[len(batch) - 1].as_py() for k in keys), [x[-1] for x in (u, v, w, age, id_, kind)]
            bounds = [*np.flatnonzero(new), len(batch)]
            bounds = bounds if bounds[0] == 0 else [0, *bounds]
            for lo, hi in zip(bounds, bounds[1:]):
                if new[lo]:
                    follow(math.inf)
                    marches, held = [], empty()
                points = lo + int((kind[lo:hi] == 0).sum())
                if points > lo:
                    starts = batch.column(names.index("__start")).slice(lo, points - lo).to_pylist()
                    here = tuple(batch.column(names.index(k))[lo].as_py() for k in keys)
                    marches += [March((*here, *(s[b] for b in by)), (float(u[lo + i]), float(v[lo + i]), float(w[lo + i])), {n: s[n] for n in gates}, profile, g) for i, s in enumerate(starts)]
                if marches and points < hi:
                    held = [np.concatenate([a, x[points:hi]]) for a, x in zip(held, (u, v, w, age, again))]
                    follow(float(u[hi - 1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), out)], schema=out)
                rows = []
        follow(math.inf)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), out)], schema=out)

    return run


def march_corridor(points: DataFrame, starts: DataFrame, template: DataFrame, keys: list[str], cfg: dict | None = None, by: list[str] | None = None) -> DataFrame:
    """The best chain of blocks along each start's corridor, step 0 being the start, and why it ended.

    ``points``: keys, id, u (forward), v, w, and ``age`` if they come from
    several scans. ``starts``: keys and ``by``, which names several starts or
    configurations of one key; u, v, w of the last known anchor; any of
    ``GATES`` as a column holds for that start alone. ``points`` are voxelised,
    so a strip holds a bounded number of them. Points are moved once, to the one
    task that follows their key in the order of u; it holds the strips that a live branch
    may still read. Points with a null key or without finite u, v and w take no part.

    A round moves every live branch on by one strip of points beyond its
    window; of a strip with too few points the next two are tried, and nothing is invented
    between. Offsets of the template are scored on a grid; up to three that lie
    apart and pass the gates (support, shape, lead over the others, and
    the confirmed support of the branch under the same offset) become
    tentative children, each with a pointer to its parent. Two tentative blocks
    in a row are confirmed if a quadratic through their and the last confirmed
    anchors misses none by more than ``fit``. The course is the least-squares line through the last three
    anchors. The three best branches that end at different places go on.
    The result is read back from the best end by its parents.

    Returns keys, by, step, block, parent, state (2 confirmed, 1 tentative),
    gap, n, residual, overlap_p90, su (start of the window), u, v, w, score
    and reason: NO_POINTS, TOO_FEW_SUPPORT, OVERLAP_FIRST, CANDIDATES_REJECTED,
    TENTATIVE_UNCONFIRMED, ORIENTATION_JUMP or RANGE_LIMIT.
    """
    g = {**MARCH, **(cfg or {})}
    gates = {n: g.get(n, v) for n, v in GATES.items()}
    own, by = [*keys, *(by or [])], by or []
    # A profile's places, as many as it has cells: each task gets them all.
    places = template.where(is_finite(c("v").cast("double")) & is_finite(c("w").cast("double"))).groupBy("v", "w").agg(F.min("cell").alias("cell")).select(c("cell").cast("long"), c("v").cast("double"), c("w").cast("double")).toPandas()
    had = [c(n).cast("double").alias(n) if n in starts.columns else F.lit(float(v)).alias(n) for n, v in gates.items()]
    begin = starts.where(" and ".join(f"`{n}` is not null" for n in own))
    begin = cut(begin.select(*own, *[c(a).cast("double").alias(a) for a in "uvw"], *had), "march")
    whole = points.where(" and ".join(f"`{n}` is not null" for n in keys))
    age = F.when(c("age").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("age")) if "age" in points.columns else F.lit(1).cast("long")
    # No filter on places: it would take their formulas once more for each use. What is not finite sorts last, or lies in no box.
    place = [F.coalesce(c(a).cast("double"), F.lit(math.nan)).alias(a) for a in "uvw"]
    start = F.struct(*by, *gates)
    first = begin.select(*keys, F.lit(0).alias("__kind"), *place, F.lit(0).cast("long").alias("__age"), F.lit(0).cast("long").alias("__id"), start.alias("__start"))
    rest = whole.select(*keys, F.lit(1).alias("__kind"), *place, age.alias("__age"), F.xxhash64("id").alias("__id"), F.lit(None).cast(first.schema["__start"].dataType).alias("__start"))
    order = [*keys, "__kind", "u", "v", "w", "__age", "__id"]
    rows = first.unionByName(rest).repartition(max(1, -(-begin.count() // STARTS_A_TASK)), *keys).sortWithinPartitions(*order)
    shape = T.StructType(begin.select(*own).schema.fields + T.StructType.fromDDL(TOLD).fields)
    nowhere = [-1], [math.nan], [math.nan]  # an empty template has no box, so no point lies in it
    run = _marched(keys, tuple(places[n].tolist() for n in ("cell", "v", "w")) if len(places) else nowhere, g, list(gates), by, to_arrow_schema(shape))
    return cut(rows.mapInArrow(run, shape), "march")


def visibility_likelihood(points: DataFrame, template: DataFrame, keys: list[str], source: str, half: float = 0.08, step: float = 0.02, apart: float = 0.03, temperature: float = 0.05) -> DataFrame:
    """Modes of a placement: robust cost per offset, averaged per source first so no source outvotes another.

    ``points``: keys, source, id, v, w. Returns the modes that are ``apart``,
    their weight, and the spread of the weights around the mean. Points that no
    offset can bring within the cap of the template cost the same everywhere and are left out.
    """
    from ..operators.graph import greedy_select

    cap = 0.1
    far = half + cap
    box = template.agg(*[f(n).alias(f"__{f.__name__}_{n}") for n in ("v", "w") for f in (F.min, F.max)])  # one row
    near = [c(n).between(c(f"__min_{n}") - far, c(f"__max_{n}") + far) for n in ("v", "w")]
    points = points.select(*keys, source, "id", "v", "w").join(F.broadcast(box), near[0] & near[1]).select(*keys, source, "id", "v", "w").distinct()
    d = template_distance(shifted(points, offset_grid(points.sparkSession, half, step)), template, [*keys, source, "id", "ov", "ow"], cap=cap)
    cost = F.log1p((c("d") / 0.015) * (c("d") / 0.015))
    per = d.groupBy(*keys, source, "ov", "ow").agg(F.avg(cost).alias("cost"))
    g = cut(per.groupBy(*keys, "ov", "ow").agg(F.round(F.avg("cost"), 9).alias("cost"), F.count(F.lit(1)).alias("sources")), "likelihood")
    best = g.groupBy(*keys).agg(F.min("cost").alias("__b"))
    g = g.join(best, keys).withColumn("weight", F.exp(-(c("cost") - c("__b")) / temperature))
    m = g.groupBy(*keys).agg((F.sum(c("weight") * c("ov")) / F.sum("weight")).alias("mv"), (F.sum(c("weight") * c("ow")) / F.sum("weight")).alias("mw"))
    spread = g.join(m, keys).groupBy(*keys).agg((F.sum(c("weight") * (c("ov") - c("mv")) ** 2) / F.sum("weight")).alias("var_v"), (F.sum(c("weight") * (c("ow") - c("mw")) ** 2) / F.sum("weight")).alias("var_w"))
    o = g.where("weight > 0.1").select(*keys, "cost", "ov", "ow", c("ov").alias("x"), c("ow").alias("y"), F.lit(0.0).alias("z"))
    modes = greedy_select(o, keys, ["cost", "ov", "ow"], apart, strict=True).select(*keys, "cost", "ov", "ow")
    return modes.join(spread, keys)
