"""Paths: arc length, interpolation, extension, support and cross sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import add, cross, dot, named, norm, scale, sub, unit, vec
from .envelope import path_segments
from .ordered import blocked_scan

c = F.col


def arc_length(path: DataFrame, keys: list[str], names=("x", "y", "z"), order: str = "k") -> DataFrame:
    """Distance along a polyline as ``arc_m``, from 0 at the first vertex."""
    step = blocked_scan(path, keys, order, {f"__p{i}": ("lag", c(n)) for i, n in enumerate(names)})
    d = norm(tuple(c(n) - c(f"__p{i}") for i, n in enumerate(names)))
    step = step.withColumn("__d", F.coalesce(d, F.lit(0.0)))
    out = blocked_scan(step, keys, order, {"arc_m": ("sum", c("__d"))})
    return out.drop("__d", *[f"__p{i}" for i in range(len(names))])


def cross_section(points: DataFrame, path: DataFrame, distance: float, thickness: float = 1.0, keys=("run",)) -> DataFrame:
    """Returns in a slice across each path at ``distance``: lateral v, height h and the hit flag."""
    keys = list(keys)
    seg = path_segments(path, keys)
    seg = blocked_scan(seg, keys, "k", {"__s1": ("sum", c("len"))})
    seg = seg.where((c("__s1") - c("len") <= distance) & (distance < c("__s1")))
    seg = seg.withColumn("__t", distance - (c("__s1") - c("len")))
    seg = seg.select(*keys, *named(add(vec("c"), scale(vec("f"), c("__t"))), "o"), *[p + a for p in "fqu" for a in "xyz"])
    j = points.join(seg, keys)
    d = sub(vec("x", "y", "z"), vec("o"))
    j = j.withColumns({"v": dot(d, vec("q")), "along": dot(d, vec("f")), "h": dot(d, vec("u"))})
    j = j.where((F.abs("along") <= thickness / 2) & (F.abs("v") <= 5) & (c("h") >= -1) & (c("h") <= 5))
    return j.withColumn("hit", (F.abs("v") < 1.02) & (c("h") > 0.10) & (c("h") < 2.97))


def section_intersections(stations: DataFrame, reference: DataFrame, keys: list[str], reach: float = 5.0, pair_gap: float = 0.8) -> DataFrame:
    """Where both reference rails cross the plane through each station (o) normal to its tangent (tg).

    A crossing lies within ``reach`` plus half a gauge of the station, so
    stations and rail segments meet in cells of that size. ``forward`` is
    false where the chosen station falls back by more than 1 m.
    """
    from ..functions.cells import CELL, cell_of, explode_neighbours
    from .joins import polyline

    size = reach + 1.5
    rails = reference.select(*keys, "k", F.lit("L").alias("side"), "s", *[c("l" + a).alias("v" + a) for a in "xyz"]).unionByName(
        reference.select(*keys, "k", F.lit("R").alias("side"), "s", *[c("r" + a).alias("v" + a) for a in "xyz"]))
    seg = polyline(rails, [*keys, "side"], ["s", "vx", "vy", "vz"]).drop("k")
    step = norm(sub(tuple(c(f"v{a}_1") for a in "xyz"), vec("v")))
    seg = seg.where((c("s_1") - c("s") <= 1.0) & (step < 1.5)).select("*", *cell_of(vec("v"), size))
    st = explode_neighbours(stations.select("*", *cell_of(vec("o"), size)), 1)
    j = st.join(seg, [*keys, *CELL])
    tg = vec("tg")
    j = j.withColumns({"u0": dot(sub(vec("v"), vec("o")), tg), "u1": dot(sub(tuple(c(f"v{a}_1") for a in "xyz"), vec("o")), tg)})
    j = j.where((c("u0") * c("u1") <= 0) & (F.abs(c("u1") - c("u0")) > 1e-5))
    t = -c("u0") / (c("u1") - c("u0"))
    j = j.withColumn("t", t)
    ids = [*keys, "k", "ox", "oy", "oz"]
    roots = j.select(*ids, "side", (c("s") + c("t") * (c("s_1") - c("s"))).alias("station"), *[(c("v" + a) + c("t") * (c(f"v{a}_1") - c("v" + a))).alias("p" + a) for a in "xyz"])
    a = roots.where("side = 'L'").select(*ids, c("station").alias("sl"), *[c("p" + x).alias("l" + x) for x in "xyz"])
    b = roots.where("side = 'R'").select(*keys, "k", c("station").alias("sr"), *[c("p" + x).alias("r" + x) for x in "xyz"])
    pairs = a.join(b, [*keys, "k"]).where(F.abs(c("sl") - c("sr")) <= pair_gap)
    mid = tuple((c("l" + x) + c("r" + x)) / 2 for x in "xyz")
    pairs = pairs.withColumn("dist", norm(sub(mid, vec("o")))).where(c("dist") < reach)
    best = pairs.groupBy(*keys, "k").agg(F.min(F.struct("dist", "sl", "sr", *[p + x for p in "lr" for x in "xyz"])).alias("m"))
    best = best.select(*keys, "k", ((c("m.sl") + c("m.sr")) / 2).alias("station"), "m.*").drop("dist", "sl", "sr")
    back = blocked_scan(best, keys, "k", {"__p": ("lag", c("station"))})
    return back.withColumn("forward", F.coalesce(c("station") >= c("__p") - 1, F.lit(True))).drop("__p")


def assign_stations(points: DataFrame, curve: DataFrame, keys: list[str], source: str, id_: str, init: str, max_d: float, window: float = 8.0) -> DataFrame:
    """Nearest station within ``window`` of the initial one (else the nearest of all within
    ``max_d``), then made non-decreasing per source in initial order."""
    from .joins import nearest_segment

    ids = [source, id_]
    near = nearest_segment(points, curve, keys, ids, max_d, max_gap=1e9, max_len=5.0, max_excess=1e9, extra=[init], window=(init, window))
    return blocked_scan(near, [*keys, source], init, {"__m": ("max", c("station"))}, block=64, ties=[id_]).drop("station").withColumnRenamed("__m", "station")


def extend_linear(curve: DataFrame, keys: list[str], length: float = 5.0, tail: float = 3.0, spacing: float = 0.1, order: str = "k") -> DataFrame:
    """Append vertices along the least-squares direction of the last ``tail`` metres.

    The original vertices stay as they are; new ones are marked ``added``.
    """
    import math

    n = math.ceil(length / spacing)
    a = arc_length(curve, keys)
    a = blocked_scan(a, keys, order, {"__next": ("lead", c("arc_m"))})
    end = a.groupBy(*keys).agg(F.max("arc_m").alias("__end"))
    t = a.join(end, keys).where((c("arc_m") >= c("__end") - tail) | (c("__next") >= c("__end") - tail))
    u = c("arc_m") - c("__end")
    cov = lambda v: F.covar_pop(v, u)
    fit = t.groupBy(*keys).agg(
        F.max(order).alias("__k"), F.count(F.lit(1)).alias("__m"),
        *[F.max_by(x, order).alias("__" + x) for x in "xyz"], *[cov(c(x)).alias("d" + x) for x in "xyz"],
    ).where(c("__m") >= 3)
    fit = fit.withColumn("__n", norm(vec("d"))).where(c("__n") > 1e-12)
    step = length / n
    new = fit.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    new = new.select(*keys, (c("__k") + c("__i")).alias(order), *[(c("__" + x) + c("__i") * step * c("d" + x) / c("__n")).alias(x) for x in "xyz"], F.lit(True).alias("added"))
    return curve.select(*keys, order, "x", "y", "z", F.lit(False).alias("added")).unionByName(new)


def supported_prefix(points: DataFrame, path: DataFrame, keys: list[str], observed_k: int, section_m: float = 2.0, lateral: float = 0.055,
                     vertical: float = 0.03, min_points: int = 3, min_span: float = 0.5, min_cells: int = 3, cell: float = 0.03) -> DataFrame:
    """Evidence for each section past the observed end, and the prefix that may be accepted.

    Both heads need returns close to the interpolated rail, spread over cells
    and along the track. ``accepted`` ends at the first section that fails.
    """
    from .joins import interp_at

    ext = path.where(c("k") >= observed_k).withColumn("u", -(c("ly") + c("ry")) / 2)
    ends = ext.groupBy(*keys).agg(F.min("u").alias("__u0"), F.max("u").alias("__ue"))
    last = F.ceil((c("__ue") - c("__u0")) / section_m - 1e-9)
    sections = ends.where(c("__ue") > c("__u0")).withColumn("__n", last)
    p = points.join(sections, keys).withColumn("pu", -c("y")).where((c("pu") >= c("__u0")) & (c("pu") <= c("__ue")))
    # A return exactly on a border belongs to both sections.
    rel = (c("pu") - c("__u0")) / section_m
    lo, hi = F.greatest(F.ceil(rel - 1).cast("long"), F.lit(0)), F.least(F.floor(rel), c("__n") - 1)
    p = p.select(*keys, "pu", "x", "y", "z", lo.alias("__lo"), hi.alias("__hi"))
    p = interp_at(ext, p, keys, "u", ["lx", "lz", "rx", "rz"], "pu")
    side = F.array(F.struct(F.lit("L").alias("s"), c("lx").alias("hx"), c("lz").alias("hz")), F.struct(F.lit("R").alias("s"), c("rx").alias("hx"), c("rz").alias("hz")))
    p = p.withColumn("h", F.explode(side)).where((F.abs(c("x") - c("h.hx")) <= lateral) & (F.abs(c("z") - c("h.hz")) <= vertical))
    p = p.withColumn("section", F.explode(F.sequence("__lo", "__hi")))
    cells = F.struct(*[F.floor(c(a) / cell) for a in "xyz"])
    head = p.groupBy(*keys, "section", "h.s").agg(
        F.count(F.lit(1)).alias("n"), (F.max("y") - F.min("y")).alias("span"), F.countDistinct(cells).alias("cells"))
    good = head.where((c("n") >= min_points) & (c("span") >= min_span) & (c("cells") >= min_cells)).groupBy(*keys, "section").agg(F.count(F.lit(1)).alias("sides"))
    all_ = sections.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), c("__n") - 1)).alias("section"))
    out = all_.join(good, [*keys, "section"], "left").withColumn("ok", F.coalesce(c("sides") == 2, F.lit(False))).drop("sides")
    out = blocked_scan(out, keys, "section", {"__bad": ("sum", F.when(c("ok"), 0).otherwise(1).cast("long"))})
    return out.withColumn("accepted", c("__bad") == 0).drop("__bad")


def longest_run(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Longest stretch of adjacent occupied cells per key."""
    g = blocked_scan(cells, keys, cell, {"__r": ("sum", F.lit(1).cast("long"))})
    runs = g.groupBy(*keys, (c(cell) - c("__r")).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    return runs.groupBy(*keys).agg(F.max("__n").alias("longest"))


def unwrap(df: DataFrame, keys: list[str], angle: str, order: str = "k") -> DataFrame:
    """Remove jumps of whole turns along the order."""
    tau = 2 * F.pi()
    d = blocked_scan(df, keys, order, {"__p": ("lag", c(angle))})
    d = d.withColumn("__t", F.coalesce(F.round((c(angle) - c("__p")) / tau), F.lit(0.0)))
    d = blocked_scan(d, keys, order, {"__s": ("sum", c("__t"))})
    return d.withColumn("unwrapped", c(angle) - tau * c("__s")).drop("__p", "__t", "__s")


def gap_age(df: DataFrame, keys: list[str], s: str, order: str = "k") -> DataFrame:
    """Distance since the last supported station as ``gap_m``; 0 where supported.

    Equals the station minus the newest supported station, or minus the first station before any support.
    """
    first = df.groupBy(*keys).agg(F.min(s).alias("__first"))
    d = blocked_scan(df, keys, order, {"__sup": ("last", F.when(c("supported"), c(s)))}).join(first, keys)
    return d.withColumn("gap_m", c(s) - F.coalesce("__sup", "__first")).drop("__sup", "__first")


def continuous_reach(df: DataFrame, keys: list[str], step: str, tolerance: float, min_points: int = 3, min_evaluated: float = 0.8, min_share: float = 0.95) -> DataFrame:
    """Farthest range before the first step that has too few rows, too few scored or too few good ones."""
    good = F.avg(F.when(c("evaluable"), (c("error_m") <= tolerance).cast("double")))
    st = df.groupBy(*keys, step).agg(
        F.count(F.lit(1)).alias("n"), F.avg(c("evaluable").cast("double")).alias("ev"), good.alias("ok"), F.max("range_m").alias("far"))
    fine = (c("n") >= min_points) & (c("ev") >= min_evaluated) & (F.coalesce("ok", F.lit(0.0)) >= min_share)
    bad = st.where(~fine).groupBy(*keys).agg(F.min(step).alias("__stop"))
    j = st.join(bad, keys, "left")
    return j.groupBy(*keys).agg(F.coalesce(F.max(F.when(c("__stop").isNull() | (c(step) < c("__stop")), c("far"))), F.lit(0.0)).alias("reach_m"))


def gap_cluster(df: DataFrame, keys: list[str], value: str, id_: str, window: float) -> DataFrame:
    """Greedy windows along one axis: a group runs from its first value to ``window`` beyond it.

    The fold over a sorted curve is sequential by nature; it runs inside the engine on each
    curve's ordered values. A curve's stations are bounded by its length.
    """
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(c(value).alias("x"), c(id_).alias("i")))).alias("v"))
    fold = f"""aggregate(v, named_struct('start', CAST(NULL AS DOUBLE), 'grp', 0, 'out', CAST(array() AS array<struct<g:int,x:double>>)),
      (a, e) -> named_struct(
        'start', CASE WHEN a.start IS NULL OR e.x - a.start > {window} THEN e.x ELSE a.start END,
        'grp', CASE WHEN a.start IS NULL OR e.x - a.start > {window} THEN a.grp + 1 ELSE a.grp END,
        'out', concat(a.out, array(named_struct('g', CASE WHEN a.start IS NULL OR e.x - a.start > {window} THEN a.grp + 1 ELSE a.grp END, 'x', e.x)))),
      a -> a.out)"""
    out = rows.select(*keys, F.explode(F.expr(fold)).alias("r"))
    return out.groupBy(*keys, c("r.g").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg("r.x").alias("mean_x"))


def step_check(path: DataFrame, keys: list[str], names=("x", "y", "z"), order: str = "k") -> DataFrame:
    """Longest step, whether all steps are in (1e-6, 5], and whether the path always advances."""
    from .joins import polyline

    seg = polyline(path, keys, list(names), order)
    d = norm(tuple(c(n + "_1") - c(n) for n in names))
    seg = seg.withColumn("__d", d)
    return seg.groupBy(*keys).agg(
        F.max("__d").alias("longest_m"), F.bool_and((c("__d") > 1e-6) & (c("__d") <= 5)).alias("continuous"),
        F.bool_and(c(names[1] + "_1") - c(names[1]) < -1e-6).alias("forward"))


def remaining_horizon(positions: DataFrame, curve: DataFrame, keys: list[str], ids: list[str], max_d: float) -> DataFrame:
    """Path length left ahead of each position projected onto its path."""
    from .joins import nearest_segment

    near = nearest_segment(positions, curve, keys, ids, max_d, max_gap=1e9, max_len=5.0, max_excess=1e9)
    end = curve.groupBy(*keys).agg(F.max("s").alias("__end"))
    return near.join(end, keys).select(*keys, *ids, (c("__end") - c("station")).alias("horizon_m"))


def curvature(path: DataFrame, keys: list[str], names=("x", "y", "z"), order: str = "k") -> DataFrame:
    """Turn per metre between the steps before and after each inner vertex."""
    from .joins import polyline

    seg = polyline(path, keys, list(names), order)
    step = seg.select(*keys, order, *[(c(n + "_1") - c(n)).alias("b" + a) for n, a in zip(names, "xyz")])
    prev = step.select(*keys, (c(order) + 1).alias(order), *[c("b" + a).alias("a" + a) for a in "xyz"])
    j = step.join(prev, [*keys, order]).withColumns({"__a": norm(vec("a")), "__b": norm(vec("b"))})
    cosine = dot(vec("a"), vec("b")) / c("__a") / c("__b")
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return j.withColumn("curvature", 2 * turn / (c("__a") + c("__b")))


def max_spacing(df: DataFrame, keys: list[str], value: str, bin_m: float, bins: int) -> DataFrame:
    """Largest gap between sorted distinct values and the number of empty bins.

    Gaps inside a bin need only that bin; gaps across bins need each bin's ends.
    """
    d = df.select(*keys, value).distinct().withColumn("__b", F.floor(c(value) / bin_m))
    inner = blocked_scan(d, [*keys, "__b"], value, {"__p": ("lag", c(value))})
    inside = inner.groupBy(*keys, "__b").agg(F.max(c(value) - c("__p")).alias("gap"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    cross_ = blocked_scan(inside, keys, "__b", {"__ph": ("lag", c("hi"))})
    used = F.count_if((c("__b") >= 0) & (c("__b") < bins))
    return cross_.groupBy(*keys).agg(F.max(F.greatest("gap", c("lo") - c("__ph"))).alias("max_gap_m"), (F.lit(bins) - used).alias("empty_bins"))


def bishop_frames(path: DataFrame, keys: list[str], names, initial: tuple[float, float, float], order: str = "k") -> DataFrame:
    """Tangent and first cross axis carried along each path with no twist.

    Each step rotates the axis by the turn of the tangent, so the result at a
    vertex depends on all before it: an ordered fold inside the engine. The
    vertices of one path are bounded by its horizon.
    """
    from .joins import polyline

    seg = polyline(path, keys, list(names), order)
    step = seg.select(*keys, order, *[(c(n + "_1") - c(n)).alias("d" + a) for n, a in zip(names, "xyz")])
    t = step.select(*keys, order, *named(unit(vec("d")), "t"))
    rows = t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "tx", "ty", "tz"))).alias("v"))
    x, y, z = initial
    # Reflect-free transport: e' = e - (e.t')/(1 + t.t') (t + t'), exact for unit tangents and e normal to t.
    fold = f"""aggregate(v, named_struct('tx', element_at(v,1).tx, 'ty', element_at(v,1).ty, 'tz', element_at(v,1).tz,
      'ex', CAST({x} AS DOUBLE), 'ey', CAST({y} AS DOUBLE), 'ez', CAST({z} AS DOUBLE), 'out', CAST(array() AS array<struct<k:int,ex:double,ey:double,ez:double>>)),
      (a, s) -> named_struct('tx', s.tx, 'ty', s.ty, 'tz', s.tz,
        'ex', a.ex - (a.ex*s.tx+a.ey*s.ty+a.ez*s.tz)/(1+a.tx*s.tx+a.ty*s.ty+a.tz*s.tz)*(a.tx+s.tx),
        'ey', a.ey - (a.ex*s.tx+a.ey*s.ty+a.ez*s.tz)/(1+a.tx*s.tx+a.ty*s.ty+a.tz*s.tz)*(a.ty+s.ty),
        'ez', a.ez - (a.ex*s.tx+a.ey*s.ty+a.ez*s.tz)/(1+a.tx*s.tx+a.ty*s.ty+a.tz*s.tz)*(a.tz+s.tz),
        'out', concat(a.out, array(named_struct('k', s.{order},
          'ex', a.ex - (a.ex*s.tx+a.ey*s.ty+a.ez*s.tz)/(1+a.tx*s.tx+a.ty*s.ty+a.tz*s.tz)*(a.tx+s.tx),
          'ey', a.ey - (a.ex*s.tx+a.ey*s.ty+a.ez*s.tz)/(1+a.tx*s.tx+a.ty*s.ty+a.tz*s.tz)*(a.ty+s.ty),
          'ez', a.ez - (a.ex*s.tx+a.ey*s.ty+a.ez*s.tz)/(1+a.tx*s.tx+a.ty*s.ty+a.tz*s.tz)*(a.tz+s.tz))))),
      a -> a.out)"""
    e = rows.select(*keys, F.explode(F.expr(fold)).alias("r")).select(*keys, c("r.k").alias(order), c("r.ex").alias("px"), c("r.ey").alias("py"), c("r.ez").alias("pz"))
    j = t.join(e, [*keys, order])
    # The seed axis need not be normal to the first tangent: project and normalise at the end.
    j = j.select("*", *named(unit(sub(vec("p"), scale(vec("t"), dot(vec("p"), vec("t"))))), "e1"))
    return j.select("*", *named(cross(vec("t"), vec("e1")), "e2")).drop("px", "py", "pz")


def curve_physics(path: DataFrame, keys: list[str], names=("x", "y", "z"), order: str = "k") -> DataFrame:
    """Smallest radius, steepest grade, reversals and plan-view self-crossing of each path.

    Crossings come from segments that share a plan-view cell, never from all pairs.
    """
    from .joins import polyline

    seg = polyline(path, keys, list(names), order)
    d = {a: c(n + "_1") - c(n) for n, a in zip(names, "xyz")}
    flat = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"])
    step = seg.select(*keys, order, *[e.alias("b" + a) for a, e in d.items()], flat.alias("flat"))
    prev = step.select(*keys, (c(order) + 1).alias(order), *[c("b" + a).alias("a" + a) for a in "xy"])
    inner = step.join(prev, [*keys, order]).join(curvature(path, keys, names, order).select(*keys, order, "curvature"), [*keys, order])
    out = inner.groupBy(*keys).agg(
        (1 / F.greatest(F.max("curvature"), F.lit(1e-9))).alias("min_radius_m"), F.max(F.abs(c("bz") / c("flat"))).alias("max_grade"),
        F.count_if(c("ax") * c("bx") + c("ay") * c("by") < 0).alias("reversals"))
    size = 2.0
    x, y = names[0], names[1]
    lo = lambda n: F.floor(F.least(c(n), c(n + "_1")) / size)
    hi = lambda n: F.floor(F.greatest(c(n), c(n + "_1")) / size)
    g = seg.withColumn("gi", F.explode(F.sequence(lo(x), hi(x)))).withColumn("gj", F.explode(F.sequence(lo(y), hi(y))))
    a = g.select(*keys, "gi", "gj", c(order).alias("i"), c(x).alias("x0"), c(y).alias("y0"), c(x + "_1").alias("x1"), c(y + "_1").alias("y1"))
    b = g.select(*keys, "gi", "gj", c(order).alias("j"), c(x).alias("x2"), c(y).alias("y2"), c(x + "_1").alias("x3"), c(y + "_1").alias("y3"))
    side = lambda px, py, qx, qy, rx, ry: (c(qx) - c(px)) * (c(ry) - c(py)) - (c(qy) - c(py)) * (c(rx) - c(px))
    cut_ = (side("x0", "y0", "x1", "y1", "x2", "y2") * side("x0", "y0", "x1", "y1", "x3", "y3") < 0) & (
        side("x2", "y2", "x3", "y3", "x0", "y0") * side("x2", "y2", "x3", "y3", "x1", "y1") < 0)
    crossed = a.join(b, [*keys, "gi", "gj"]).where((c("j") >= c("i") + 2) & cut_).select(*keys).distinct().withColumn("self_crossing", F.lit(True))
    return out.join(crossed, keys, "left").withColumn("self_crossing", F.coalesce("self_crossing", F.lit(False)))


def _near_end(prior: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """Per path: the near end and its slope, and the prior's position and direction around it."""
    from .joins import interp_at

    sides = [p + a for p in "lr" for a in "xyz"]
    u = -(c("ly") + c("ry")) / 2
    end = near.groupBy(*keys).agg(F.max("k").alias("kn"), F.max_by(u, "k").alias("end"), *[F.max_by(n, "k").alias("e_" + n) for n in sides])
    back = near.join(end.select(*keys, (c("kn") - 2).alias("k")), [*keys, "k"]).select(*keys, u.alias("back"), *[c(n).alias("b_" + n) for n in sides])
    end = end.join(back, keys)
    pr = prior.select(*keys, "k", *sides, u.alias("u"))
    span = pr.groupBy(*keys).agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.count(F.lit(1)).alias("kp"))
    end = end.join(span, keys)
    reach = F.least(F.lit(1.0), (c("u1") - c("end")) / 2)
    q = end.withColumn("reach", reach)
    asks = F.array(F.struct(F.lit("a").alias("t"), c("end").alias("at")), F.struct(F.lit("p").alias("t"), (c("end") + c("reach")).alias("at")),
                   F.struct(F.lit("f").alias("t"), (c("end") + 1).alias("at")), F.struct(F.lit("g").alias("t"), (c("end") - 1).alias("at")))
    ask = q.select(*keys, F.explode(asks).alias("x")).select(*keys, "x.t", c("x.at").alias("at"))
    got = interp_at(pr, ask, keys, "u", sides, "at")
    wide = got.groupBy(*keys).agg(*[F.max(F.when(c("t") == t, c(n))).alias(f"{t}_{n}") for t in "apfg" for n in sides])
    return q.join(wide, keys)


def attach_near(prior: DataFrame, near: DataFrame, keys: list[str], transition: float = 4.0) -> DataFrame:
    """Near rails as prefix and the prior's tail bent onto them: value and slope meet at the near end and the far shape
    is unchanged past ``transition`` metres. The near rails always stay, with a status.

    A prior that is missing, has under three vertices, doesn't run forward or ends within .1 m of the near end adds no
    tail, nor does one whose join has a step outside 1e-6 .. 5 m or a coordinate that isn't finite. Near rails have three
    vertices at least; ``k`` numbers vertices without gaps; rails of both inputs are ordered left, right.
    """
    sides = [p + a for p in "lr" for a in "xyz"]
    u = -(c("ly") + c("ry")) / 2
    ends = _near_end(prior, near, keys)
    w = Window.partitionBy(*keys).orderBy("k")  # one path
    back = prior.select(*keys, (u - F.lag(u).over(w)).alias("__du")).where("__du <= 1e-6").select(*keys).distinct()
    e = ends.where((c("kp") >= 3) & (c("u1") > c("end") + 0.1)).join(back, keys, "left_anti")
    t = prior.select(*keys, "k", *sides, u.alias("u")).join(e, keys).where(c("u") > c("end") + 1e-6)
    length = F.least(F.lit(transition), c("u1") - c("end"))
    t = t.withColumn("L", length).withColumn("q", F.least(F.lit(1.0), (c("u") - c("end")) / c("L")))
    q = c("q")
    value, slope = 1 - 3 * q * q + 2 * q * q * q, c("L") * (q - 2 * q * q + q * q * q)

    def bent(n: str) -> Column:
        shift = c("e_" + n) - c("a_" + n)
        new = (c("e_" + n) - c("b_" + n)) / (c("end") - c("back"))
        old = (c("p_" + n) - c("a_" + n)) / c("reach")
        return (c(n) + value * shift + slope * (new - old)).alias(n)

    tail = t.select(*keys, "k", *[bent(n) for n in sides], F.lit(False).alias("near"))
    head = near.select(*keys, "k", *sides, F.lit(True).alias("near"))
    joined = head.join(e.select(*keys), keys, "left_semi").unionByName(tail)
    along = Window.partitionBy(*keys).orderBy(c("near").desc(), "k")  # one path
    centre = tuple((c("l" + a) + c("r" + a)) / 2 for a in "xyz")
    step = F.when(sum(centre).isNull(), float("nan")).otherwise(norm(tuple(m - F.lag(m).over(along) for m in centre)))
    step = joined.select(*keys, step.alias("d"))
    broken = step.where("d <= 1e-6 or d > 5 or isnan(d)").select(*keys).distinct()
    good = e.select(*keys).join(broken, keys, "left_anti").withColumn("status", F.lit("CURRENT_NEAR_WITH_BLENDED_TAIL"))
    state = good.unionByName(broken.withColumn("status", F.lit("NEAR_ONLY_INVALID_JOIN")))
    short = F.lit("NEAR_ONLY_SHORT_OR_NONMONOTONIC_PRIOR")
    return head.join(state, keys, "left").withColumn("status", F.coalesce("status", short)).unionByName(tail.join(good, keys))


def reanchor_tail(prior: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """Near rails as prefix and the prior's tail moved rigidly onto their end; refused paths keep a status row.

    The tail must reach 1 m to either side of the near end, and every joined
    step must be in 1e-6 .. 5 m.
    """
    from .joins import polyline

    sides = [p + a for p in "lr" for a in "xyz"]
    e = _near_end(prior, near, keys)
    ahead = (c("u0") <= c("end") - 1) & (c("u1") >= c("end") + 1) & (c("kp") >= 3)
    e = e.withColumn("status", F.when(ahead, "REANCHORED").otherwise("INSUFFICIENT_PRIOR_AHEAD"))
    mid = lambda p: tuple((c(f"{p}_l{a}") + c(f"{p}_r{a}")) / 2 for a in "xyz")
    across = lambda p: sub(tuple(c(f"{p}_r{a}") for a in "xyz"), tuple(c(f"{p}_l{a}") for a in "xyz"))

    def basis(d: DataFrame, tag: str, forward, side) -> DataFrame:
        d = d.select("*", *named(forward, tag + "0"), *named(side, tag + "s"))
        d = d.select("*", *named(unit(vec(tag + "0")), tag + "f"))
        d = d.select("*", *named(sub(vec(tag + "s"), scale(vec(tag + "f"), dot(vec(tag + "s"), vec(tag + "f")))), tag + "1"))
        d = d.select("*", *named(unit(vec(tag + "1")), tag + "r"))
        return d.select("*", *named(cross(vec(tag + "f"), vec(tag + "r")), tag + "u"))

    e = basis(e, "__o", sub(mid("f"), mid("g")), across("a"))
    e = basis(e, "__n", sub(mid("e"), mid("b")), across("e"))
    u = -(c("ly") + c("ry")) / 2
    t = prior.select(*keys, "k", *sides, u.alias("u")).join(e.where("status = 'REANCHORED'"), keys).where(c("u") > c("end") + 1e-6)
    moved = {}
    for p in "lr":
        d = tuple(c(p + a) - c(f"a_{p}{a}") for a in "xyz")
        local = [dot(d, vec("__o" + b)) for b in "fru"]
        for a in "xyz":
            moved[p + a] = sum((v * c(f"__n{b}{a}") for v, b in zip(local, "fru")), c(f"e_{p}{a}"))
    tail = t.select(*keys, "k", *[v.alias(n) for n, v in moved.items()], F.lit(False).alias("near"))
    head = near.join(e.where("status = 'REANCHORED'").select(*keys), keys, "left_semi").select(*keys, "k", *sides, F.lit(True).alias("near"))
    out = head.unionByName(tail)
    ctr = out.select(*keys, "k", *[((c("l" + a) + c("r" + a)) / 2).alias(a) for a in "xyz"])
    step = polyline(ctr, keys, ["x", "y", "z"])
    d = norm(tuple(c(a + "_1") - c(a) for a in "xyz"))
    broken = step.where((d < 1e-6) | (d > 5)).select(*keys).distinct().withColumn("__bad", F.lit(True))
    good = out.join(broken, keys, "left_anti").withColumn("status", F.lit("REANCHORED"))
    refused = e.join(broken, keys, "left").where((c("status") != "REANCHORED") | c("__bad"))
    none = [F.lit(None).cast("double").alias(n) for n in sides]
    rows = refused.select(*keys, F.lit(None).cast("int").alias("k"), *none, F.lit(False).alias("near"), F.when(c("__bad"), "DISCONTINUITY").otherwise(c("status")).alias("status"))
    return good.unionByName(rows)
