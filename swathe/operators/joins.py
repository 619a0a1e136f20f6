"""Joins in space, along paths and in time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import CELL, cell_of, explode_box
from ..functions.numeric import is_finite
from ..functions.vector import add, dot, named, norm, scale, sub, unit, vec
from ..session import cut
from .ordered import blocked_scan

c = F.col
# Grid cells are a hair wider than the search radius, so rounding cannot put a pair two cells apart.
PAD = 1 + 1e-6


def with_pose(points: DataFrame, frames: DataFrame, keys: list[str] = ("run", "frame")) -> DataFrame:
    """Points with the accepted pose of their frame; frames without one drop out."""
    ok = frames.where(c("pose_status").isin("ok", "origin"))
    return points.join(ok, list(keys))


def squared_distance(a: str, b: str) -> Column:
    return sum(((c(a + s) - c(b + s)) * (c(a + s) - c(b + s)) for s in "yz"), (c(a + "x") - c(b + "x")) * (c(a + "x") - c(b + "x")))


def _reach(left: DataFrame, right: DataFrame, keys, left_ids, right_ids, names, reach: float):
    """Both sides of a search within ``reach``: cells are twice as wide, so a left row's box touches two per axis, eight in all, and a right row has one."""
    size = 2 * reach * PAD
    a = left.select(*keys, *[c(i).alias("a_" + i) for i in left_ids], *[c(n).cast("double").alias("a" + s) for n, s in zip(names, "xyz")])
    b = right.select(*keys, *[c(i).alias("b_" + i) for i in right_ids], *[c(n).cast("double").alias("b" + s) for n, s in zip(names, "xyz")])
    lo, hi = (tuple(p + sign * reach * PAD for p in vec("a")) for sign in (-1, 1))
    return explode_box(a, lo, hi, size).hint("merge"), b.select("*", *cell_of(vec("b"), size))


def _placed(df: DataFrame, keys: list[str], ids: list[str], names) -> DataFrame:
    """Keys, ids, x, y and z of the rows that can lie near another: no null key, finite coordinates."""
    df = df.select(*keys, *ids, *[c(n).cast("double").alias(s) for n, s in zip(names, "xyz")])
    for ok in [*[c(k).isNotNull() for k in keys], *[is_finite(c(s)) for s in "xyz"]]:
        df = df.where(ok)
    return df


def _spread(df: DataFrame, at, reach: float) -> DataFrame:
    """A row for each cell in which ``df``'s rows may meet others that lie within ``reach`` on each axis of ``at``.

    Two rows meet in the cell of their larger coordinates, axis by axis, so a row is copied upwards only:
    cells are eight times as wide as the reach, which makes less than one and a half rows on average.
    """
    return explode_box(df, at, tuple(v + reach for v in at), 8 * reach)


def _meet(rows: DataFrame, keys: list[str], ids: list[str], radius: float, at, reach: float) -> DataFrame:
    """Pairs among spread rows (keys, ids, x, y, z, ``at``): each row looks up the second axis of its cell as far as ``reach``, no join."""
    side = list(dict.fromkeys([*ids, *"xyz", *at]))
    cell = ", ".join(f"`{k}`" for k in [*keys, *CELL])
    up = F.expr(f"collect_list(__me) OVER (PARTITION BY {cell} ORDER BY `{at[1]}` RANGE BETWEEN CURRENT ROW AND {reach}{'D' * isinstance(reach, float)} FOLLOWING)")
    own = [c(n).alias("a_" + n) for n in side]
    for i in ids:
        rows = rows.where(c(i).isNotNull())
    j = rows.withColumn("__me", F.struct(*side)).select(*keys, *CELL, *own, up.alias("__up")).where(F.size("__up") > 1)
    j = j.withColumn("__b", F.explode("__up")).select("*", *[c("__b." + n).alias("b_" + n) for n in side])
    ida, idb = F.struct(*["a_" + i for i in ids]), F.struct(*["b_" + i for i in ids])
    low, high = c("a_" + at[1]), c("b_" + at[1])
    j = j.where(((low < high) & (ida != idb)) | ((low == high) & (ida < idb)))
    d2 = squared_distance("a_", "b_")
    here = [F.floor(F.greatest("a_" + n, "b_" + n) / (8 * reach)) == c(k) for n, k in zip(at, CELL)]
    j = j.where((d2 <= radius * radius) & here[0] & here[1] & here[2])
    pick = lambda i, p, q: F.when(ida > idb, c(f"{q}_{i}")).otherwise(c(f"{p}_{i}"))
    return j.select(*keys, *[pick(i, "a", "b").alias("a_" + i) for i in ids], *[pick(i, "b", "a").alias("b_" + i) for i in ids], F.sqrt(d2).alias("d"))


def radius_pairs(df: DataFrame, keys: list[str], ids: list[str], radius: float, names=("x", "y", "z")) -> DataFrame:
    """Unordered pairs at most ``radius`` apart, as a_*, b_* and ``d``.

    Meant for voxelised input, where the number of items per cell is bounded
    by the cell volume. Rows are moved once, and a cell's rows are sorted once.
    """
    rows = _spread(_placed(df, keys, ids, names), vec(*"xyz"), radius * PAD)
    return _meet(rows, keys, ids, radius, list("xyz"), radius * PAD)


def voxel_pairs(points: DataFrame, keys: list[str], id_: str, voxel: float, radius: float) -> DataFrame:
    """``radius_pairs`` of the centroids of voxels, each named ``id`` by its least ``id_``.

    Cells are made of whole voxels, so points go straight to where their
    centroids meet, and nothing is moved for the centroids themselves.
    """
    far = F.lit(1 << 62)
    index = [F.greatest(-far, F.least(far, F.floor(c(a) / voxel))) for a in "xyz"]
    reach = math.floor(radius / voxel) + 2
    p = _spread(_placed(points, keys, [id_], "xyz"), index, reach).repartition(*keys, *CELL)
    at = ["__i", "__j", "__k"]
    i, j, k = (v.alias(n) for v, n in zip(index, at))
    least = F.min(F.when(c(id_).isNotNull(), F.struct(c(id_).alias("id"))))
    # The least of a struct is found by sorting, here in the order that the search needs; nearly every point has a voxel of its own, which a hash table would only hold.
    v = p.groupBy(*keys, *CELL, j, i, k).agg(least.alias("__m"), *[F.avg(a).alias(a) for a in "xyz"])
    v = v.select(*keys, *CELL, *at, "__m.id", *"xyz")
    return _meet(v, keys, ["id"], radius, at, reach)


def _ask(askers: DataFrame | None, rows: DataFrame, keys: list[str], target: Column, reach: float, axis: str) -> DataFrame:
    """Asking rows with ``__near``, the ``target`` of all ``rows`` within ``reach`` along ``axis`` and in the same or a near cell.

    Cells are eight times as wide as the reach and centred, so a row and its copies to the cells that it can be
    reached from are less than two; askers have one cell. All is moved once, and a cell's rows are sorted once, no join.
    Without ``askers`` the rows ask for themselves. All have keys, x, y and z.
    """
    width = 8 * reach
    at = tuple(c(a) + width / 2 for a in "xyz")
    here = [F.floor(p / width) for p in at]
    spread = explode_box(rows, tuple(p - reach for p in at), tuple(p + reach for p in at), width)
    home = (here[0] == c("ci")) & (here[1] == c("cj")) & (here[2] == c("ck"))
    told = spread.withColumns({"__t": target, "__asks": home if askers is None else F.lit(False)})
    if askers is not None:
        own = askers.select("*", *[h.alias(n) for h, n in zip(here, CELL)], F.lit(None).cast(told.schema["__t"].dataType).alias("__t"), F.lit(True).alias("__asks"))
        told = own.unionByName(told.select(*keys, *"xyz", *CELL, "__t", "__asks"), allowMissingColumns=True)
    cell = ", ".join(f"`{k}`" for k in [*keys, *CELL])
    near = F.expr(f"collect_list(__t) OVER (PARTITION BY {cell} ORDER BY `{axis}` RANGE BETWEEN {float(reach)}D PRECEDING AND {float(reach)}D FOLLOWING)")
    return told.withColumn("__near", near).where("__asks").drop(*CELL, "__t", "__asks")


def _off(x: Column) -> Column:
    """Squared distance of a target from the asking row."""
    return (c("x") - x["x"]) * (c("x") - x["x"]) + (c("y") - x["y"]) * (c("y") - x["y"]) + (c("z") - x["z"]) * (c("z") - x["z"])


def bounded_nearest(left: DataFrame, right: DataFrame, keys: list[str], id_: str, max_d: float, names=("x", "y", "z"), left_ids: list[str] | None = None,
                    carry: list[str] = (), inner: bool = False) -> DataFrame:
    """Every left row with its nearest right row within ``max_d``, else null.

    ``left_ids`` identify a left row within ``keys`` (default: the same ``id_``). ``carry`` names further columns of the
    right row, as near_*. With ``inner`` only left rows that have a near one are returned, with their x, y and z;
    those outside the box of all right rows are not moved.
    """
    ids = left_ids or [id_]
    place = lambda df: [c(n).cast("double").alias(a) for n, a in zip(names, "xyz")]
    extra = [c(n).alias("near_" + n) for n in carry]
    a = left.select(*keys, *ids, *place(left))
    b = _placed(right.withColumns({"__id": c(id_), **{"near_" + n: c(n) for n in carry}}), keys, ["__id", *["near_" + n for n in carry]], names)
    if inner:
        box = b.agg(*[f(n).alias(f.__name__ + n) for n in "xyz" for f in (F.min, F.max)]).first()
        for n in "xyz":
            lo, hi = box["min" + n], box["max" + n]
            a = a.where(F.lit(False) if lo is None else c(n).between(lo - max_d * PAD, hi + max_d * PAD))
    target = F.struct(*"xyz", c("__id").alias("i"), *["near_" + n for n in carry])
    asked = _ask(a.withColumnsRenamed({i: "__l_" + i for i in ids}), b.select(*keys, *"xyz", "__id", *["near_" + n for n in carry]), keys, target, max_d * PAD, "y")
    found = F.transform("__near", lambda x: F.struct(_off(x).alias("d2"), x["i"].alias("i"), *[x["near_" + n].alias("near_" + n) for n in carry]))
    best = asked.withColumn("__m", F.array_min(F.filter(found, lambda m: m["d2"] <= max_d * max_d)))
    best = best.where(c("__m").isNotNull()) if inner else best
    out = [*keys, *[c("__l_" + i).alias(i) for i in ids], c("__m.i").alias("near_" + id_), F.sqrt("__m.d2").alias("d")]
    return best.select(*out, *(["x", "y", "z"] if inner else []), *[c("__m.near_" + n) for n in carry])


def knn_lists(df: DataFrame, keys: list[str], id_: str, k: int, cell: float, made, names=("x", "y", "z"), max_radius: float | None = None) -> DataFrame:
    """What ``made`` makes of each row's list of its ``k`` nearest other rows, exact: keys, id, x, y, z and the columns of its dict.

    The list holds d2, id, x, y and z, nearest first, equal ones by id; only what is made of it is written. A search
    reaches ``cell`` around a row, so a row is done once it has ``k`` that near. The others repeat with twice
    the reach, among the cells they lie in, until all are done or the whole extent (or ``max_radius``) is covered. Use
    on voxelised input. Rows with a null key or without a finite place have no neighbours and are no one's.
    """
    base = cut(_placed(df.withColumn("__id", c(id_)), keys, ["__id"], names), "knn")
    ext = base.agg(*[(F.max(n) - F.min(n)).alias(n) for n in "xyz"]).first()
    widest = max("xyz", key=lambda n: float(ext[n] or 0))
    if max_radius is None:
        max_radius = float(ext[widest] or 0) * 2 + cell
    todo, done, size, left = None, None, cell, 0
    target = F.struct(*"xyz", c("__id").alias("id"))
    while True:
        last, reach = size >= max_radius, size * PAD
        rows = base
        if todo is not None:
            width = 8 * reach
            at = tuple(c(a) + width / 2 for a in "xyz")
            near = explode_box(todo.select(*keys, *"xyz"), tuple(p - reach for p in at), tuple(p + reach for p in at), width).select(*keys, *CELL).distinct()
            # Rows farther than a cell's width from all that still search are left alone.
            here = [F.floor(p / width).alias(n) for p, n in zip(at, CELL)]
            rows = base.select("*", *here).join(near.hint("broadcast" if left <= 20_000 else "merge"), [*keys, *CELL], "left_semi").drop(*CELL)
        asked = _ask(todo, rows, keys, target, reach, widest)
        found = F.transform("__near", lambda x: F.struct(_off(x).alias("d2"), x["id"].alias("id"), x["x"].alias("x"), x["y"].alias("y"), x["z"].alias("z")))
        r2 = size * size
        asked = asked.withColumn("__l", F.filter(found, lambda m: (m["d2"] <= r2) & (m["id"] != c("__id")))).drop("__near")
        asked = asked.withColumn("__l", F.slice(F.sort_array("__l"), 1, k))
        full = F.size("__l") >= k
        lists = asked.select(*keys, "__id", *"xyz", full.alias("__full"), *[e.alias(n) for n, e in made(c("__l")).items()])
        ready = cut(lists, "knn")
        done_now = ready if last else ready.where("__full")
        done = done_now if done is None else done.unionByName(done_now)
        if last:
            break
        todo = ready.where("not __full").select(*keys, "__id", *"xyz")
        left = todo.count()
        if not left:
            break
        size *= 2
    return done.drop("__full").withColumnRenamed("__id", id_)


def knn(df: DataFrame, keys: list[str], id_: str, k: int, cell: float, names=("x", "y", "z"), max_radius: float | None = None) -> DataFrame:
    """The ``k`` nearest other rows, exact, a row each: ``knn_lists`` without their places."""
    made = lambda near: {"__k": F.transform(near, lambda m: F.struct(m["id"].alias("i"), m["d2"].alias("d2")))}
    rows = knn_lists(df, keys, id_, k, cell, made, names, max_radius)
    rows = rows.select(*keys, id_, F.posexplode("__k").alias("__p", "__m"))
    return rows.select(*keys, id_, (c("__p") + 1).alias("nn"), c("__m.i").alias("near_" + id_), F.sqrt("__m.d2").alias("d"))


def asof_model(frames: DataFrame, models: DataFrame, keys: list[str], max_age_ms: float, order: str = "frame", stamp: str = "header_time_ns") -> DataFrame:
    """Newest model at or before each frame, same key, not older than ``max_age_ms``.

    Models and frames share one ordered scan; no range join.
    """
    m = models.select(*keys, order, stamp, F.lit(0).alias("__kind"), F.struct(c(order).alias("model"), c(stamp).alias("stamp")).alias("__m"))
    f = frames.select(*keys, order, stamp, F.lit(1).alias("__kind"), F.lit(None).cast(m.schema["__m"].dataType).alias("__m"))
    out = blocked_scan(m.unionByName(f), keys, order, {"__last": ("last", c("__m"))}, ties=["__kind"])
    out = out.where(c("__kind") == 1).withColumn("age_ms", (c(stamp) - c("__last.stamp")) / 1e6)
    fresh = c("age_ms") <= max_age_ms
    return out.select(*keys, order, F.when(fresh, c("__last.model")).alias("model"), F.when(fresh, c("age_ms")).alias("age_ms"))


def polyline(df: DataFrame, keys: list[str], names: list[str], order: str = "k") -> DataFrame:
    """Consecutive vertices side by side: each name plus ``<name>_1`` of the next vertex."""
    nxt = df.select(*keys, (c(order) - 1).alias(order), *[c(n).alias(n + "_1") for n in names])
    return df.select(*keys, order, *names).join(nxt, [*keys, order])


def interp_at(curve: DataFrame, stations: DataFrame, keys: list[str], s: str, values: list[str], at: str, bucket: float = 4.0, order: str = "k") -> DataFrame:
    """Linear interpolation of ``values`` at the stations' ``at``; beyond the ends, the end values.

    Segments are spread over buckets of ``s``; a station looks into one bucket.
    """
    ends = curve.groupBy(*keys).agg(F.min(s).alias("__clo"), F.max(s).alias("__chi"))
    seg = polyline(curve, keys, [s, *values], order)
    seg = seg.select(*keys, c(s).alias("__s0"), c(s + "_1").alias("__s1"), *[c(v).alias("__0" + v) for v in values], *[c(v + "_1").alias("__1" + v) for v in values])
    seg = seg.withColumn("__cb", F.explode(F.sequence(F.floor(c("__s0") / bucket), F.floor(c("__s1") / bucket))))
    seg = seg.join(ends, keys)
    q = stations.join(ends, keys).withColumn("__q", F.greatest(c("__clo"), F.least(c("__chi"), c(at))))
    q = q.drop("__clo", "__chi").withColumn("__cb", F.floor(c("__q") / bucket))
    j = q.join(seg, [*keys, "__cb"])
    inside = (c("__q") >= c("__s0")) & ((c("__q") < c("__s1")) | ((c("__q") == c("__s1")) & (c("__s1") == c("__chi"))))
    t = (c("__q") - c("__s0")) / (c("__s1") - c("__s0"))
    return j.where(inside).select(*stations.columns, *[(c("__0" + v) + t * (c("__1" + v) - c("__0" + v))).alias(v) for v in values])


def nearest_segment(
    points: DataFrame, curve: DataFrame, keys: list[str], ids: list[str], max_d: float,
    max_gap: float = 0.8, max_len: float = 1.0, max_excess: float = 0.3, names=("x", "y", "z"), s: str = "s", extra: list[str] = (),
    window: tuple[str, float] | None = None,
) -> DataFrame:
    """Nearest point of a polyline within ``max_d``: distance, station and segment.

    Segments that bridge a gap are skipped; a projection that lies more than
    ``max_excess`` beyond the chosen segment's end is left unscored. ``curve``
    has k, ``s`` and vx, vy, vz. ``extra`` point columns are kept. ``window``: an
    expected station among ``extra`` and how far from it a station may lie; others
    count only where none lies so near.
    """
    seg = polyline(curve, keys, ["vx", "vy", "vz", s])
    step = sub(tuple(c(f"v{a}_1") for a in "xyz"), vec("v"))
    seg = seg.withColumn("__len", norm(step)).where((c(s + "_1") - c(s) <= max_gap) & (c("__len") <= max_len) & (c("__len") > 0))
    lo = tuple(F.least(c("v" + a), c(f"v{a}_1")) - max_d for a in "xyz")
    hi = tuple(F.greatest(c("v" + a), c(f"v{a}_1")) + max_d for a in "xyz")
    grid = cut(explode_box(seg.withColumnRenamed("k", "seg"), lo, hi, 2 * max_d), "grid")
    p = points.select(*keys, *ids, *extra, *[c(n).cast("double").alias("p" + a) for n, a in zip(names, "xyz")])
    j = p.select("*", *cell_of(vec("p"), 2 * max_d)).join(grid, [*keys, *CELL])
    j = j.withColumn("__t", dot(sub(vec("p"), vec("v")), sub(tuple(c(f"v{a}_1") for a in "xyz"), vec("v"))) / (c("__len") * c("__len")))
    j = j.withColumn("__tc", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("__t"))))
    # In the order of the SQL: a point off a shared vertex is as far from both segments, so the last bit decides between them.
    j = j.withColumn("d", norm(tuple(c("p" + a) - c("v" + a) - c("__tc") * (c(f"v{a}_1") - c("v" + a)) for a in "xyz"))).where(c("d") <= max_d)
    excess = F.greatest(F.lit(0.0), -c("__t"), c("__t") - 1) * c("__len")
    j = j.withColumn("station", c(s) + c("__tc") * (c(s + "_1") - c(s)))
    off = F.coalesce(F.abs(c("station") - c(window[0])) > window[1], F.lit(False)) if window else F.lit(False)
    best = F.min(F.struct(off.alias("off"), "d", "seg", "station", excess.alias("excess"))).alias("m")
    out = j.groupBy(*keys, *ids, *extra).agg(best)
    ok = c("m.excess") <= max_excess
    return out.select(*keys, *ids, *extra, c("m.seg").alias("seg"), F.when(ok, c("m.d")).alias("d"), F.when(ok, c("m.station")).alias("station"))


def first_displaced(frames: DataFrame, keys: list[str], distance: float, step: int = 8) -> DataFrame:
    """First later pose of the same chain at least ``distance`` away.

    Later frames are looked up in windows of frame numbers by equi-join; only
    frames still without an answer go on to the next, wider window.
    ``frames``: keys, frame, header_time_ns, tx, ty, tz. Frame numbers are dense.
    """
    pose = ["frame", "header_time_ns", "tx", "ty", "tz"]
    base = frames.select(*keys, *pose)
    last = base.groupBy(*keys).agg(F.max("frame").alias("__end"))
    todo, found, lo = cut(base.join(last, keys), "moved"), None, 1
    b = base.select(*keys, *[c(p).alias("b_" + p) for p in pose])
    while True:
        look = todo.withColumn("b_frame", F.explode(F.sequence(c("frame") + lo, c("frame") + lo + step - 1)))
        j = look.join(b, [*keys, "b_frame"])
        j = j.where(norm(tuple(c("b_t" + a) - c("t" + a) for a in "xyz")) >= distance)
        hit = j.groupBy(*keys, "frame", "header_time_ns").agg(F.min(F.struct("b_frame", "b_header_time_ns")).alias("m"))
        hit = cut(hit.select(*keys, "frame", c("m.b_frame").alias("moved_frame"), ((c("m.b_header_time_ns") - c("header_time_ns")) / 1e6).alias("latency_ms")), "moved")
        found = hit if found is None else found.unionByName(hit)
        lo, step = lo + step, step * 2
        todo = cut(todo.join(hit, [*keys, "frame"], "left_anti").where(c("frame") + lo <= c("__end")), "moved")
        if todo.isEmpty():
            break
    reason = F.when(c("moved_frame").isNull(), "no_displacement_in_chain").otherwise("")
    return base.select(*keys, "frame").join(found, [*keys, "frame"], "left").withColumn("reason", reason)


def _template_cell(cap: float) -> list[Column]:
    return [F.floor(c("v") / (cap * PAD)).alias("gi"), F.floor(c("w") / (cap * PAD)).alias("gj")]


def template_lists(template: DataFrame, cap: float) -> DataFrame:
    """Per grid cell of ``cap`` the template cells in its 3 x 3 neighbours, as one written list."""
    span = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    # Cells at the same place count once, under their least number.
    tpl = template.groupBy("v", "w").agg(F.min("cell").alias("cell")).select("cell", c("v").alias("tv"), c("w").alias("tw"), *_template_cell(cap))
    tpl = tpl.withColumn("di", F.explode(span)).withColumn("dj", F.explode(span))
    tpl = tpl.groupBy((c("gi") + c("di")).alias("gi"), (c("gj") + c("dj")).alias("gj")).agg(F.collect_list(F.struct("tv", "tw", "cell")).alias("__t"))
    return cut(tpl, "template")


def template_distance(points: DataFrame, template: DataFrame, keys: list[str], cap: float = 0.05, digits: int | None = None, lists: DataFrame | None = None) -> DataFrame:
    """Distance of (v, w) rows to the nearest template cell, capped at ``cap``. Rows keep all ``keys``.

    A row meets the one list of its grid cell (``template_lists``, made here if
    not given), so nothing is grouped afterwards, and rows are not moved while
    the lists are few. Equal rows stay; callers whose rows may repeat drop them
    before they shift them.
    """
    lists = template_lists(template, cap) if lists is None else lists

    def at(t: Column) -> Column:
        d = F.sqrt((c("v") - t["tv"]) * (c("v") - t["tv"]) + (c("w") - t["tw"]) * (c("w") - t["tw"]))
        # ``digits`` rounds distances, so that equal ones tie and the lower cell wins.
        return F.struct((F.round(d, digits) if digits else d).alias("d"), t["cell"].alias("cell"))

    near = points.select(*keys, "v", "w", *_template_cell(cap)).join(lists, ["gi", "gj"], "left")
    near = near.withColumn("m", F.array_min(F.filter(F.transform("__t", at), lambda m: m["d"] <= cap)))
    return near.select(*keys, "v", "w", F.coalesce(c("m.d"), F.lit(cap)).alias("d"), c("m.cell").alias("cell"))


def shifted(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """Every point under every candidate offset (ov, ow) of a fixed grid."""
    return points.crossJoin(F.broadcast(offsets)).withColumns({"v": c("v") - c("ov"), "w": c("w") - c("ow")})


def offset_grid(spark, half: float, step: float) -> DataFrame:
    """Square grid of offsets; its size depends on the two numbers only."""
    n = int(round(half / step))
    axis = F.sequence(F.lit(-n), F.lit(n))
    g = spark.range(1).select(F.explode(axis).alias("i")).select("i", F.explode(axis).alias("j"))
    return g.select((c("i") * step).alias("ov"), (c("j") * step).alias("ow"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str], lateral: float = 0.10, vertical: float = 0.03) -> DataFrame:
    """p90 of lateral and vertical differences of two rail pairs on the grid 2.0, 2.5, ..., 8.0 m,
    each rail at its own forward coordinate; needs six shared stations per side.

    At most 26 rows per key reach the quantile.
    """
    def rails(p: DataFrame) -> DataFrame:
        l = p.select(*keys, "k", F.lit("L").alias("side"), (-c("ly")).alias("u"), c("lx").alias("px"), c("lz").alias("pz"))
        return l.unionByName(p.select(*keys, "k", F.lit("R").alias("side"), (-c("ry")).alias("u"), c("rx").alias("px"), c("rz").alias("pz")))

    ra, rb = rails(a), rails(b)
    sides = [*keys, "side"]
    span = lambda r, n: r.groupBy(*sides).agg(F.min("u").alias("lo" + n), F.max("u").alias("hi" + n))
    grid = span(ra, "a").join(span(rb, "b"), sides)
    grid = grid.withColumn("g", F.explode(F.sequence(F.lit(4), F.lit(16)))).withColumn("g", c("g") / 2)
    grid = grid.where((c("g") >= F.greatest("loa", "lob")) & (c("g") <= F.least("hia", "hib"))).select(*sides, "g")
    at_a = interp_at(ra, grid, sides, "u", ["px", "pz"], "g")
    at_b = interp_at(rb, grid, sides, "u", ["px", "pz"], "g").select(*sides, "g", c("px").alias("qx"), c("pz").alias("qz"))
    j = at_a.join(at_b, [*sides, "g"]).withColumns({"dx": F.abs(c("px") - c("qx")), "dz": F.abs(c("pz") - c("qz"))})
    out = j.groupBy(*keys).agg(
        F.percentile("dx", F.lit(0.9)).alias("lateral_p90"), F.percentile("dz", F.lit(0.9)).alias("vertical_p90"),
        F.least(F.count_if(c("side") == "L"), F.count_if(c("side") == "R")).alias("shared"),
    )
    enough, fits = c("shared") >= 6, (c("lateral_p90") <= lateral) & (c("vertical_p90") <= vertical)
    reason = F.when(~enough, "INSUFFICIENT_OVERLAP").when(fits, "AGREES_WITH_CURRENT_NEAR").otherwise("CURRENT_NEAR_CONTRADICTION")
    return out.withColumns({"accepted": enough & fits, "reason": reason})


def match_components(components: DataFrame, tracks: DataFrame, radius: float = 0.35, fraction: float = 0.2, max_gap_s: float = 3.0) -> DataFrame:
    """Component / track pairs that share support.

    Both sides are voxels: run, generation, t_s, id, x, y, z. A pair counts
    when its boxes are within ``radius``, at least ``fraction`` of one side's
    voxels has a neighbour on the other, and the track is at most
    ``max_gap_s`` older; of the same instant they count too. The score is the smaller median distance plus a
    tenth of the missing share. Candidate pairs come from voxels that meet,
    so boxes that are apart never form a pair. Voxels are moved once, to the task of their stretch of time
    (four times ``max_gap_s``), tracks also to the next if a component there may still match; only pairs leave it.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from .support import matching

    keys, span = ["run", "generation"], 4 * max_gap_s
    place = [*keys, "__block"]
    mk = lambda d, side: _placed(d.withColumn("t_s", c("t_s").cast("double")), keys, ["t_s", "id"], "xyz").where("t_s is not null and id is not null").withColumn("__side", F.lit(side))
    block = lambda t: F.floor(t / span)
    a = mk(components, 0).withColumn("__block", block(c("t_s")))
    b = mk(tracks, 1).withColumn("__block", F.explode(F.sequence(block(c("t_s")), block(c("t_s") + max_gap_s * PAD))))
    rows = a.unionByName(b)
    # A number given here isn't coalesced: the work of a row is far more than its bytes tell.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place).sortWithinPartitions(*place, "__side", "t_s", "id")
    types = components.schema
    shape = T.StructType([*[types[k] for k in keys], T.StructField("component", types["id"].dataType), T.StructField("track", types["id"].dataType), T.StructField("fraction", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(matching(place, keys, to_arrow_schema(shape), radius, fraction, max_gap_s), shape)
