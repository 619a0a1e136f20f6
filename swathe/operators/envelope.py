"""Containment of points in the envelope swept along a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import CELL, cell_of, explode_box
from ..functions.vector import Vec, add, dot, norm, sub, vec
from ..session import cut, df_sql
from .projections import is_valid

# Train envelope and margins in metres.
WIDTH, HEIGHT = 2.1, 3.0
MARGIN, BOTTOM = 0.030001, 0.100001
MIN_STEP, MAX_STEP = 1e-8, 5.0
CELL_M = 2.0
# Far above the rounding of coordinates, so the box around the segments loses no point on their edges.
SLACK = 0.001


def path_segments(path: DataFrame, keys: list[str] = ("run",), observed: int = 81) -> DataFrame:
    """One row per step between consecutive vertices, with its local frame.

    Vertices are numbered 0, 1, 2, ... per path, so the next vertex is an
    equi-join on k + 1: no per-path sort, no hot path. ``invalid`` marks
    repeated points and jumps; ``extra`` marks segments past the last
    observed vertex.
    """
    keys = list(keys)
    nxt = path.select(
        *keys, (F.col("k") - 1).alias("k"),
        *[((F.col("l" + a) + F.col("r" + a)) / 2).alias("n" + a) for a in "xyz"],
    )
    j = path.join(nxt, [*keys, "k"])
    # One statement, one stage per line of subquery: vectors are computed once and read by name afterwards.
    ks = ", ".join(keys)
    xyz = lambda text: ", ".join(text.replace("@", a) for a in "xyz")
    dot3 = lambda p, q: " + ".join(f"{p}{a} * {q}{a}" for a in "xyz")
    unit3 = lambda p, q: xyz(f"CASE WHEN sqrt({dot3(p, p)}) >= 1e-10 THEN {p}@ / sqrt({dot3(p, p)}) END AS {q}@")
    out = df_sql(f"""
        SELECT {ks}, k, len, {xyz("c@")}, {xyz("f@")}, {xyz("q@")}, {xyz("h@ * flip AS u@")} FROM (
        SELECT *, CASE WHEN hz < 0 THEN -1D ELSE 1D END AS flip FROM (
        SELECT *, {unit3("g", "h")} FROM (
        SELECT *, fy * qz - fz * qy AS gx, fz * qx - fx * qz AS gy, fx * qy - fy * qx AS gz FROM (
        SELECT *, {unit3("b", "q")} FROM (
        SELECT *, {xyz("a@ - f@ * along AS b@")} FROM (
        SELECT *, {dot3("a", "f")} AS along FROM (
        SELECT *, sqrt({dot3("s", "s")}) AS len, {unit3("s", "f")} FROM (
        SELECT *, {xyz("n@ - c@ AS s@")} FROM (
        SELECT {ks}, k, {xyz("n@")}, {xyz("(l@ + r@) / 2 AS c@")}, {xyz("r@ - l@ AS a@")} FROM {{j}})))))))))""", j=j)
    # A degenerate step gives NaN, which fails every test below. Being non-null, the frame columns
    # also keep the optimizer from inferring IS NOT NULL filters and unfolding them down the stages.
    nan = F.lit(float("nan"))
    names = ["len", *[p + a for p in "cfqu" for a in "xyz"]]
    out = out.select(*keys, "k", *[F.coalesce(F.col(n), nan).alias(n) for n in names])
    return out.withColumns({
        "extra": F.col("k") >= observed - 1,
        "invalid": ~((F.col("len") >= MIN_STEP) & (F.col("len") <= MAX_STEP)),
    })


def inside(p: Vec, width: float, height: float) -> Column:
    """Exact test against the segment columns of the row."""
    d = sub(p, vec("c"))
    u, v, w = dot(d, vec("f")), dot(d, vec("q")), dot(d, vec("u"))
    return (
        (u >= 0) & (u <= F.col("len")) & (F.abs(v) < width / 2 - MARGIN) & (w > BOTTOM) & (w < height - MARGIN)
    )


def envelope_hits(
    points: DataFrame, segments: DataFrame, keys: list[str] = ("run",), point_keys: list[str] = ("run", "frame", "point_idx"),
    width: float = WIDTH, height: float = HEIGHT, cell: float = CELL_M, world: tuple[str, str, str] = ("x", "y", "z"),
) -> DataFrame:
    """Points inside the swept envelope, each with the first segment that holds it.

    The segments are spread over grid cells, a point has one cell, the join is
    an equi-join on (path, cell) and the exact test follows; the cell table is
    written first, so Spark picks the join by its real size. Points outside the
    box around all segments are left out before they are moved. Points behind the
    sensor (y > 0) never count. ``world`` names the coordinates to test, when
    they differ from the sensor coordinates x, y, z.
    """
    keys, point_keys = list(keys), list(point_keys)
    half = tuple(
        F.abs(F.col("f" + a)) * F.col("len") / 2 + F.abs(F.col("q" + a)) * width / 2 + F.abs(F.col("u" + a)) * height / 2
        for a in "xyz"
    )
    mid = tuple(F.col("c" + a) + F.col("f" + a) * F.col("len") / 2 + F.col("u" + a) * height / 2 for a in "xyz")
    lo, hi = sub(mid, half), add(mid, half)
    grid = cut(explode_box(segments.where(~F.col("invalid")), lo, hi, cell), "grid")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    box = grid.agg(*[F.min(v).alias(f"lo{a}") for v, a in zip(lo, "xyz")], *[F.max(v).alias(f"hi{a}") for v, a in zip(hi, "xyz")]).first()
    near_path = F.lit(box["lox"] is not None)
    if box["lox"] is not None:
        for v, a in zip(vec(*world), "xyz"):
            near_path &= (v >= box["lo" + a] - SLACK) & (v <= box["hi" + a] + SLACK)
    probe = points.where(is_valid(x, y, z) & (y <= 0) & near_path).select(
        *dict.fromkeys([*keys, *point_keys, "x", "y", "z", *world]), *cell_of(vec(*world), cell)
    )
    found = probe.join(grid, [*keys, *CELL]).where(inside(vec(*world), width, height))
    near = norm(vec("x", "y", "z"))
    return (
        found.groupBy(*point_keys)
        .agg(F.min(F.struct("k", "extra", "x", "y", "z", near.alias("range_m"))).alias("__h"))
        .select(*point_keys, "__h.*")
    )


def frame_hits(points: DataFrame, hits: DataFrame, keys: list[str] = ("run", "frame"), sample: int = 256) -> DataFrame:
    """Per frame: eligible returns, hits, hits past the observed end, nearest hit, first ids.

    The id sample is a rank limit, which Spark applies on the map side too, so
    no frame ever brings more than ``sample`` ids per map task to the reducer.
    """
    keys = list(keys)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    eligible = points.where(is_valid(x, y, z)).groupBy(*keys).agg(F.count(F.lit(1)).alias("eligible_points"))
    stats = hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if("extra").alias("extrapolated"),
        F.min(F.struct("range_m", "point_idx")).alias("__n"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("point_idx"))
    first = (
        hits.withColumn("__r", rank).where(F.col("__r") <= sample).groupBy(*keys)
        .agg(F.array_sort(F.collect_list("point_idx")).alias("sample_ids"))
    )
    return (
        eligible.join(stats, keys, "left").join(first, keys, "left")
        .select(
            *keys, "eligible_points",
            F.coalesce("hits", F.lit(0)).alias("hits"),
            F.coalesce("extrapolated", F.lit(0)).alias("extrapolated"),
            F.col("__n.point_idx").alias("nearest_idx"), F.col("__n.range_m").alias("nearest_m"),
            "sample_ids",
        )
    )


def prism_hits(points: DataFrame, references: DataFrame, keys: list[str], distance: float = 8.0,
               width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """Points in one straight prism per key: columns fx.., qx.., ux.. and ``floor`` of the reference."""
    j = points.where(is_valid(F.col("x"), F.col("y"), F.col("z"))).join(references, keys)
    p = vec("x", "y", "z")
    u, v, w = dot(p, vec("f")), dot(p, vec("q")), dot(p, vec("u")) - F.col("floor")
    return j.where(
        (u >= 0) & (u <= distance) & (F.abs(v) < width / 2 - MARGIN) & (w > BOTTOM) & (w < height - MARGIN)
    )
