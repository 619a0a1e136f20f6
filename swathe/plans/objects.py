"""From envelope hits to components, measures, tracks and object groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import CELL, cell_of
from ..functions.vector import dot, sub, vec
from ..operators.graph import connected_components, greedy_select, nearest_earlier
from ..operators.joins import radius_pairs
from ..operators.ordered import sequence_number
from ..session import cut

c = F.col


def cluster_components(points: DataFrame, keys: list[str], id_: str, voxel: float = 0.05, radius: float = 0.24, min_points: int = 3, min_voxels: int = 2) -> DataFrame:
    """Points with the component they belong to (its least point id), small components dropped.

    Points collapse to voxel centroids first, so the pairs within ``radius``
    are bounded by the voxel count of a ball. ``id_`` is unique over all rows.
    """
    cells = points.select(*keys, id_, "x", "y", "z", *cell_of(vec("x", "y", "z"), voxel))
    vox = cells.groupBy(*keys, *CELL).agg(F.min(id_).alias("id"), *[F.avg(a).alias(a) for a in "xyz"])
    vox = cut(vox, "voxels")
    comp = connected_components(vox, radius_pairs(vox, keys, ["id"], radius))
    labelled = vox.join(comp, "id").select(*keys, *CELL, "component")
    out = cells.join(labelled, [*keys, *CELL])
    size = out.groupBy("component").agg(F.count(F.lit(1)).alias("points"), F.countDistinct(*CELL).alias("voxels"))
    size = size.where((c("points") >= min_points) & (c("voxels") >= min_voxels))
    return out.join(size, "component").drop(*CELL)


def component_measures(members: DataFrame, segments: DataFrame, keys: list[str], cell: float = 0.05) -> DataFrame:
    """Median centre, size in the frame of the nearest path vertex, occupied area and nearest range.

    ``members``: keys, component, x, y, z. A component is a connected blob in
    one batch, so its median is over a bounded group.
    """
    k = [*keys, "component"]
    centre = members.groupBy(*k).agg(*[F.median(a).alias("m" + a) for a in "xyz"], F.count(F.lit(1)).alias("count"),
                                     F.min(F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z"))).alias("nearest_m"))
    d2 = sum(((c("m" + a) - c("c" + a)) * (c("m" + a) - c("c" + a)) for a in "yz"), (c("mx") - c("cx")) * (c("mx") - c("cx")))
    frame = ["k", *[p + a for p in "cfqu" for a in "xyz"]]
    near = centre.select(*k, "mx", "my", "mz").join(segments.select(*keys, *frame), keys)
    near = near.groupBy(*k).agg(F.min_by(F.struct(*frame), F.struct(d2, "k")).alias("s")).select(*k, "s.*")
    j = members.join(near, k)
    d = sub(vec("x", "y", "z"), vec("c"))
    j = j.select(*k, dot(d, vec("q")).alias("lat"), dot(d, vec("f")).alias("dep"), dot(d, vec("u")).alias("hei"))
    m = j.groupBy(*k).agg(
        (F.max("lat") - F.min("lat")).alias("width_m"), (F.max("dep") - F.min("dep")).alias("depth_m"), (F.max("hei") - F.min("hei")).alias("height_m"),
        (F.countDistinct(F.floor(c("lat") / cell), F.floor(c("hei") / cell)) * cell * cell).alias("occupied_m2"))
    return centre.join(m, k).withColumn("bbox_m2", c("width_m") * c("height_m"))


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corner points of the convex hull (monotone chain), counter-clockwise."""
    p = np.unique(xy, axis=0)
    if len(p) < 3:
        return p

    def half(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    p = p.tolist()  # plain numbers: a step of the loop on array rows costs several times as much
    return np.array(half(p) + half(p[::-1]))


def hull_area(df: DataFrame, keys: list[str], u: str, v: str, chunk: int = 50_000) -> DataFrame:
    """Area of the convex hull of (u, v) per key; 0 if degenerate.

    Large groups are cut into chunks by hash; the hull of the chunk hulls is
    the hull of the group, so no task sees more than a chunk and the corners.
    """
    d = df.select(*keys, c(u).cast("double").alias("u"), c(v).cast("double").alias("v")).distinct()
    n = d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("__m"))
    d = d.join(n, keys).withColumn("__part", F.pmod(F.xxhash64("u", "v"), c("__m"))).drop("__m")

    @F.pandas_udf("array<double>")
    def corners(u: pd.Series, v: pd.Series) -> pd.Series:
        """Corners of one list of points a row, x and y in turn."""
        return pd.Series([_hull(np.stack([p, q], axis=1)).ravel() for p, q in zip(u, v)])

    @F.pandas_udf("double")
    def area(uv: pd.Series) -> pd.Series:
        def one(xy: np.ndarray) -> float:
            h = _hull(xy.reshape(-1, 2))
            x, y = (h[:, 0], h[:, 1]) if len(h) > 2 else (np.zeros(1), np.zeros(1))
            return 0.5 * abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))))

        return pd.Series([one(xy) for xy in uv])

    # Lists in rows: a call of Python for each group would cost more than its hull.
    parts = d.groupBy(*keys, "__part").agg(F.collect_list(F.struct("u", "v")).alias("p"))
    parts = parts.select(*keys, corners(c("p.u"), c("p.v")).alias("h"))
    whole = parts.groupBy(*keys).agg(F.flatten(F.collect_list("h")).alias("h"))
    return whole.select(*keys, area("h").alias("hull_m2"))


def group_objects(obs: DataFrame, radius: float = 10.0, order: list[str] = ("source_frame", "track_id", "obs_id"), key: str = "generation") -> tuple[DataFrame, DataFrame]:
    """Observations grouped around immobile anchors: (observations with group id, groups).

    The first observation in order fixes an anchor; later ones join the
    nearest anchor that already exists within ``radius`` in the same
    generation. Groups never chain.
    """
    order = list(order)
    p = obs.withColumnsRenamed({"wx": "x", "wy": "y", "wz": "z"})
    anchors = greedy_select(p, [key], order, radius)
    anchors = cut(sequence_number(anchors, order, "group_id", block=1).withColumn("group_id", c("group_id") + 1), "anchors")
    member = nearest_earlier(p, anchors, [key], order, radius, "group_id")
    frames = member.groupBy("group_id", key).agg(
        F.countDistinct("source_frame").alias("frames"), F.min("source_frame").alias("first_frame"), F.max("source_frame").alias("last_frame"),
        F.count(F.lit(1)).alias("observations"), F.array_sort(F.collect_set("track_id")).alias("members"),
        F.max_by("obs_id", F.struct("voxel_count", "point_count", *[-c(o) for o in order])).alias("size_obs"))
    status = F.when(c("frames") >= 2, "CONFIRMED").otherwise("SINGLE_FRAME")
    return member, frames.withColumn("status", status)
