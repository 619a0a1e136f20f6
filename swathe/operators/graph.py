"""Connected components and order-dependent selection, as rounds of joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import CELL, cell_of, explode_neighbours
from ..functions.vector import vec
from ..session import cut
from .joins import PAD, squared_distance

c = F.col


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return row["n"], row["h"]


def connected_components(vertices: DataFrame, edges: DataFrame, a: str = "a_id", b: str = "b_id", id_: str = "id") -> DataFrame:
    """Component (its least id) of every vertex. Ids are global, edges undirected.

    Alternates two star steps (each vertex links its larger neighbours, then its
    smaller ones, to the least id it sees) until nothing changes: a number of
    rounds logarithmic in the component size. A step is a minimum per vertex,
    combined before the shuffle, and a join; a vertex with very many edges is
    never gathered in one place.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = cut(e, "cc")
    seen = _mark(e)
    while seen[0]:
        both = e.unionByName(e.select(c("v").alias("u"), c("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(c("v").alias("u"), c("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(c("v").alias("p"), c("m").alias("q")), F.struct(c("u").alias("p"), c("m").alias("q")))).alias("x"))
        nxt = cut(small.select(c("x.p").alias("u"), c("x.q").alias("v")).where("u > v").distinct(), "cc")
        mark = _mark(nxt)
        if mark == seen:
            break
        e, seen = nxt, mark
    label = e.groupBy(c("u").alias(id_)).agg(F.min("v").alias("component"))
    return vertices.select(id_).join(label, id_, "left").select(id_, F.coalesce("component", id_).alias("component"))


def greedy_select(df: DataFrame, keys: list[str], order: list[str], radius: float, names=("x", "y", "z"), strict: bool = False) -> DataFrame:
    """Rows kept by the sequential rule "keep unless an earlier kept row is within ``radius``".

    Rounds: a row is kept when no undecided earlier row is within the radius;
    everything near a kept row is dropped. Cells are so small that two rows of
    one cell always conflict, hence only the earliest row of a cell can be
    kept in a round, and a crowded cell costs one row per round, not its
    square. ``order`` must be a total order per key.
    """
    size = radius / math.sqrt(3.0)
    o = F.struct(*order)
    near = (lambda d2: d2 < radius * radius) if strict else (lambda d2: d2 <= radius * radius)
    base = df.select(*keys, o.alias("o"), *[c(n).cast("double").alias("a" + s) for n, s in zip(names, "xyz")])
    todo = cut(base.select("*", *cell_of(vec("a"), size)), "greedy")
    kept = None
    while True:
        reps = todo.groupBy(*keys, *CELL).agg(F.min(F.struct("o", "ax", "ay", "az")).alias("r"))
        reps = reps.select(*keys, *CELL, c("r.o").alias("bo"), *[c("r.a" + s).alias("b" + s) for s in "xyz"])
        reps = cut(reps, "greedy")
        reach = explode_neighbours(reps, 2)
        earlier = todo.join(reach, [*keys, *CELL]).where((c("o") < c("bo")) & near(squared_distance("a", "b")))
        blocked = earlier.select(*keys, "bo").distinct()
        new = cut(reps.join(blocked, [*keys, "bo"], "left_anti"), "greedy")
        got = new.select(*keys, c("bo").alias("o"), *[c("b" + s).alias("a" + s) for s in "xyz"])
        kept = got if kept is None else kept.unionByName(got)
        close = explode_neighbours(new.select(*keys, *CELL, *["b" + s for s in "xyz"]), 2)
        close = close.select(*[c(k).alias("k_" + k) for k in [*keys, *CELL]], *["b" + s for s in "xyz"])
        same = [c(k) == c("k_" + k) for k in [*keys, *CELL]]
        on = same[0]
        for s in same[1:]:
            on = on & s
        todo = cut(todo.join(close, on & near(squared_distance("a", "b")), "left_anti"), "greedy")
        if todo.isEmpty():
            break
    return kept.select(*keys, *[c("o")[n].alias(n) for n in order], *[c("a" + s).alias(n) for n, s in zip(names, "xyz")])


def nearest_earlier(df: DataFrame, anchors: DataFrame, keys: list[str], order: list[str], radius: float, anchor_id: str, names=("x", "y", "z")) -> DataFrame:
    """Each row with the nearest anchor within ``radius`` that is not later than the row; ties take the lower id."""
    a = df.withColumn("__o", F.struct(*order)).select("*", *[c(n).cast("double").alias("a" + s) for n, s in zip(names, "xyz")])
    a = a.select("*", *cell_of(vec("a"), radius * PAD))
    b = anchors.select(*keys, anchor_id, F.struct(*order).alias("__p"), *[c(n).cast("double").alias("b" + s) for n, s in zip(names, "xyz")])
    b = explode_neighbours(b.select("*", *cell_of(vec("b"), radius * PAD)), 1)
    j = a.join(b, [*keys, *CELL])
    d2 = squared_distance("a", "b")
    j = j.where((d2 <= radius * radius) & (c("__p") <= c("__o")))
    best = j.groupBy(*keys, *order).agg(F.min(F.struct(F.sqrt(d2).alias("d"), c(anchor_id).alias("i"))).alias("m"))
    return df.join(best, [*keys, *order]).select(*df.columns, c("m.i").alias(anchor_id), c("m.d").alias("anchor_distance"))
