"""Connected components of links between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard

c = F.col


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return row["n"], row["h"]


def linked_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that has a link to another one; the component is its least id.

    Alternates the two star steps (larger neighbours, then smaller ones, are
    tied to the least id a node sees) until nothing changes; the rounds grow
    with the logarithm of a component's size. The least ids are combined
    before their shuffle and written, so that both sides of each join come
    through a shuffle and adaptive execution can split a node with very many
    links. Links of nulls are dropped; no links give no rows.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(c("v").alias("u"), c("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = cut(both.where("v > u").join(low, "u").select(c("v").alias("u"), c("m").alias("v")).where("u > v").distinct(), "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        tied = large.join(least, "u").select("u", "v", "m")
        small = tied.select(c("v").alias("p"), c("m").alias("q")).unionByName(tied.select(c("u").alias("p"), c("m").alias("q")))
        nxt = cut(small.where("p > q").select(c("p").alias("u"), c("q").alias("v")).distinct(), "links")
        discard(low, large, least)
        after = _state(nxt)
        if after == state:
            discard(nxt)
            break
        discard(e)
        e, state = nxt, after
    members = e.groupBy(c("u").alias("id")).agg(F.min("v").alias("component"))
    return members.unionByName(members.select(c("component").alias("id"), "component").distinct())
