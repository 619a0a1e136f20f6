"""Scans, quantiles, spatial joins and graph rounds against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from swathe.operators import graph, joins
from swathe.operators.ordered import blocked_scan, sequence_number
from swathe.operators.quantiles import exact_quantiles

c = F.col


def cloud(n, seed, span=3.0, keys=2):
    r = np.random.default_rng(seed)
    p = r.uniform(0, span, (n, 3)).round(3)
    return pd.DataFrame({"key": np.arange(n) % keys, "id": np.arange(n), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_blocked_scan_equals_a_plain_window(spark, block):
    df = spark.range(60).select((c("id") % 2).alias("g"), c("id").alias("k"), F.when(c("id") % 5 != 1, (c("id") * 7 % 11).cast("double")).alias("v"))
    specs = {n: (n, c("v")) for n in ("lag", "lead", "sum", "max", "min", "last")}
    got = blocked_scan(df, ["g"], "k", specs, block=block)
    w = Window.partitionBy("g").orderBy("k")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("g", "k", "v", F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"), F.sum("v").over(upto).alias("sum"), F.max("v").over(upto).alias("max"),
                     F.min("v").over(upto).alias("min"), F.last("v", True).over(upto).alias("last"))
    assert got.orderBy("k").collect() == want.orderBy("k").collect()


def test_sequence_number(spark):
    df = spark.range(50).select((c("id") * 37 % 50).alias("a"), (c("id") % 3).alias("b"))
    rows = sequence_number(df, ["a", "b"], "n", block=4).orderBy("a", "b").collect()
    assert [r["n"] for r in rows] == list(range(50))


def test_exact_quantiles_with_a_hot_value(spark):
    df = spark.range(3000).select((c("id") % 3).alias("g"), F.when(c("id") % 2 == 0, 0.5).otherwise(c("id") / 997).alias("v"))
    got = exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "d": 0.95}, 0.05).orderBy("g").collect()
    want = df.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in (("a", 0.1), ("b", 0.5), ("d", 0.95))]).orderBy("g").collect()
    for p, q in zip(got, want):
        assert all(abs(p[n] - q[n]) < 1e-12 for n in "abd")


def test_radius_pairs_and_nearest_and_knn(spark):
    pdf = cloud(160, 1)
    df = spark.createDataFrame(pdf)
    p = pdf[["x", "y", "z"]].to_numpy()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    same = pdf["key"].to_numpy()[:, None] == pdf["key"].to_numpy()[None]
    pairs = {(r["a_id"], r["b_id"]) for r in joins.radius_pairs(df, ["key"], ["id"], 0.6).collect()}
    want = {(i, j) for i in range(160) for j in range(i + 1, 160) if same[i, j] and d[i, j] <= 0.6}
    assert pairs == want and joins.radius_pairs(df.repartition(17), ["key"], ["id"], 0.6).count() == len(want)
    other = pdf.assign(id=pdf["id"] + 1000, x=pdf["x"] + 0.11)
    near = {r["id"]: r["near_id"] for r in joins.bounded_nearest(df, spark.createDataFrame(other), ["key"], "id", 0.3).collect()}
    q = other[["x", "y", "z"]].to_numpy()
    e = np.where(same, np.sqrt(((p[:, None] - q[None]) ** 2).sum(2)), np.inf)
    for i in range(160):
        assert near[i] == (1000 + e[i].argmin() if e[i].min() <= 0.3 else None)
    got = {}
    for r in joins.knn(df, ["key"], "id", 5, 0.3).collect():
        got.setdefault(r["id"], set()).add(r["near_id"])
    e = np.where(same, d, np.inf)
    np.fill_diagonal(e, np.inf)
    assert all(got[i] == set(np.argsort(e[i], kind="stable")[:5]) for i in range(160))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    v = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 160), 500]], "id long")
    e = spark.createDataFrame(edges, "a_id long, b_id long")
    got = {r["id"]: r["component"] for r in graph.connected_components(v, e).collect()}
    assert got[40] == 0 and got[159] == 100 and got[500] == 500 and len(set(got.values())) == 3


@pytest.mark.parametrize("strict", [False, True])
def test_greedy_select_equals_the_loop(spark, strict):
    pdf = cloud(250, 5, span=4.0)
    pdf.loc[pdf.index % 3 == 0, ["x", "y", "z"]] = [1.0, 1.0, 1.0]  # a third of all rows in one place
    rank = np.random.default_rng(2).permutation(len(pdf))
    pdf["o"] = rank
    kept = []
    for r in pdf.sort_values("o").itertuples():
        near = [k for k in kept if k.key == r.key and ((np.array([k.x, k.y, k.z]) - [r.x, r.y, r.z]) ** 2).sum() ** 0.5 < 0.8 + (0 if strict else 1e-12)]
        if not near:
            kept.append(r)
    got = graph.greedy_select(spark.createDataFrame(pdf), ["key"], ["o"], 0.8, strict=strict)
    assert sorted(r["o"] for r in got.collect()) == sorted(k.o for k in kept)
