"""Neighbour searches copy a row to at most eight cells and stay exact."""

from pyspark.sql import functions as F

from swathe.operators import joins as jn


def test_searches_are_exact_with_few_copies(spark):
    p = spark.range(60).select(F.lit(0).alias("run"), "id", *[F.round(F.rand(s) * 6 - 3, 3).alias(a) for s, a in enumerate("xyz")])
    rows = [(r.id, (r.x, r.y, r.z)) for r in p.collect()]
    copies, ones = jn._reach(p, p, ["run"], ["id"], ["id"], ("x", "y", "z"), 0.7)
    assert copies.count() <= 8 * len(rows) and ones.count() == len(rows)
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    want = {i: [j for _, j in sorted((far(a, b), j) for j, b in rows if j != i)[:3]] for i, a in rows}
    got = {i: [] for i, _ in rows}
    for r in jn.knn(p, ["run"], "id", 3, 0.7).orderBy("id", "nn").collect():
        got[r.id].append(r.near_id)
    assert got == want
