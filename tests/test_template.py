"""Distances to a template move no rows while the template is small."""

from pyspark.sql import functions as F

from swathe.operators.joins import offset_grid, shifted, template_distance


def test_points_are_neither_dealt_anew_nor_grouped(spark):
    points = spark.range(500).select("id", (F.rand(1) * 0.4 - 0.1).alias("v"), (F.rand(2) * 0.4 - 0.1).alias("w"))
    template = spark.range(40).select(F.col("id").cast("int").alias("cell"), (F.col("id") % 8 * 0.02).alias("v"), (F.floor(F.col("id") / 8) * 0.03).alias("w"))
    rows = shifted(points, offset_grid(spark, 0.02, 0.02))
    d = template_distance(rows, template, ["id", "ov", "ow"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "HashAggregate" not in plan
    cells = [(r.cell, r.v, r.w) for r in template.collect()]
    want = {}
    for r in rows.collect():
        near = min((((r.v - v) ** 2 + (r.w - w) ** 2) ** 0.5, cell) for cell, v, w in cells)
        want[r.id, r.ov, r.ow] = (round(near[0], 9), near[1]) if near[0] <= 0.05 else (0.05, None)
    assert {(r.id, r.ov, r.ow): (round(r.d, 9), r.cell) for r in d.collect()} == want
