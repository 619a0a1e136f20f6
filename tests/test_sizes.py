"""Tables read from files are broadcast on the driver only when they are really small."""

from pyspark.sql import functions as F

from swathe.functions.cells import cell_of, explode_neighbours
from swathe.functions.vector import vec
from swathe.operators.joins import radius_pairs
from swathe.session import BROADCAST_FILES, cut


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_cell_are_not_gathered(spark):
    p = spark.range(200).select(F.lit(0).alias("run"), "id", *[F.rand(s).alias(a) for s, a in enumerate("xyz")])
    p = cut(p, "few")
    pairs = radius_pairs(p, ["run"], ["id"], 0.1)
    assert "BroadcastHashJoin" not in plan(pairs) and pairs.count() > 0
    cells = p.select("run", "id", *cell_of(vec("x", "y", "z"), 0.1))
    assert "BroadcastHashJoin" not in plan(cells.join(explode_neighbours(cells, 1), ["run", "ci", "cj", "ck"]))


def test_compressed_files_are_not_taken_for_small_tables(spark):
    wide = cut(spark.range(400_000, numPartitions=4).select("id", *[F.lit(float(i)).alias(f"v{i}") for i in range(20)]), "wide")
    read = wide._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert BROADCAST_FILES < int(str(read)) < 10 << 20  # 64 MB of rows in files below the planner's own limit
    other = spark.range(400_000).withColumn("w", F.col("id") + 1)
    assert "BroadcastHashJoin" not in plan(other.join(wide, "id"))
    few = cut(spark.range(50).withColumn("w", F.col("id") + 1), "few")
    assert "BroadcastHashJoin" in plan(other.join(few, "id"))
