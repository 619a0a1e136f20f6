"""Nearest neighbours along shifted Hilbert curves.

Each curve rotates and projects the unit vectors to a few coordinates, shifts
and quantises them and orders them by their Hilbert key. Rows are
range-partitioned by key and ranked; a query meets the rows of the windows around its
rank on every curve, and these are ranked by their exact cosine. That gives
every query a bound: its k-th best score so far. Rows outside the windows are
compared in blocks against this bound alone: a row is left out when the
projections show, by Cauchy and Schwarz, that it can't reach the bound, and
scored otherwise, so the result is exact whatever the windows have missed.

Equal vectors are one row, of which the k + 1 smallest ids matter.

Column expressions only; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

CURVES, COORDINATES, LEVELS = 4, 6, 5
WINDOW = 256
QUERY_BLOCK, BASE_PARTS = 1024, 24
#: Vectors up to this length are laid out as columns; longer ones stay arrays.
FLAT = 160
SLACK = 1e-9
c = F.col


def rotations(dims: int) -> np.ndarray:
    """Orthonormal directions of each curve (curve, coordinate, dimension), a fixed choice."""
    rng = np.random.default_rng(5)
    return np.stack([np.linalg.qr(rng.standard_normal((dims, min(COORDINATES, dims))))[0].T for _ in range(CURVES)])


def hilbert_key(x: str, n: int, levels: int) -> str:
    """SQL for the Hilbert index of n cell coordinates (array ``x``) of ``levels`` bits each, after Skilling's transposed form."""
    q = f"shiftleft(1, {levels} - 1 - s div {n})"
    swap = (
        f"CASE WHEN (a[s % {n}] & {q}) <> 0 THEN transform(a, (v, j) -> CASE WHEN j = 0 THEN v ^ ({q} - 1) ELSE v END) "
        f"ELSE transform(a, (v, j) -> CASE WHEN s % {n} = 0 THEN v WHEN j = 0 OR j = s % {n} THEN v ^ ((a[0] ^ a[s % {n}]) & ({q} - 1)) ELSE v END) END"
    )
    turned = f"aggregate(sequence(0, {n * (levels - 1) - 1}), {x}, (a, s) -> {swap})"
    gray = f"transform({turned}, (v, j) -> aggregate(slice(g, 1, j + 1), 0, (t, u) -> t ^ u))".replace(turned, "g")
    last = f"aggregate(sequence(1, {levels - 1}), 0, (t, b) -> CASE WHEN (element_at(h, {n}) & shiftleft(1, b)) <> 0 THEN t ^ (shiftleft(1, b) - 1) ELSE t END)"
    woven = f"aggregate(sequence(0, {n * levels - 1}), 0L, (k, s) -> k * 2 + (shiftright(z[s % {n}], {levels} - 1 - s div {n}) & 1))"
    # One-element arrays bind the steps' results to names.
    return f"transform(transform(transform(array({turned}), g -> {gray}), h -> transform(h, v -> v ^ {last})), z -> {woven})[0]"


def _dot(vector: str, direction: np.ndarray):
    weights = F.array(*[F.lit(float(w)) for w in direction])
    return F.aggregate(F.zip_with(vector, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v, norm) of vectors that can be compared, in doubles.

    Null, zero and non-finite vectors, rows without vec_id, and vectors of another
    length than most (of equally many, the longer) take no part.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(c("vec_id").cast("long").alias("id"), v.alias("v")).where(c("id").isNotNull() & c("v").isNotNull())
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where((F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("norm > 0 and norm < double('infinity')")
    length = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1)
    return rows.join(F.broadcast(length.select("dims")), F.size("v") == c("dims"))  # one row


def _laid_out(rows: DataFrame, dims: int, prefix: str, others: list[str]) -> DataFrame:
    names = [F.coalesce(c("v")[i], F.lit(0.0)).alias(f"{prefix}{i}") for i in range(dims)] if dims <= FLAT else [c("v").alias(prefix)]
    return rows.select(*others, *names)


def _cosine(dims: int):
    """Exact cosine of q (columns q0.. and qn) and b."""
    if dims <= FLAT:
        dot = reduce(lambda s, x: s + x, [c(f"q{i}") * c(f"b{i}") for i in range(dims)])
    else:
        dot = F.aggregate(F.zip_with("q", "b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return dot / (c("qn") * c("bn"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest rows, by cosine, of every row whose vec_id is divisible by ``every``.

    ``vectors``: vec_id (long) and embedding. Returns query_id, rank (from 1),
    vec_id, score and ``from_windows`` (whether the windows alone had found
    the row), nearest first, ties to the smaller vec_id; fewer rows if there are
    fewer candidates. A query never meets rows of its own vec_id; repeated rows count once.
    See ``usable`` for the vectors that take no part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).select("id", "v", "norm").distinct()
    same = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(same)).where(c("n") <= k + 1)
    classes = few.groupBy("v").agg(F.min("id").alias("class"), F.max("norm").alias("norm"), F.array_sort(F.collect_list("id")).alias("ids"))
    head = rows.select(F.size("v")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double, from_windows boolean"
    if not head:
        return spark.createDataFrame([], schema)
    dims = head[0][0]
    turns = rotations(dims)
    n = turns.shape[1]
    unit = F.transform("v", lambda x: x / c("norm"))
    shadows = [F.array(*[_dot("u", turns[i][j]) for j in range(n)]) for i in range(CURVES)]
    base = cut(classes.withColumn("u", unit).select("class", "ids", "v", "norm", F.array(*shadows).alias("shadows")), "classes")
    asked = rows.where(c("id") % every == 0).select("id", "v")
    queries = cut(asked.groupBy("v").agg(F.count(F.lit(1)).alias("asking")).join(base, "v"), "queries")
    members = asked.join(base.select("v", "class"), "v").select("id", "class")

    # Cells: about three standard deviations of a unit vector's coordinate on either side, shifted per curve.
    side = 1 << LEVELS
    cell = lambda x, i: F.least(F.greatest(F.floor((x * (dims**0.5) / 3 + 1 + i / CURVES / side) * (side / 2)), F.lit(0)), F.lit(side - 1)).cast("int")
    keyed = base.select("class", F.posexplode("shadows").alias("curve", "at")).select("class", "curve", F.transform("at", lambda x: cell(x, c("curve"))).alias("cells"))
    keyed = keyed.select("class", "curve", F.expr(hilbert_key("cells", n, LEVELS)).alias("key"))
    dealt = cut(keyed.repartitionByRange("curve", "key", "class").select("*", F.spark_partition_id().alias("part")), "curves")
    inner = Window.partitionBy("part", "curve").orderBy("key", "class")
    parts = dealt.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("n", F.row_number().over(inner)).join(parts.select("curve", "part", before.alias("before")), ["curve", "part"])
    ranked = ranked.select("class", "curve", F.floor((c("before") + c("n") - 1) / WINDOW).alias("window"))

    flat_base = _laid_out(base, dims, "b", [c("class").alias("near"), c("norm").alias("bn")])
    flat_query = _laid_out(queries, dims, "q", [c("class").alias("query"), c("norm").alias("qn")])
    sides = F.explode(F.array(c("window") - 1, c("window"), c("window") + 1))
    placed = ranked.join(queries.select("class"), "class").select(c("class").alias("query"), "curve", sides.alias("window"))
    left = placed.join(flat_query, "query")
    right = ranked.select(c("class").alias("near"), "curve", "window").join(flat_base, "near")
    met = left.join(right, ["curve", "window"]).select("query", "near", _cosine(dims).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "near")
    # A class can be met on every curve, so that many repeats may stand before the k + 1 different ones.
    short = met.withColumn("n", F.row_number().over(best)).where(c("n") <= (k + 1) * CURVES).select("query", "near", "score").distinct()
    short = cut(short.withColumn("n", F.row_number().over(best)).where(c("n") <= k + 1).select("query", "near", "score"), "windows")

    bound = short.groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(F.lit(-2.0)).alias("bound"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shadow = lambda p: [c("shadows")[0][j].alias(f"{p}s{j}") for j in range(n)]
    rest = lambda p: F.sqrt(F.greatest(F.lit(0.0), 1 - sum((c("shadows")[0][j] * c("shadows")[0][j] for j in range(n)), F.lit(0.0)))).alias(f"{p}r")
    asks = queries.join(bound, queries["class"] == bound["query"]).drop("query")
    asks = _laid_out(asks, dims, "q", [c("class").alias("query"), c("norm").alias("qn"), "bound", *shadow("q"), rest("q")])
    asks = asks.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(BASE_PARTS - 1))))
    held = _laid_out(base, dims, "b", [c("class").alias("near"), c("norm").alias("bn"), *shadow("b"), rest("b")])
    held = held.withColumn("part", F.pmod(F.xxhash64("near"), F.lit(BASE_PARTS)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    reachable = reduce(lambda s, x: s + x, [c(f"qs{j}") * c(f"bs{j}") for j in range(n)]) + c("qr") * c("br") >= c("bound") - SLACK
    pair = asks.alias("q").join(held.alias("b"), (c("q.block") == c("b.block")) & (c("q.part") == c("b.part")) & reachable & (_cosine(dims) >= c("bound")))
    closer = pair.select("query", "near", _cosine(dims).alias("score")).withColumn("n", F.row_number().over(best)).where(c("n") <= k + 1).select("query", "near", "score")

    found = closer.join(short.select("query", "near", F.lit(True).alias("early")), ["query", "near"], "left")
    named = found.join(base.select(c("class").alias("near"), "ids"), "near").select("query", "score", F.explode("ids").alias("vec_id"), F.coalesce("early", F.lit(False)).alias("from_windows"))
    own = members.join(named, members["class"] == named["query"]).where("vec_id <> id")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k).select(c("id").alias("query_id"), "rank", "vec_id", "score", "from_windows")
