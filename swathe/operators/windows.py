"""Sessions, chains, slots and histories of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import norm
from ..session import cut
from .ordered import blocked_scan, islands

c = F.col


def sessionize(df: DataFrame, keys: list[str], order: str, stamp: str, max_gap_ns: int = 150_000_000, same: list[str] = (), name: str = "generation", ties: list[str] = ()) -> DataFrame:
    """Session number per key: a new one starts where the stamp does not advance by (0, max_gap)
    or a column in ``same`` changes."""
    lags = {f"__l{i}": ("lag", c(x)) for i, x in enumerate([stamp, *same])}
    d = c(stamp) - c("__l0")
    cont = (d > 0) & (d < max_gap_ns)
    for i, x in enumerate(same, 1):
        cont = cont & c(x).eqNullSafe(c(f"__l{i}"))
    df = blocked_scan(df, keys, order, lags, ties=ties)
    starts = c("__l0").isNotNull() & ~cont
    return islands(df, keys, order, starts, name, ties=ties).drop(*lags)


def valid_edges(frames: DataFrame, keys: list[str], max_dt_s: float = 0.3, max_step: float = 5.0, max_speed: float = 50.0) -> DataFrame:
    """``edge``: this frame continues the previous one (both poses accepted, short in time and space)."""
    names = ["header_time_ns", "tx", "ty", "tz", "pose_status"]
    f = blocked_scan(frames, keys, "frame", {f"__{n}": ("lag", c(n)) for n in names})
    f = f.withColumns({"__dt": (c("header_time_ns") - c("__header_time_ns")) / 1e9, "__ds": norm(tuple(c("t" + a) - c("__t" + a) for a in "xyz"))})
    ok = c("pose_status").isin("ok", "origin") & c("__pose_status").isin("ok", "origin")
    edge = ok & (c("__dt") > 0) & (c("__dt") <= max_dt_s) & (c("__ds") <= max_step) & (c("__ds") <= max_speed * c("__dt"))
    return f.withColumn("edge", F.coalesce(edge, F.lit(False))).drop(*[f"__{n}" for n in names], "__dt", "__ds")


def chains(frames: DataFrame, keys: list[str], **kw) -> DataFrame:
    """Chain number per frame: stretches of valid edges."""
    f = valid_edges(frames, keys, **kw)
    return islands(f, keys, "frame", ~c("edge"), "chain")


def slot_targets(frames: DataFrame, keys: list[str], hz: int, stamp: str = "header_time_ns") -> DataFrame:
    """Slots of 1/hz s since the first stamp; the first frame of a new slot is a target, and its
    batch starts after the previous target."""
    from ..functions.numeric import slot_number

    first = frames.groupBy(*keys).agg(F.min(stamp).alias("__first"))
    f = frames.join(first, keys).withColumn("slot", slot_number(c(stamp), c("__first"), hz))
    f = blocked_scan(f, keys, "frame", {"__top": ("max", c("slot"))})
    f = blocked_scan(f, keys, "frame", {"__before": ("lag", c("__top"))})
    f = f.withColumn("target", c("__before").isNull() | (c("slot") > c("__before")))
    f = blocked_scan(f, keys, "frame", {"__t": ("last", F.when(c("target"), c("frame")))})
    f = blocked_scan(f, keys, "frame", {"__prev": ("lag", c("__t"))})
    return f.withColumn("batch_start", F.when(c("target"), c("__prev") + 1)).drop("__first", "__top", "__before", "__t", "__prev")


def causal_history(frames: DataFrame, keys: list[str], n: int = 12) -> DataFrame:
    """Frames T, T-1, ... of the same chain, at most ``n``: one row per (frame, source) with its age.

    An equi-join on the frame number of each wanted age; chains never meet.
    """
    f = frames.select(*keys, "chain", "frame")
    want = f.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("source", c("frame") - c("age"))
    return want.join(f.withColumnRenamed("frame", "source"), [*keys, "chain", "source"]).select(*keys, "chain", "frame", "source", "age")


def history_span(frames: DataFrame, keys: list[str], n: int | None = None, distance: float | None = None) -> DataFrame:
    """The history of every frame as a span: from_frame, the number of frames and the reason it ended.

    A history goes back from the frame along its chain (``chains``), over at most ``n`` frames or, with ``distance``, until a frame
    lies farther than that from the frame itself. ``reason`` is FRAME_LIMIT, DISTANCE_LIMIT, TIME_OR_POSE_GAP or RUN_START.
    Frames are numbered without holes in a run; rows with a null key are left out. A span is one row however long a train stands.

    With ``distance``: two frames are never farther apart than the way travelled between them. So all frames within the
    wanted distance on the way belong to the span unseen, and the first one beyond is found by a scan in order of the way; if it lies inside,
    what is left of the distance is the next stretch that can be skipped. A straight run takes two rounds.
    """
    if (n is None) == (distance is None):
        raise ValueError("give either n or distance")
    runs = frames.groupBy(*keys).agg(F.min("frame").alias("__run_first"))
    spans = frames.groupBy(*keys, "chain").agg(F.min("frame").alias("__first"))
    ended = F.when(c("__first") > c("__run_first"), "TIME_OR_POSE_GAP").otherwise("RUN_START")
    if n is not None:
        f = frames.select(*keys, "chain", "frame").join(spans, [*keys, "chain"]).join(runs, keys)
        begin = F.greatest(c("__first"), c("frame") - (n - 1))
        full = (c("frame") - (n - 1) >= c("__first")) & (c("frame") - (n - 1) > c("__run_first"))
        reason = F.when(full, "FRAME_LIMIT").otherwise(ended)
        return f.select(*keys, "chain", "frame", begin.alias("from_frame"), (c("frame") - begin + 1).alias("frames"), reason.alias("reason"))

    way = [*keys, "chain"]
    f = blocked_scan(frames.select(*way, "frame", "tx", "ty", "tz"), way, "frame", {f"__l{a}": ("lag", c("t" + a)) for a in "xyz"})
    f = f.withColumn("__step", F.coalesce(norm(tuple(c("t" + a) - c("__l" + a) for a in "xyz")), F.lit(0.0)))
    f = cut(blocked_scan(f, way, "frame", {"__way": ("sum", c("__step"))}).select(*way, "frame", "__way", "tx", "ty", "tz"), "history")
    # Frames of a standing train share a place on the way and so their history's start.
    place = F.min_by(F.struct("tx", "ty", "tz"), "frame").alias("p")
    places = cut(f.groupBy(*way, "__way").agg(place, F.max("frame").alias("__last")), "history")
    here = F.struct(c("__way").alias("way"), c("p"), c("__last").alias("last"))
    marks = places.select(*way, c("__way").alias("__o"), F.lit(1).alias("__kind"), here.alias("__mark"), F.lit(None).cast("double").alias("__way"), F.lit(None).cast(places.schema["p"].dataType).alias("p"))
    todo = places.select(*way, F.least(c("__way"), c("__way") - distance + 1e-6).alias("__o"), "__way", "p")
    found = None
    while True:
        asked = todo.withColumns({"__kind": F.lit(0), "__mark": F.lit(None).cast(marks.schema["__mark"].dataType)})
        seen = blocked_scan(marks.unionByName(asked), way, "__o", {"__hit": ("last", c("__mark"))}, block=256 * distance, ties=["__kind"]).where(c("__kind") == 0)
        apart = norm(tuple(c(f"p.t{a}") - c(f"__hit.p.t{a}") for a in "xyz"))
        seen = cut(seen.select(*way, "__way", "p", "__hit", apart.alias("__d")), "history")
        over = c("__hit").isNull() | (c("__d") > distance + 1e-10)
        done = seen.where(over).select(*way, "__way", c("__hit.last").alias("__beyond"))
        found = done if found is None else found.unionByName(done)
        todo = seen.where(~over).select(*way, (c("__hit.way") - F.greatest(F.lit(0.0), distance - c("__d") - 1e-6)).alias("__o"), "__way", "p")
        if todo.isEmpty():
            break
    out = f.join(found, [*way, "__way"]).join(spans, way).join(runs, keys)
    begin = F.coalesce(c("__beyond") + 1, c("__first"))
    reason = F.when(c("__beyond").isNotNull(), "DISTANCE_LIMIT").otherwise(ended)
    return out.select(*way, "frame", begin.alias("from_frame"), (c("frame") - begin + 1).alias("frames"), reason.alias("reason"))


def trailing(df: DataFrame, keys: list[str], order: str, depth: int, skip: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over the previous rows ``order - depth + 1 .. order - skip`` of a dense whole-number order.

    Works by equi-join on the order number, so one long key spreads over all tasks. The rows
    looked at carry the prefix ``b_``.
    """
    b = df.select(*keys, c(order).alias("__o"), *[c(n).alias("b_" + n) for n in df.columns if n not in (*keys, order)])
    a = df.select(*keys, order, F.explode(F.sequence(c(order) - (depth - 1), c(order) - skip)).alias("__o"))
    return a.join(b, [*keys, "__o"]).groupBy(*keys, order).agg(*[e.alias(n) for n, e in aggs.items()])


def top_candidates(df: DataFrame, keys: list[str], score: str, id_: str, k: int, distinct: Column, fields: list[str], alone: float = 3.0) -> DataFrame:
    """Best ``k`` rows per key with rank ``rk`` and the lead of the best over the best row that is
    ``distinct`` from it (``__best.<field>``); ``alone`` if there is none."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(c(score).desc(), c(id_))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(score, id_, *fields), F.struct(score, -c(id_))).alias("__best"))
    other = df.join(best, keys).where((c(id_) != c(f"__best.{id_}")) & distinct)
    other = other.groupBy(*keys).agg(F.max(score).alias("__other"))
    top = df.withColumn("rk", F.row_number().over(w)).where(c("rk") <= k)
    out = top.join(best, keys).join(other, keys, "left")
    lead = c(f"__best.{score}") - F.coalesce(c("__other"), c(f"__best.{score}") - alone)
    return out.withColumn("margin", lead).drop("__best", "__other")


def first_confirm_last(obs: DataFrame, keys: list[str]) -> DataFrame:
    """First, second-distinct and last frame per track; the first observation's place and the
    densest observation (first on ties)."""
    per = obs.groupBy(*keys, "source_frame").agg(
        F.min_by("wx", "obs_id").alias("x"),
        F.max_by("obs_id", F.struct("voxel_count", "point_count", -c("obs_id"))).alias("best"),
        F.max(F.struct("voxel_count", "point_count")).alias("size"),
    )
    first = per.groupBy(*keys).agg(F.min("source_frame").alias("first_frame"))
    second = per.join(first, keys).where(c("source_frame") > c("first_frame")).groupBy(*keys).agg(F.min("source_frame").alias("confirmed_frame"))
    out = per.groupBy(*keys).agg(
        F.min("source_frame").alias("first_frame"), F.max("source_frame").alias("last_frame"), F.count(F.lit(1)).alias("frames"),
        F.min_by("x", "source_frame").alias("first_x"),
        F.max_by("best", F.struct("size.voxel_count", "size.point_count", -c("source_frame"))).alias("size_obs"),
    )
    return out.join(second, keys, "left")


def even_sample(df: DataFrame, keys: list[str], order: str, n: int, block: int = 65536) -> DataFrame:
    """Rows at the ``n`` evenly spaced ranks ``floor(i (N-1) / (n-1))``; all rows of smaller groups."""
    r = blocked_scan(df, keys, order, {"__r": ("sum", F.lit(1).cast("long"))}, block=block)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    r = r.join(size, keys).withColumn("__r", c("__r") - 1)
    # Rank r is taken when some i maps to it: the smallest i with i (N-1)/(n-1) >= r does.
    i = F.ceil(c("__r") * (n - 1) / (c("__n") - 1))
    take = F.floor(i * (c("__n") - 1) / float(n - 1)) == c("__r")
    return r.where((c("__n") <= n) | F.coalesce(take, F.lit(False))).select(*df.columns)


def beam_top(df: DataFrame, keys: list[str], score: str, id_: str, same: list[Column], k: int = 3) -> DataFrame:
    """Best ``k`` branches per key after equal ones (same values of ``same``) collapse to the best of them.

    Collapsing is a combinable maximum, and the rank limit runs on the map side too.
    """
    from pyspark.sql import Window

    names = [f"__s{i}" for i in range(len(same))]
    d = df.select(*keys, score, id_, *[e.alias(n) for e, n in zip(same, names)])
    best = d.groupBy(*keys, *names).agg(F.max(F.struct(c(score), (-c(id_)).alias("n"))).alias("b"))
    best = best.select(*keys, c(f"b.{score}").alias(score), (-c("b.n")).alias(id_))
    w = Window.partitionBy(*keys).orderBy(c(score).desc(), id_)
    return best.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)
