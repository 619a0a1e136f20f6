"""Accuracy studies: gates, bootstraps, rankings, calibration and audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import average_rank
from ..operators.ordered import blocked_scan
from ..operators.quantiles import exact_quantiles, sorted_quantile
from ..session import cut, dealt

c = F.col


def range_edge(edges: list[float], r: str = "range_m") -> Column:
    lo = F.lit(None).cast("double")
    for a, b in zip(edges[:-1], edges[1:]):
        lo = F.when((c(r) >= a) & (c(r) < b), F.lit(float(a))).otherwise(lo)
    return lo


def acceptance_gate(stations: DataFrame, edges: list[float], over: float, extra_share: float, degradation: float, availability: float) -> DataFrame:
    """Method B against A on matched starts: newly bad starts, worst p95 loss over range bins,
    lost availability, and the verdict. One row."""
    ok = stations.where("evaluable")
    start = ok.groupBy("run", "frame").agg(
        F.bool_or(F.when(c("method") == "A", c("error_m") > over)).alias("a"), F.bool_or(F.when(c("method") == "B", c("error_m") > over)).alias("b"))
    start = start.where(c("a").isNotNull() & c("b").isNotNull()).agg(F.count(F.lit(1)).alias("starts"), F.count_if(c("b") & ~c("a")).alias("extra"))
    q = exact_quantiles(ok.withColumn("lo", range_edge(edges)), ["lo", "method"], "error_m", {"p": 0.95}, 0.01)
    q = q.groupBy("lo").agg((F.max(F.when(c("method") == "B", c("p"))) - F.max(F.when(c("method") == "A", c("p")))).alias("d"))
    q = q.agg(F.max("d").alias("worst_degradation_m"))
    share = lambda m: F.avg(F.when(c("method") == m, c("evaluable").cast("double")))
    loss = stations.agg((share("A") - share("B")).alias("loss"))
    out = start.crossJoin(q).crossJoin(loss)  # three one-row aggregates
    passed = (c("extra") <= c("starts") * extra_share) & (c("worst_degradation_m") <= degradation) & (c("loss") <= availability)
    return out.withColumn("passed", passed)


def block_draws(df: DataFrame, keys: list[str], replicates: int = 1000, block: int = 20, seed: int = 17) -> DataFrame:
    """How often each replicate draws each block of frames: as many draws per run as the run has blocks, with replacement.

    A draw is read from the MD5 of keys, run, number of the draw, replicate and seed, so it repeats exactly.
    """
    from pyspark.sql import Window

    have = df.select(*keys, "run", F.floor(c("frame") / block).alias("blk")).distinct()
    w = Window.partitionBy(*keys, "run")
    have = cut(have.select("*", (F.row_number().over(w.orderBy("blk")) - 1).alias("slot"), F.count(F.lit(1)).over(w).alias("blocks")), "blocks")
    one = dealt(have, [*keys, "run"], replicates).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    text = F.concat_ws(":", *[c(k) for k in keys], "run", "slot", "rep", F.lit(seed))
    pick = F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), c("blocks"))
    drawn = one.groupBy(*keys, "run", pick.alias("slot"), "rep").agg(F.count(F.lit(1)).alias("m"))
    return drawn.join(have.drop("blocks"), [*keys, "run", "slot"]).select(*keys, "run", "blk", "rep", "m")


def replicate_medians(df: DataFrame, draws: DataFrame, keys: list[str], value: str, block: int = 20) -> DataFrame:
    """The median of ``value`` in each replicate of ``block_draws``, exactly.

    Values get a code of three base-16 digits from their rank in the whole sample. Each round counts one digit per block,
    weighs blocks by their draws and keeps, per replicate, the digit that holds its median; only values of the codes found
    meet the draws themselves. A round costs blocks times replicates, not rows times replicates.
    """
    rows = df.where(c(value).isNotNull() & ~F.isnan(value)).select(*keys, "run", F.floor(c("frame") / block).alias("blk"), c(value).cast("double").alias("v"))
    rows = rows.groupBy(*keys, "run", "blk", "v").agg(F.count(F.lit(1)).alias("n"))
    rank = blocked_scan(rows.groupBy(*keys, "v").agg(F.sum("n").alias("n")), keys, "v", {"upto": ("sum", c("n"))}, block=0.01)
    total = rank.groupBy(*keys).agg(F.max("upto").alias("t"))
    code = rank.join(total, keys).select(*keys, "v", F.floor((c("upto") - c("n")) * 4096 / c("t")).alias("code"))
    rows = cut(rows.join(code, [*keys, "v"]), "values")
    state = None
    for place in (256, 16, 1):
        at = rows.withColumns({"prefix": F.floor(c("code") / (16 * place)), "digit": F.floor(c("code") / place) % 16})
        if state is not None:
            at = at.join(state.select(*keys, "prefix").distinct(), [*keys, "prefix"], "left_semi")
        per = at.groupBy(*keys, "run", "blk", "prefix").agg(*[F.sum(F.when(c("digit") == i, c("n")).otherwise(0)).alias(f"c{i}") for i in range(16)])
        hist = per.join(draws, [*keys, "run", "blk"]).groupBy(*keys, "rep", "prefix").agg(*[F.sum(c("m") * c(f"c{i}")).alias(f"c{i}") for i in range(16)])
        if state is None:
            all_ = sum((c(f"c{i}") for i in range(1, 16)), c("c0"))
            both = F.array_distinct(F.array(F.floor((all_ - 1) / 2), F.ceil((all_ - 1) / 2)))
            found = hist.withColumn("t", all_).where("t > 0").select("*", F.explode(both).alias("k"), F.lit(0).cast("long").alias("before"))
        else:
            found = hist.join(state, [*keys, "rep", "prefix"])
        upto, digit, below = c("before"), F.lit(0), c("before")
        for i in range(16):
            upto = upto + c(f"c{i}")
            digit = digit + (upto <= c("k")).cast("int")
            below = below + F.when(upto <= c("k"), c(f"c{i}")).otherwise(0)
        state = cut(found.select(*keys, "rep", "k", (c("prefix") * 16 + digit).alias("prefix"), below.alias("before")), "medians")
    left = rows.withColumnRenamed("code", "prefix").join(state.select(*keys, "prefix").distinct(), [*keys, "prefix"], "left_semi")
    seen = left.join(draws, [*keys, "run", "blk"]).join(state.select(*keys, "rep", "prefix").distinct(), [*keys, "rep", "prefix"])
    seen = seen.groupBy(*keys, "rep", "prefix", "v").agg(F.sum(c("m") * c("n")).alias("w"))
    run = blocked_scan(seen, [*keys, "rep", "prefix"], "v", {"upto": ("sum", c("w"))}, block=0.01)
    hit = run.join(state, [*keys, "rep", "prefix"]).where(c("before") + c("upto") > c("k")).groupBy(*keys, "rep", "k").agg(F.min("v").alias("v"))
    return hit.groupBy(*keys, "rep").agg(F.avg("v").alias("median"))


def block_bootstrap(df: DataFrame, keys: list[str], replicates: int = 1000, block: int = 20, value: str = "error_m", seed: int = 17) -> DataFrame:
    """95 % interval of the median of ``value`` when whole blocks of frames are drawn anew within each run.

    Blocks are ``floor(frame / block)``; blocks without a value are drawn too and add nothing.
    """
    draws = cut(block_draws(df, keys, replicates, block, seed), "draws")
    med = replicate_medians(df, draws, keys, value, block)  # one row per replicate
    return med.groupBy(*keys).agg(F.count(F.lit(1)).alias("replicates"), F.percentile("median", F.lit(0.025)).alias("lo"),
                                  F.percentile("median", F.lit(0.5)).alias("mid"), F.percentile("median", F.lit(0.975)).alias("hi"))


def residual_gate(df: DataFrame, keys: list[str], d: str, id_: str, limit: float = 0.03, weak_limit: float = 0.05, weak_robust: float = 0.04, cap: float = 0.06) -> DataFrame:
    """Quantiles and shares of overlap residuals, with the strong and weak verdict.

    One overlap is a few hundred rows at most.
    """
    from pyspark.sql import Window

    g = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(d)).alias("__l"),
        F.avg((c(d) <= 0.03).cast("double")).alias("f3"), F.avg((c(d) <= 0.04).cast("double")).alias("f4"),
        F.count(F.lit(1)).alias("__n"))
    # Squares are added one by one, as in the SQL: partial sums of capped residuals may end beside the cap's own square, a limit.
    squares = F.aggregate("__l", F.lit(0.0), lambda s, x: s + F.least(x, F.lit(cap)) * F.least(x, F.lit(cap)))
    robust = F.when(F.size("__l") > 0, F.sqrt(squares / F.size("__l")))
    g = g.select(*keys, sorted_quantile(c("__l"), 0.9).alias("p90"), sorted_quantile(c("__l"), 0.8).alias("p80"), "f3", "f4", robust.alias("robust"), "__n")
    w = Window.partitionBy(*keys).orderBy(d, id_)
    t = df.withColumn("__r", F.row_number().over(w)).join(g.select(*keys, "__n"), keys)
    t = t.where(c("__r") <= F.greatest(F.lit(1), F.floor(0.9 * c("__n")))).groupBy(*keys).agg(F.array_sort(F.collect_list(d)).alias("__l"))
    t = t.select(*keys, sorted_quantile(c("__l"), 0.9).alias("trimmed"))
    strong = c("p90") <= limit
    return g.join(t, keys).drop("__n").withColumns({"strong": strong, "weak": ~strong & (c("p90") <= max(weak_limit, limit)) & (c("robust") <= weak_robust)})


def compare_builds(a: DataFrame, b: DataFrame, keys: list[str], exact: list[str], close: list[str], tol: float = 1e-8) -> DataFrame:
    """Row-wise comparison of two builds: rows on one side only, unequal exact columns, largest float error. One row."""
    left = a.select(*keys, *[c(n).alias("a_" + n) for n in exact + close], F.lit(1).alias("__a"))
    right = b.select(*keys, *[c(n).alias("b_" + n) for n in exact + close], F.lit(1).alias("__b"))
    j = left.join(right, keys, "full_outer")
    both = c("__a").isNotNull() & c("__b").isNotNull()
    unequal = F.lit(False)
    for n in exact:
        unequal = unequal | ~c("a_" + n).eqNullSafe(c("b_" + n))
    errs = [F.coalesce(F.max(F.when(both, F.abs(c("a_" + n) - c("b_" + n)))), F.lit(0.0)).alias("max_err_" + n) for n in close]
    out = j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~both).alias("one_sided"), F.count_if(both & unequal).alias("unequal"), *errs)
    same = (c("one_sided") == 0) & (c("unequal") == 0)
    for n in close:
        same = same & (c("max_err_" + n) <= tol)
    return out.withColumn("same", same)


def variant_ablation(df: DataFrame, variant: str, keys: list[str], base: str, value: str) -> DataFrame:
    """Count and median per variant, and how much faster than the base variant's median."""
    q = exact_quantiles(df, [*keys, variant], value, {"median": 0.5}, 0.01)
    n = df.groupBy(*keys, variant).agg(F.count(F.lit(1)).alias("n"))
    b = q.where(c(variant) == base).select(*keys, c("median").alias("__b"))
    out = q.join(n, [*keys, variant]).join(b, keys, "left")
    return out.withColumn("speedup", F.when(c("median") > 0, c("__b") / c("median"))).drop("__b")


def split_cohort(df: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """Rows with their cohort; a key in two cohorts is counted as leaking and its rows marked."""
    leak = split.groupBy(key).agg(F.countDistinct("cohort").alias("__n"), F.min("cohort").alias("cohort"))
    return df.join(leak, key).withColumn("leaks", c("__n") > 1).drop("__n")


def range_starts(df: DataFrame, edges: list[float]) -> DataFrame:
    """Rows with the lower edge ``lo`` of their range block; rows outside all blocks go."""
    return df.withColumn("lo", range_edge(edges)).where(c("lo").isNotNull())


def start_strata(stations: DataFrame, starts: DataFrame, keys: list[str], curvature: str, pitch: str) -> DataFrame:
    """Starts with the bin of their median curvature and of their median grade; without a value the bin is ``unavailable``."""
    of = lambda v, name: exact_quantiles(stations, keys, v, {name: 0.5}, 0.01)
    steep = stations.withColumn("__p", F.abs(pitch))
    s = starts.join(of(curvature, "curvature"), keys, "left").join(exact_quantiles(steep, keys, "__p", {"grade_deg": 0.5}, 0.1), keys, "left")
    curve = F.when(c("curvature").isNull(), "unavailable").when(c("curvature") < 0.002, "near_straight").when(c("curvature") < 0.01, "mild").otherwise("strong")
    grade = F.when(c("grade_deg").isNull(), "unavailable").when(c("grade_deg") < 0.5, "<0.5deg").when(c("grade_deg") < 1.5, "0.5-1.5deg").otherwise(">=1.5deg")
    return s.withColumns({"curve_bin": curve, "grade_bin": grade})


def strata_metrics(starts: DataFrame, value: str, kinds: list[str], width: float) -> DataFrame:
    """Percentiles of ``value`` per bin of each kind of stratum."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), c(k).alias("bin")) for k in kinds])
    d = starts.select(value, F.explode(each).alias("__s")).select(value, "__s.kind", "__s.bin")
    n = d.groupBy("kind", "bin").agg(F.count(value).alias("n"), F.max(value).alias("most"))
    return n.join(exact_quantiles(d, ["kind", "bin"], value, {"p50": 0.5, "p90": 0.9, "p95": 0.95}, width), ["kind", "bin"], "left")


def rank_correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    r = average_rank(average_rank(df.select(*keys, x, y), keys, x, "__rx"), keys, y, "__ry")
    return r.groupBy(*keys).agg(F.corr("__rx", "__ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def run_utility(reach: DataFrame, baseline: str, margins: tuple = (4, 8, 20)) -> DataFrame:
    """Per variant and run: utility of the starts that are eligible and whose baseline start is, and what the ranking adds up.

    ``reach``: variant, run, frame, eligible, reach_m, bad (wrong segments), gt_m (how far the reference goes).
    A missing reach counts as 0. ``outcome`` adds up hashes of the outcomes: equal sums mean equal outcomes,
    but for a chance of about 1e-12 per pair of variants.
    """
    ok = reach.where("eligible").withColumns({"reach_m": F.coalesce("reach_m", F.lit(0.0)), "bad": F.coalesce("bad", F.lit(0))})
    b = ok.where(c("variant") == baseline).select("run", "frame", c("reach_m").alias("__b"))
    j = ok.join(b, ["run", "frame"]).withColumn("d", c("reach_m") - c("__b"))
    share = lambda cond: F.avg(cond.cast("double"))
    r, d, bad, far = c("reach_m"), c("d"), c("bad") > 0, F.coalesce(c("gt_m") >= 100, F.lit(False))
    utility = (2 * share(r >= 50) + 3 * share(r >= 75) + 5 * share(r >= 100) + F.avg(F.least(r, F.lit(120.0))) / 120
               - 10 * share(bad) - 2 * share(d < -4))
    return j.groupBy("variant", "run").agg(
        F.count(F.lit(1)).alias("n"), utility.alias("utility"), share(r >= 50).alias("p50"), F.count_if(bad).alias("catastrophic"),
        F.count_if(far).alias("gt100"), F.count_if(far & (r >= 100)).alias("reached100"),
        F.sum(F.pmod(F.xxhash64("run", "frame", F.round("reach_m", 6), "bad"), F.lit(1 << 40))).alias("outcome"),
        *[F.count_if(d > m).alias(f"w{m}") for m in margins], *[F.count_if(d < -m).alias(f"l{m}") for m in margins])


def variant_ranking(reach: DataFrame, baseline: str, margins: tuple = (4, 8, 20)) -> DataFrame:
    """Variants by mean utility over runs, with wins and losses against the baseline and the share that
    reaches 100 m where the reference does. Of variants with equal outcomes the first in rank stays."""
    from pyspark.sql import Window

    out = run_utility(reach, baseline, margins).groupBy("variant").agg(
        F.sum("n").alias("n"), F.avg("utility").alias("mean_utility"), F.median("utility").alias("median_utility"), F.min("utility").alias("worst_run"),
        F.min("p50").alias("worst_p50"), F.sum("catastrophic").alias("catastrophic"), F.sum("outcome").alias("__h"),
        F.when(F.sum("gt100") > 0, F.sum("reached100") / F.sum("gt100")).alias("conditional_100m"),
        *[F.sum(f"w{m}").alias(f"wins_{m}m") for m in margins], *[F.sum(f"l{m}").alias(f"losses_{m}m") for m in margins])
    order = [F.round("mean_utility", 9).desc(), F.round("median_utility", 9).desc(), c("worst_p50").desc(), "catastrophic", "variant"]
    # One row per variant: the list of variants is a fixed, small set.
    first = out.withColumn("__d", F.row_number().over(Window.partitionBy("__h").orderBy(*order))).where("__d = 1").drop("__d", "__h")
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def left_out_ranking(reach: DataFrame, baseline: str) -> DataFrame:
    """Per run: the variant that the other runs choose, its utility there and on the run itself.

    Sums less the run's own: variants times runs, not runs squared. Of equal scores the first name wins.
    """
    u = run_utility(reach, baseline)
    total = u.groupBy("variant").agg(F.sum("utility").alias("__t"), F.count(F.lit(1)).alias("__n"))
    grid = u.select("run").distinct().join(F.broadcast(total))  # one row per variant, a fixed, small set
    own = u.select("run", "variant", c("utility").alias("own"))
    g = grid.join(own, ["run", "variant"], "left")
    rest = F.try_divide(c("__t") - F.coalesce("own", F.lit(0.0)), c("__n") - c("own").isNotNull().cast("int"))
    g = g.withColumn("score", F.round(rest, 9)).where(c("score").isNotNull())
    best = g.groupBy("run").agg(F.min(F.struct((-c("score")).alias("s"), "variant", "own")).alias("b"))
    return best.select("run", c("b.variant").alias("variant"), (-c("b.s")).alias("score"), c("b.own").alias("own_utility"))


SCORE_EDGES = [30.0, 50.0, 75.0, 100.0]  # fixed values
WIDTH95 = 4.895  # fixed value: full width of a joint 95 % ellipse in standard deviations
LIMIT95 = 5.991464547  # fixed value: its squared radius


def run_scores(df: DataFrame) -> DataFrame:
    """Per method and run: the mean over range blocks with at least three rows of the p95 of the far rail's error,
    half the p95 of the centre's, and penalties for far errors over .2 m, wrong coverage and wide corridors.

    ``df``: method, run, range_m, far_error, center_error, inside95 (both rails within their ellipse), sigma_lateral, sigma_vertical.
    """
    keys = ["method", "run", "lo"]
    d = range_starts(df, SCORE_EDGES).withColumn("__w", WIDTH95 * (c("sigma_lateral") + c("sigma_vertical")) / 2)
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((c("far_error") > 0.2).cast("double")).alias("over"), F.avg(c("inside95").cast("double")).alias("cover"))
    b = n.where("n >= 3")
    for value, name, q in (("far_error", "far", 0.95), ("center_error", "centre", 0.95), ("__w", "wide", 0.5)):
        b = b.join(exact_quantiles(d, keys, value, {name: q}, 0.01), keys)
    value = c("far") + 0.5 * c("centre") + 0.2 * c("over") + 0.05 * F.abs(0.95 - c("cover")) + 0.02 * c("wide")
    return b.groupBy("method", "run").agg(F.avg(value).alias("run_score"), F.sum("n").alias("rows"))


def method_score(scores: DataFrame) -> DataFrame:
    """Per method: .7 of the mean run score and .3 of the worst; lower is better."""
    return scores.groupBy("method").agg((0.7 * F.avg("run_score") + 0.3 * F.max("run_score")).alias("score"), F.avg("run_score").alias("mean_run_score"),
                                        F.max("run_score").alias("worst_run_score"), F.count(F.lit(1)).alias("runs"))


def left_out_method(scores: DataFrame) -> DataFrame:
    """Per run: the method that the other runs choose, its score there and on the run itself.

    Means come from sums less the own value, the worst run from the two worst.
    """
    total = scores.groupBy("method").agg(F.sum("run_score").alias("__t"), F.count(F.lit(1)).alias("__n"), F.max(F.struct("run_score", "run")).alias("__w"))
    rest = scores.join(total, "method").where(c("run") != c("__w.run")).groupBy("method").agg(F.max("run_score").alias("__w2"))
    total = total.join(rest, "method", "left")
    grid = scores.select("run").distinct().join(F.broadcast(total))  # one row per method, a fixed, small set
    g = grid.join(scores.select("run", "method", c("run_score").alias("own")), ["run", "method"], "left")
    mean = F.try_divide(c("__t") - F.coalesce("own", F.lit(0.0)), c("__n") - c("own").isNotNull().cast("int"))
    worst = F.when(c("__w.run") == c("run"), c("__w2")).otherwise(c("__w.run_score"))
    g = g.withColumn("score", F.round(0.7 * mean + 0.3 * worst, 9)).where(c("score").isNotNull())
    best = g.groupBy("run").agg(F.min(F.struct("score", "method", "own")).alias("b"))
    return best.select("run", c("b.method").alias("method"), c("b.score").alias("score"), c("b.own").alias("own_score"))


def corridor_calibration(df: DataFrame, q: float = 0.95) -> DataFrame:
    """Factor per method that makes the 95 % ellipses cover ``q`` of the rows at 30 to 100 m, every start and every run
    weighing the same; at least 1. One row from all runs (``held_run`` null) and one per run from all the others,
    with the coverage and the corridor widths that this factor gives on the left-out run.

    ``df``: method, run, frame, range_m, near_mahal2, far_mahal2, sigma_lateral, sigma_vertical. Rows whose distances
    are null or not finite don't count for the factor and are not covered.

    A run weighs 1 in total, so without one run the wanted weight lies within 1 of where it lies with all of them.
    Only rows within 3 of it are repeated for the left-out runs: about six times the rows, however many runs there are.
    """
    fin = lambda n: c(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    both = F.when(fin("near_mahal2") & fin("far_mahal2"), F.greatest("near_mahal2", "far_mahal2"))
    d = df.where((c("range_m") >= 30) & (c("range_m") < 100)).withColumn("__m", both)
    ok = d.where(c("__m").isNotNull()).select("method", "run", "frame", F.sqrt(c("__m") / LIMIT95).alias("z"))
    start = ok.groupBy("method", "run", "frame").agg(F.count(F.lit(1)).alias("__n"))
    runs = start.groupBy("method", "run").agg(F.count(F.lit(1)).alias("__s"))
    w = ok.join(start, ["method", "run", "frame"]).join(runs, ["method", "run"]).withColumn("w", 1 / (c("__n") * c("__s")))
    stats = lambda d: [F.sum(d[0]).alias("w"), F.min(d[1]).alias("lo"), F.max(d[2]).alias("hi")]
    per = cut(w.groupBy("method", "run", "z").agg(*stats(["w", "w", "w"])), "calibration")
    methods = runs.groupBy("method").agg(F.count(F.lit(1)).alias("R"), F.collect_set("run").alias("held"))
    upto = blocked_scan(per.groupBy("method", "z").agg(F.sum("w").alias("w")), ["method"], "z", {"upto": ("sum", c("w"))}, block=0.01)
    upto = upto.join(methods.select("method", "R"), "method")
    close = upto.where((c("upto") >= q * (c("R") - 1) - 3) & (c("upto") - c("w") <= q * c("R") + 3))
    span = close.groupBy("method").agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    rows = per.join(span, "method")
    below = rows.where("z < z0").groupBy("method", "run").agg(F.sum("w").alias("b"))
    all_below = below.groupBy("method").agg(F.sum("b").alias("ab"))
    held = F.concat(F.array(F.lit(None).cast("int")), F.array_except("held", F.array(c("run").cast("int"))))
    near = rows.where("z between z0 and z1").join(methods, "method").select("method", "z", "w", "lo", "hi", F.explode(held).alias("h"))
    near = near.withColumn("h", F.coalesce(c("h").cast("string"), F.lit("all"))).groupBy("method", "h", "z").agg(*stats(["w", "lo", "hi"]))
    s = blocked_scan(near, ["method", "h"], "z", {"upto": ("sum", c("w")), "pz": ("lag", c("z")), "phi": ("lag", c("hi"))}, block=0.01)
    s = s.join(all_below, "method", "left").join(below.select("method", c("run").cast("string").alias("h"), "b"), ["method", "h"], "left")
    s = s.join(methods.select("method", "R"), "method")
    base = F.coalesce("ab", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    s = s.withColumns({"before": base + c("upto") - c("w"), "t": q * (c("R") - F.when(c("h") == "all", 0).otherwise(1))})
    first, last, prev = c("before") + c("lo") / 2, c("before") + c("w") - c("hi") / 2, c("before") - c("phi") / 2
    at = F.when(c("t") < first, F.when(c("pz").isNull(), c("z")).when(c("t") > prev, c("pz") + (c("z") - c("pz")) * (c("t") - prev) / (first - prev))).when(c("t") <= last, c("z"))
    got = s.groupBy("method", "h").agg(F.coalesce(F.max(at), F.max("z")).alias("scale"))
    want = methods.select("method", F.explode(F.concat(F.array(F.lit(None).cast("int")), "held")).alias("held_run"))
    want = want.withColumn("h", F.coalesce(c("held_run").cast("string"), F.lit("all")))
    scale = cut(want.join(got, ["method", "h"], "left").select("method", "held_run", F.greatest(F.lit(1.0), F.coalesce("scale", F.lit(1.0))).alias("scale")), "calibration")
    test = d.join(scale.where("held_run is not null").withColumnRenamed("held_run", "run"), ["method", "run"])
    inside = F.coalesce((c("__m") <= LIMIT95 * c("scale") * c("scale")).cast("double"), F.lit(0.0))
    starts = test.groupBy("method", "run", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum(inside).alias("i"))
    out = starts.groupBy("method", "run").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("starts"), (F.sum("i") / F.sum("n")).alias("coverage"))
    for side in ("lateral", "vertical"):
        width = test.withColumn("__v", WIDTH95 * c("sigma_" + side) * c("scale"))
        out = out.join(exact_quantiles(width, ["method", "run"], "__v", {"width_" + side: 0.5}, 0.01), ["method", "run"], "left")
    return scale.join(out.withColumnRenamed("run", "held_run"), ["method", "held_run"], "left")


def robust_slopes(df: DataFrame, x: str, y: str, scale: float = 0.02, limit: float = 20.0, levels: int = 5) -> DataFrame:
    """Per run: the slope through the origin that the other runs give under the loss sqrt(1 + r^2), r = (slope x - y) / ``scale``.

    The loss is convex, so its derivative changes sign once, and the derivative without a run is the whole one less the
    run's own. Each level evaluates it at 15 inner points of every interval that still holds a slope; left-out slopes
    lie close together, so few intervals are left however many runs there are. A row therefore meets these points, not all runs.
    """
    d = df.select("run", c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    d = d.where(c("x").isNotNull() & c("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    parts = 16
    left = d.select("run").distinct().withColumn("cell", F.lit(0).cast("long"))
    for level in range(1, levels + 1):
        step = 2 * limit / parts**level
        ends = left.select("run", F.explode(F.sequence(c("cell") * parts, c("cell") * parts + parts)).alias("p"))
        points = ends.agg(F.collect_set("p").alias("ps"))  # one row
        r = (c("x") * (c("p") * step - limit) - c("y")) / scale
        own = d.join(F.broadcast(points)).select("run", "x", "y", F.explode("ps").alias("p"))
        own = cut(own.groupBy("run", "p").agg(F.sum(c("x") * r / F.sqrt(1 + r * r)).alias("g")), "slopes")
        whole = own.groupBy("p").agg(F.sum("g").alias("t"))
        rest = ends.join(whole, "p").join(own, ["run", "p"]).withColumn("g", c("t") - c("g"))
        falls = rest.groupBy("run").agg(F.count_if(c("g") < 0).alias("k"), F.min("p").alias("p0"), F.max("p").alias("p1"))
        cell = F.greatest(c("p0"), F.least(c("p1") - 1, c("p0") + c("k") - 1))
        nxt = falls.select("run", cell.alias("cell"))
        if level == levels:
            pair = rest.join(nxt, "run").groupBy("run", "cell").agg(F.max(F.when(c("p") == c("cell"), c("g"))).alias("g0"), F.max(F.when(c("p") == c("cell") + 1, c("g"))).alias("g1"))
            part = F.when(c("g1") > c("g0"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), -c("g0") / (c("g1") - c("g0"))))).otherwise(0.0)
            none = (c("g0") == 0) & (c("g1") == 0)  # no other run, or one without any x
            return pair.select("run", F.when(none, 0.0).otherwise((c("cell") + part) * step - limit).alias("coef"))
        left = cut(nxt, "slopes")


def signal_gates(df: DataFrame, x: str, y: str, min_rows: int = 20, min_runs: int = 3) -> DataFrame:
    """Per run: how far a slope learnt on the other runs lowers the p95 of |y| (radians, given in degrees), the correlation
    of x and y, and the two verdicts. ``slope_supported``: at least ``min_runs`` runs of ``min_rows`` rows, median gain
    over .1 and 75 % of gains positive. ``signal_supported``: as many runs with a correlation, of median .35 at least.
    """
    d = df.where(c(x).isNotNull() & c(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select("run", c(x).alias("x"), c(y).alias("y"))
    spread = (F.stddev_pop("x") > 1e-5) & (F.stddev_pop("y") > 1e-5) & (F.count(F.lit(1)) >= 10)
    per = d.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(c("x") * c("x")).alias("sxx"),
                               F.sum(c("x") * c("y")).alias("sxy"), F.sum(c("y") * c("y")).alias("syy"), F.when(spread, F.corr("x", "y")).alias("correlation"))
    names = ["n", "sx", "sy", "sxx", "sxy", "syy"]
    coef = cut(robust_slopes(d, "x", "y"), "gates")
    j = per.crossJoin(per.agg(*[F.sum(v).alias("t_" + v) for v in names])).join(coef, "run")  # one row
    o = {v: c("t_" + v) - c(v) for v in names}
    mean = F.try_divide(c("coef") * o["sx"] - o["sy"], o["n"])
    square = F.try_divide(c("coef") * c("coef") * o["sxx"] - 2 * c("coef") * o["sxy"] + o["syy"], o["n"])
    j = j.withColumn("residual_sigma", F.when(mean.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))))
    err = d.join(coef, "run").withColumns({"__b": F.abs(F.degrees("y")), "__e": F.abs(F.degrees(c("coef") * c("x") - c("y")))})
    for value, name in (("__b", "baseline_p95_deg"), ("__e", "prior_p95_deg")):
        j = j.join(exact_quantiles(err, ["run"], value, {name: 0.95}, 0.2), "run")
    gain = (c("baseline_p95_deg") - c("prior_p95_deg")) / F.greatest(F.lit(0.01), c("baseline_p95_deg"))
    j = cut(j.withColumn("gain", F.when(c("n") >= min_rows, gain)).select("run", "n", "coef", "correlation", "residual_sigma", "baseline_p95_deg", "prior_p95_deg", "gain"), "gates")
    rho = F.when(c("n") >= min_rows, c("correlation"))  # one row per run
    up = (F.count("gain") >= min_runs) & (F.median("gain") > 0.1) & (F.avg((c("gain") > 0).cast("double")) >= 0.75)
    verdict = j.agg(F.coalesce(up, F.lit(False)).alias("slope_supported"),
                    F.coalesce((F.count(rho) >= min_runs) & (F.median(rho) >= 0.35), F.lit(False)).alias("signal_supported"))
    return j.crossJoin(verdict)  # one row


def _gradient(df: DataFrame, w, s: str, names: dict[str, Column]) -> DataFrame:
    """Second-order differences on uneven steps; the first and last row of a window have none."""
    back, ahead = c(s) - F.lag(s).over(w), F.lead(s).over(w) - c(s)
    d = df.withColumns({"__hb": back, "__ha": ahead} | {f"__f_{n}": v for n, v in names.items()})
    hb, ha = c("__hb"), c("__ha")
    at = lambda f, n: f(f"__f_{n}").over(w)
    out = {n: (hb * hb * at(F.lead, n) + (ha * ha - hb * hb) * c(f"__f_{n}") - ha * ha * at(F.lag, n)) / (hb * ha * (hb + ha)) for n in names}
    return d.withColumns(out).drop("__hb", "__ha", *[f"__f_{n}" for n in names])


def curvature_errors(df: DataFrame, keys: list[str], s: str, index: str, max_gap: float = 2.1) -> DataFrame:
    """Horizontal and vertical curvature of predicted curves less that of their reference, at stations at least two
    away from either end of an unbroken island.

    ``df``: keys, ``index``, ``s``, px, py, pz, gx, gy, gz. Rows without finite coordinates break an island, as do
    missing indices, steps over ``max_gap`` and steps that don't go forward. A curve is bounded by its start's range.
    """
    from pyspark.sql import Window

    d = df
    for n in ("px", "py", "pz", "gx", "gy", "gz"):
        d = d.where(c(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")))
    w = Window.partitionBy(*keys).orderBy(index)
    step = c(s) - F.lag(s).over(w)
    breaks = (c(index) - F.lag(index).over(w) > 1) | (step > max_gap) | (step < 1e-6)
    d = d.withColumn("__new", F.coalesce(breaks, F.lit(False)).cast("int"))
    d = d.withColumn("island", F.sum("__new").over(w)).drop("__new")
    v = Window.partitionBy(*keys, "island").orderBy(index)
    curves = ("p", "g")
    d = _gradient(d, v, s, {f"v{k}{a}": c(k + a) for k in curves for a in "xyz"})
    speed = lambda k: F.greatest(F.sqrt(c(f"v{k}x") * c(f"v{k}x") + c(f"v{k}y") * c(f"v{k}y")), F.lit(1e-8))
    d = _gradient(d, v, s, {f"a{k}{a}": c(f"v{k}{a}") for k in curves for a in "xy"} | {f"kv{k}": c(f"v{k}z") / speed(k) for k in curves})
    kh = {k: (c(f"v{k}x") * c(f"a{k}y") - c(f"v{k}y") * c(f"a{k}x")) / F.pow(speed(k), F.lit(3.0)) for k in curves}
    d = d.withColumns({"kh_error": kh["p"] - kh["g"], "kv_error": c("kvp") - c("kvg"), "range_m": F.sqrt(c("px") * c("px") + c("py") * c("py") + c("pz") * c("pz"))})
    return d.where(c("kh_error").isNotNull()).select(*keys, index, "island", "range_m", "kh_error", "kv_error")


def curvature_summary(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Stations and p95 of the absolute curvature errors per range block."""
    d = range_starts(errors, SCORE_EDGES).withColumns({"__h": F.abs("kh_error"), "__v": F.abs("kv_error")})
    out = d.groupBy(*keys, "lo").agg(F.count(F.lit(1)).alias("stations"))
    for value, name in (("__h", "horizontal_p95"), ("__v", "vertical_p95")):
        out = out.join(exact_quantiles(d, [*keys, "lo"], value, {name: 0.95}, 0.001), [*keys, "lo"])
    return out


def causality_audit(used: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: which of the sources that starts have used lie in their future or were never recorded.

    ``used``: keys, frame, source, role. A ``cloud`` may be no newer than its start; a ``direction`` must be the next frame.
    """
    known = frames.select(*keys, c("frame").alias("source")).distinct().withColumn("__k", F.lit(True))
    u = used.join(known, [*keys, "source"], "left")
    late = F.when(c("role") == "direction", c("source") != c("frame") + 1).otherwise(c("source") > c("frame"))
    return u.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("used"), F.countDistinct("frame").alias("starts"), F.count_if(late).alias("not_causal"),
        F.min(F.when(late, c("frame"))).alias("first_start"), F.count_if(c("__k").isNull()).alias("unknown"),
        (F.count_if(late | c("__k").isNull()) == 0).alias("causal"))


def saved_rows_check(saved: DataFrame, again: DataFrame, ids: list[str], keys: list[str]) -> DataFrame:
    """Saved rows against recomputed ones: how many of each, how many of one side only."""
    j = saved.select(*ids, F.lit(1).alias("__s")).join(again.select(*ids, F.lit(1).alias("__a")), ids, "full_outer")
    return j.groupBy(*keys).agg(F.count("__s").alias("saved"), F.count("__a").alias("recomputed"),
                                F.count_if(c("__s").isNull()).alias("missing"), F.count_if(c("__a").isNull()).alias("unexpected"))


SIGMAS = {"alpha": math.radians(0.5), "d": 0.008, "h": 0.008, "g": 0.012, "hf": 0.008}  # fixed values
POSITION_SIGMA, TANGENT_SIGMA = 0.01, math.radians(0.2)  # fixed values


def _normals(ids: list[str], seed: int) -> list[Column]:
    """Ten standard normal numbers from the MD5 of the row's ids, so that a repeated task draws the same."""
    text = [F.md5(F.concat_ws(":", *[c(i) for i in ids], F.lit(seed + k))) for k in range(2)]
    low = (1 << 24) - 1
    u = []
    for t in text:  # two numbers of 24 bits a conversion, and a last one
        a, b, e = (F.conv(F.substring(t, 12 * i + 1, n), 16, 10).cast("long") for i, n in enumerate((12, 12, 6)))
        u += [(x.cast("double") + 0.5) / float(1 << 24) for x in (F.shiftright(a, 24), a.bitwiseAND(F.lit(low)), F.shiftright(b, 24), b.bitwiseAND(F.lit(low)), e)]
    out = []
    for a, b in zip(u[:5], u[5:]):
        size, turn = F.sqrt(-2 * F.ln(a)), 2 * math.pi * b
        out += [size * F.cos(turn), size * F.sin(turn)]
    return out


def monte_carlo(sections: DataFrame, keys: list[str], ids: list[str], e1, e2, state: dict[str, Column], q: float = 1.0, draws: int = 200, seed: int = 6001) -> DataFrame:
    """Sampled covariance of both rails around every section, beside the first-order one.

    Sections have the contact point ``cx cy cz`` and unique ``ids``. Each is drawn ``draws`` times: section state, contact
    position and the two tilts of the tangent. One row per key and rail: the mean over its sections of sampled and of
    analytic covariances, and the relative Frobenius error between these means.
    """
    from ..functions.vector import add, cross, dot, norm, scale, sub, vec
    from ..operators.projections import rail_covariance, rails_from_contact

    pairs = [a + b for i, a in enumerate("xyz") for b in "xyz"[i:]]
    base = sections.select(*dict.fromkeys(keys + ids), "cx", "cy", "cz", *[v.alias(k) for k, v in state.items()])
    base = dealt(base, [*dict.fromkeys(keys + ids)], draws)
    d = base.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    d = d.withColumns({f"z{i}": z for i, z in enumerate(_normals([*ids, "i"], seed))})

    def step(df: DataFrame, name: str, v) -> DataFrame:
        """``v`` as columns: written out within each other, these expressions pass what can be compiled."""
        return df.withColumns({name + a: x for a, x in zip("xyz", v)})

    d = d.withColumns({"m_" + k: c(k) + c(f"z{i}") * SIGMAS[k] for i, k in enumerate(state)})
    d = step(d, "at", tuple(c("c" + a) + c(f"z{5 + i}") * POSITION_SIGMA for i, a in enumerate("xyz")))
    d = step(d, "tilt", add(scale(e1, c("z8") * TANGENT_SIGMA), scale(e2, c("z9") * TANGENT_SIGMA)))
    d = d.withColumn("angle", F.greatest(norm(vec("tilt")), F.lit(1e-12)))
    d = step(d, "axis", scale(vec("tilt"), 1 / c("angle"))).withColumns({"co": F.cos("angle"), "si": F.sin("angle")})
    at, axis, moved = vec("at"), vec("axis"), {k: c("m_" + k) for k in state}
    analytic, sampled = [], []
    for rail, name in enumerate(("near", "far")):
        d = step(d, "r" + name, sub(rails_from_contact(at, e1, e2, moved, q)[rail], at))
        r = vec("r" + name)
        turned = add(add(scale(r, c("co")), scale(cross(axis, r), c("si"))), scale(axis, dot(axis, r) * (1 - c("co"))))
        d = step(d, name + "_", add(turned, at))
        cov = rail_covariance(e1, e2, {k: c(k) for k in state}, F.lit(q), [F.lit(SIGMAS[k] ** 2) for k in state], F.lit(POSITION_SIGMA), F.lit(TANGENT_SIGMA), far=bool(rail))
        analytic += [F.struct(F.lit(name).alias("rail"), *[cov[p].alias("a" + p) for p in pairs])]
        sampled += [F.covar_samp(f"{name}_{p[0]}", f"{name}_{p[1]}").alias(f"{name}_{p}") for p in pairs]
    got = d.groupBy(*dict.fromkeys(keys + ids)).agg(*sampled)
    one = F.array(*[F.struct(F.lit(n).alias("rail"), *[c(f"{n}_{p}").alias(p) for p in pairs]) for n in ("near", "far")])
    got = got.select(*keys, F.explode(one).alias("o")).select(*keys, "o.*").groupBy(*keys, "rail").agg(*[F.avg(p).alias(p) for p in pairs], F.count(F.lit(1)).alias("sections"))
    want = base.select(*keys, F.explode(F.array(*analytic)).alias("o")).select(*keys, "o.*").groupBy(*keys, "rail").agg(*[F.avg("a" + p).alias("a" + p) for p in pairs])
    twice = lambda p: 1 if p[0] == p[1] else 2
    size = lambda f: F.sqrt(sum((twice(p) * f(p) * f(p) for p in pairs), F.lit(0.0)))
    return got.join(want, [*keys, "rail"]).withColumn("relative_error", size(lambda p: c(p) - c("a" + p)) / size(lambda p: c("a" + p)))


def distinct_configs(configs: dict[str, dict]) -> dict[str, dict]:
    """Configurations without aliases: the first name of equal settings stays."""
    seen, out = set(), {}
    for name, cfg in configs.items():
        key = tuple(sorted(cfg.items()))
        if key not in seen:
            seen.add(key)
            out[name] = cfg
    return out
