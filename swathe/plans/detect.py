"""Rail and contact-rail detection for all frames at once. Refusals are rows, never exceptions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import contact_confidence, pair_confidence
from ..operators import aggregates as agg
from ..operators.graph import connected_components, greedy_select
from ..operators.joins import bounded_nearest, interp_at, offset_grid, shifted, template_distance
from ..operators.ordered import blocked_scan
from ..operators.paths import longest_run
from ..session import cut

c = F.col

# Rail detector limits (metres, counts, weights).
RAIL = dict(bin=0.02, kernel=0.04, gauge=1.56, height=-1.0, vmin=-1.4, vmax=1.4, wmin=-1.35, wmax=-0.65, inner=0.32, outer=1.2,
            nms=0.065, reach=0.085, min_support=6, keep=14, quantile=0.75, center_max=0.30, gauge_lo=1.30, gauge_hi=1.80, soft_lo=1.48, soft_hi=1.62, cant_max=0.18,
            half_width=0.055, half_height=0.020, cell=0.010, surface_points=8, surface_cells=3, lateral_tol=0.090, min_rise=0.035, max_rise=0.28,
            support_ratio=0.15, support_cap=80.0, w_support=0.4, w_balance=0.15, w_surface=0.4, distinct=0.06, threshold=0.25, alone=3.0)


def _near(cand: DataFrame, pts: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Candidate x point rows within a box of ``radius`` (v, w), met through cells."""
    size = radius * (1 + 1e-6)
    span = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = cand.withColumn("gi", F.floor(c("cv") / size)).withColumn("gj", F.floor(c("cw") / size))
    a = a.withColumn("di", F.explode(span)).withColumn("dj", F.explode(span)).withColumns({"gi": c("gi") + c("di"), "gj": c("gj") + c("dj")}).drop("di", "dj")
    b = pts.select(*keys, "v", "w", F.floor(c("v") / size).alias("gi"), F.floor(c("w") / size).alias("gj"))
    return a.join(b, [*keys, "gi", "gj"]).drop("gi", "gj")


def rail_candidates(pts: DataFrame, keys: list[str], cfg: dict | None = None) -> DataFrame:
    """Per key and side: density peaks with support, thinned by strength, each with its head centre.

    ``pts``: keys, v, w. Weak peaks go before the thinning, then the rounds of
    the ordered selection give what a loop by falling strength would.
    """
    g = {**RAIL, **(cfg or {})}
    p = pts.where(c("v").between(g["vmin"], g["vmax"]) & c("w").between(g["wmin"], g["wmax"])).select(*keys, "v", "w")
    p = cut(p, "rails")
    d = agg.density_2d(p, keys, "v", "w", g["bin"], g["kernel"] / g["bin"]).withColumn("density", F.round("density", 9))
    peak = agg.local_maxima(d, keys).withColumns({"cv": (c("bu") + 0.5) * g["bin"], "cw": (c("bv") + 0.5) * g["bin"]})
    side = F.when((c("cv") > -g["outer"]) & (c("cv") < -g["inner"]), "L").when((c("cv") > g["inner"]) & (c("cv") < g["outer"]), "R")
    peak = cut(peak.withColumn("side", side).where(c("side").isNotNull()), "rails")
    k = [*keys, "side", "bu", "bv"]
    d2 = (c("v") - c("cv")) ** 2 + (c("w") - c("cw")) ** 2
    near = _near(peak, p, keys, g["reach"]).where(d2 <= g["reach"] ** 2)
    sup = near.groupBy(*k, "cv", "cw", "density").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.exp(-0.5 * d2 / g["kernel"] ** 2)).alias("support"), F.median("v").alias("hv"),
        F.percentile("w", F.lit(g["quantile"])).alias("hw"), F.var_samp("v").alias("vv"), F.var_samp("w").alias("ww"), F.covar_samp("v", "w").alias("vw"))
    sup = cut(sup.where(c("n") >= g["min_support"]), "rails")
    o = sup.select(*keys, "side", (-c("density")).alias("o"), "bu", "bv", c("cv").alias("x"), c("cw").alias("y"), F.lit(0.0).alias("z"))
    kept = greedy_select(o, [*keys, "side"], ["o", "bu", "bv"], g["nms"], strict=True)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys, "side").orderBy(c("density").desc(), "bu", "bv"))
    out = sup.join(kept.select(*k), k).withColumn("rank", rank).where(c("rank") <= g["keep"])
    half, diff = (c("vv") + c("ww")) / 2, F.sqrt(((c("vv") - c("ww")) / 2) ** 2 + c("vw") ** 2)
    scatter = F.sqrt(F.greatest(F.lit(0.0), F.coalesce(half + diff, F.lit(0.01))))
    return out.select(*keys, "side", "rank", c("hv").alias("v"), c("hw").alias("w"), "support", "n", scatter.alias("scatter"))


def rail_surface(cand: DataFrame, pts: DataFrame, keys: list[str], cfg: dict | None = None) -> DataFrame:
    """Candidates with the points of their thin top band and its longest run of occupied cells."""
    g = {**RAIL, **(cfg or {})}
    k = [*keys, "side", "rank"]
    a = cand.select(*k, c("v").alias("cv"), c("w").alias("cw"))
    band = _near(a, pts, keys, max(g["half_width"], g["half_height"])).where((F.abs(c("v") - c("cv")) <= g["half_width"]) & (F.abs(c("w") - c("cw")) <= g["half_height"]))
    cells = band.groupBy(*k, F.floor((c("v") - c("cv")) / g["cell"]).alias("cell")).agg(F.count(F.lit(1)).alias("m"))
    n = cells.groupBy(*k).agg(F.sum("m").alias("surface_points"))
    run = longest_run(cells.where("m >= 2"), k, "cell")
    out = cand.join(n, k, "left").join(run, k, "left").na.fill({"surface_points": 0, "longest": 0})
    ok = (c("surface_points") >= g["surface_points"]) & (c("longest") >= g["surface_cells"])
    quality = F.least(F.lit(1.0), c("surface_points") / 20) * F.least(F.lit(1.0), c("longest") / 6)
    return out.withColumns({"surface_ok": ok, "surface_quality": quality})


def _fits(lv: Column, lw: Column, rv: Column, rw: Column, g: dict) -> Column:
    gauge = rv - lv
    return (F.abs((lv + rv) / 2) <= g["center_max"]) & (gauge >= g["gauge_lo"]) & (gauge <= g["gauge_hi"]) & (F.abs(rw - lw) <= g["cant_max"])


def rail_pairs(cand: DataFrame, keys: list[str], cfg: dict | None = None) -> DataFrame:
    """Best rail pair per key with margin, confidence, status and reason.

    At most 14 candidates per side meet each other. A pair is suppressed when
    a supported head just above one of its own still fits the other rail.
    """
    g = {**RAIL, **(cfg or {})}
    cand = cut(cand, "pairs")
    f = ["rank", "v", "w", "support", "scatter", "surface_quality"]
    ok = cand.where("surface_ok")
    side = lambda s, p: ok.where(c("side") == s).select(*keys, *[c(n).alias(p + n) for n in f])
    pairs = side("L", "l").join(side("R", "r"), keys).where(_fits(c("lv"), c("lw"), c("rv"), c("rw"), g))

    def dominated(own: str, s: str):
        u = ok.where(c("side") == s).select(*keys, c("v").alias("uv"), c("w").alias("uw"), c("support").alias("us"))
        j = pairs.join(u, keys)
        dv, dw = c("uv") - c(own + "v"), c("uw") - c(own + "w")
        strong = c("us") >= F.greatest(F.lit(float(g["min_support"])), g["support_ratio"] * F.least(c(own + "support"), F.lit(g["support_cap"])))
        fit = _fits(c("uv"), c("uw"), c("rv"), c("rw"), g) if own == "l" else _fits(c("lv"), c("lw"), c("uv"), c("uw"), g)
        return j.where((F.abs(dv) <= g["lateral_tol"]) & (dw >= g["min_rise"]) & (dw <= g["max_rise"]) & strong & fit).select(*keys, "lrank", "rrank")

    bad = dominated("l", "L").unionByName(dominated("r", "R"))
    kept = pairs.join(bad, [*keys, "lrank", "rrank"], "left_anti")
    a, b = F.least(c("lsupport"), F.lit(g["support_cap"])), F.least(c("rsupport"), F.lit(g["support_cap"]))
    gauge, mid, h, dz = c("rv") - c("lv"), (c("lv") + c("rv")) / 2, (c("lw") + c("rw")) / 2, c("rw") - c("lw")
    out_ = F.greatest(g["soft_lo"] - gauge, F.lit(0.0), gauge - g["soft_hi"])
    score = (
        g["w_support"] * (F.log1p(a) + F.log1p(b)) + g["w_balance"] * F.least(a, b) / F.greatest(a, b) + g["w_surface"] * (c("lsurface_quality") + c("rsurface_quality"))
        - 0.12 * ((gauge - g["gauge"]) / 0.07) ** 2 - 2 * (out_ / 0.07) ** 2 - 0.12 * (mid / 0.30) ** 2 - 0.08 * ((h - g["height"]) / 0.35) ** 2
        - 0.10 * (dz / 0.18) ** 2 - 0.25 * (c("lscatter") + c("rscatter")) / 0.05)
    kept = cut(kept.withColumn("score", score), "pairs")
    best = kept.groupBy(*keys).agg(F.max_by(F.struct("score", "lrank", "rrank", "lv", "lw", "rv", "rw", "lsupport", "rsupport"), F.struct("score", -c("lrank"), -c("rrank"))).alias("b"))
    j = kept.join(best, keys)
    far = lambda s: F.sqrt((c(s + "v") - c(f"b.{s}v")) ** 2 + (c(s + "w") - c(f"b.{s}w")) ** 2)
    alt = j.where(F.greatest(far("l"), far("r")) > g["distinct"]).groupBy(*keys).agg(F.max("score").alias("alt"))
    res = best.join(alt, keys, "left").select(*keys, "b.*", "alt")
    res = res.withColumn("margin", F.coalesce(F.greatest(F.lit(0.0), c("score") - c("alt")), F.lit(g["alone"])))
    res = res.withColumn("confidence", pair_confidence(F.least("lsupport", "rsupport"), c("margin")))
    everyone = cand.select(*keys).distinct().join(res, keys, "left")
    status = F.when(c("score").isNull() | (c("confidence") < g["threshold"]), "refusal").otherwise("ok")
    reason = F.when(c("score").isNull(), "no_supported_upper_pair").when(c("confidence") < g["threshold"], "ambiguous_upper_pair").otherwise("")
    return everyone.withColumns({"status": status, "reason": reason})


def near_rail_refit(pts: DataFrame, pairs: DataFrame, keys: list[str], cfg: dict | None = None, min_sections: int = 4, max_residual: float = 0.015,
                    gauge: tuple[float, float] = (1.48, 1.70), min_span: float = 2.5, max_slope: float = 0.03) -> DataFrame:
    """Straight pair of rails over 0..8 m per key from section heads, or the reason it was refused.

    ``pts``: keys, u, v, w; ``pairs``: the pair per key. Three sections are
    enough to seed a sloping band that collects the points once more.
    """
    g = {**RAIL, **(cfg or {})}
    pairs = cut(pairs, "refit")
    seed = pairs.where("status = 'ok'").select(*keys, "lv", "lw", "rv", "rw")
    j = cut(pts.where(c("u").between(0, 8)).join(seed, keys), "refit")

    def collect(lv, lw, rv, rw):
        near = lambda hv, hw: (F.abs(c("v") - hv) <= g["half_width"]) & (F.abs(c("w") - hw) <= g["half_height"])
        s = F.when(near(lv, lw), "L").when(near(rv, rw), "R")
        return agg.section_heads(j2.withColumn("side", s).where(c("side").isNotNull()), keys)

    j2 = j
    first = cut(collect(c("lv"), c("lw"), c("rv"), c("rw")), "heads")
    count = first.groupBy(*keys).agg(F.countDistinct("section").alias("sections"))
    few = count.where((c("sections") >= 3) & (c("sections") < min_sections)).select(*keys)
    sums = first.join(few, keys, "left_semi").groupBy(*keys, "side").agg(
        *[e for v in ("hv", "hw") for e in (F.regr_slope(v, "hu").alias("s" + v), F.regr_intercept(v, "hu").alias("i" + v))])
    wide = sums.groupBy(*keys).agg(*[F.max(F.when(c("side") == s, c(n))).alias(s + n) for s in "LR" for n in ("shv", "ihv", "shw", "ihw")],
                                   F.max(F.greatest(F.abs("shv"), F.abs("shw"))).alias("steep"))
    j2 = j.join(wide.where(c("steep") <= max_slope), keys)
    at = lambda s, n: c(f"{s}i{n}") + c(f"{s}s{n}") * c("u")
    again = collect(at("L", "hv"), at("L", "hw"), at("R", "hv"), at("R", "hw"))
    heads = cut(first.join(few, keys, "left_anti").unionByName(again), "heads")
    v, w = agg.irls_line(heads, [*keys, "side"], "hu", "hv"), agg.irls_line(heads, [*keys, "side"], "hu", "hw")
    fit = v.select(*keys, "side", c("slope").alias("sv"), c("intercept").alias("iv")).join(w.select(*keys, "side", c("slope").alias("sw"), c("intercept").alias("iw")), [*keys, "side"])
    r = heads.join(fit, [*keys, "side"]).withColumn("res", F.sqrt((c("hv") - c("sv") * c("hu") - c("iv")) ** 2 + (c("hw") - c("sw") * c("hu") - c("iw")) ** 2))
    q = r.groupBy(*keys).agg(F.percentile("res", F.lit(0.9)).alias("residual_m"), F.countDistinct("section").alias("sections"), (F.max("hu") - F.min("hu")).alias("span_m"))
    gap = heads.groupBy(*keys, "section").agg((F.max(F.when(c("side") == "R", c("hv"))) - F.max(F.when(c("side") == "L", c("hv")))).alias("g")).groupBy(*keys).agg(F.median("g").alias("gauge_m"))
    line = fit.groupBy(*keys).agg(*[F.max(F.when(c("side") == s, c(n))).alias(f"{s.lower()}_{n}") for s in "LR" for n in ("sv", "iv", "sw", "iw")])
    out = pairs.select(*keys, "status", c("reason").alias("detector_reason")).join(q, keys, "left").join(gap, keys, "left").join(line, keys, "left")
    bad = (c("residual_m") > max_residual) | (c("gauge_m") < gauge[0]) | (c("gauge_m") > gauge[1])
    state = (F.when(c("status") != "ok", "STEP1_REJECTED").when(F.coalesce("sections", F.lit(0)) < min_sections, "INSUFFICIENT_PAIRED_SECTIONS")
             .when(c("span_m") < min_span, "INSUFFICIENT_SPAN").when(bad, "INCONSISTENT_HEADS").otherwise("ACCEPTED"))
    return out.withColumn("status", state)


def prior_correction(prior: DataFrame, heads: DataFrame, keys: list[str], max_shift: float = 0.30, max_slope: float = 0.03) -> DataFrame:
    """Correction line of an older path from section heads, per side, or why it is refused.

    ``prior``: keys, side, k, u, v, w; ``heads``: keys, side, hu, hv, hw.
    """
    k = [*keys, "side"]
    at = interp_at(prior, heads, k, "u", ["v", "w"], "hu")
    d = at.withColumns({"dv": c("hv") - c("v"), "dw": c("hw") - c("w")})
    f = d.groupBy(*k).agg(F.max(F.sqrt(c("dv") ** 2 + c("dw") ** 2)).alias("shift"), F.regr_slope("dv", "hu").alias("sv"), F.regr_intercept("dv", "hu").alias("iv"),
                          F.regr_slope("dw", "hu").alias("sw"), F.regr_intercept("dw", "hu").alias("iw"), F.min("hu").alias("u0"), F.max("hu").alias("u1"))
    whole = f.groupBy(*keys).agg(F.max("shift").alias("max_shift_m"), F.max(F.greatest(F.abs("sv"), F.abs("sw"))).alias("max_slope"))
    state = F.when((c("max_shift_m") > max_shift) | (c("max_slope") > max_slope), "CORRECTION_TOO_LARGE").otherwise("CORRECTED")
    return f.join(whole.withColumn("prior_status", state), keys)


# Contact placement prior (mean and sigma of d, h), scales and weights.
CONTACT = dict(mean=(0.70, 0.15), sigma=(0.10, 0.06), lo=(0.4, -0.1), hi=(1.0, 0.4), shape=0.015, cover=0.03, weights=(0.35, 0.40, 0.25),
               min_points=4, distinct=0.07, step=0.02, half=0.10, guard=0.15, alone=1.0, cap=0.1)


def contact_detect(rel: DataFrame, template: DataFrame, keys: list[str], cfg: dict | None = None) -> DataFrame:
    """Placement of the contact template on either side: LEFT, RIGHT, AMBIGUOUS or NOT_FOUND.

    ``rel``: keys, side, d, h. Every offset of a grid around the prior is
    scored by prior, shape and coverage; the best grid point per side is the
    candidate. Offsets are quantised to the step of the grid.
    """
    g = {**CONTACT, **(cfg or {})}
    spark = rel.sparkSession
    grid = offset_grid(spark, g["half"], g["step"]).select((c("ov") + g["mean"][0]).alias("ov"), (c("ow") + g["mean"][1]).alias("ow"))
    box = rel.where(c("d").between(g["lo"][0], g["hi"][0]) & c("h").between(g["lo"][1], g["hi"][1])).select(*keys, "side", c("d").alias("v"), c("h").alias("w")).distinct()
    k = [*keys, "side", "ov", "ow"]
    d = template_distance(shifted(box, grid).where((F.abs("v") <= 0.3) & (F.abs("w") <= 0.3)), template, k, cap=g["cap"])
    cells = template.count()
    s = d.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("residual"), (F.countDistinct(F.when(c("d") <= g["cover"], c("cell"))) / cells).alias("coverage"))
    s = s.where(c("n") >= g["min_points"])
    geo = F.exp(-0.5 * (((c("ov") - g["mean"][0]) / g["sigma"][0]) ** 2 + ((c("ow") - g["mean"][1]) / g["sigma"][1]) ** 2))
    s = s.withColumns({"geometry": geo, "shape": F.exp(-c("residual") / g["shape"])})
    wg, ws, wc = g["weights"]
    s = s.withColumn("score", F.round(wg * c("geometry") + ws * c("shape") + wc * c("coverage"), 9))
    pick = F.max_by(F.struct("score", "ov", "ow", "n", "geometry", "shape", "coverage"), F.struct("score", -c("ov"), -c("ow")))
    side = s.groupBy(*keys, "side").agg(pick.alias("b")).select(*keys, "side", "b.*")
    both = side.groupBy(*keys).agg(F.max_by(F.struct("side", "score", "ov", "ow", "n", "geometry", "shape"), F.struct("score", "side")).alias("b"),
                                   F.max("score").alias("__hi"), F.min("score").alias("__lo"), F.count(F.lit(1)).alias("sides"))
    out = rel.select(*keys).distinct().join(both, keys, "left").select(*keys, "b.*", "__hi", "__lo", "sides")
    margin = F.when(c("sides") == 2, c("__hi") - c("__lo")).otherwise(F.lit(g["alone"]))
    out = out.withColumn("margin", margin)
    out = out.withColumn("confidence", contact_confidence(c("n"), c("geometry"), c("shape"), c("margin")))
    status = F.when(c("score").isNull(), "NOT_FOUND").when(c("margin") < 0.02, "AMBIGUOUS").otherwise(c("side"))
    return out.drop("__hi", "__lo").withColumn("status", status)


def contact_availability(probe: Column, near_ok: Column, model_age_ms: Column, ttl_ms: float = 5000.0) -> Column:
    """Which path a frame may use, from the contact probe, the near rails and the age of the last full model."""
    fresh = model_age_ms.isNotNull() & (model_age_ms <= ttl_ms)
    return (F.when(~near_ok, "UNKNOWN_NEAR_REFERENCE").when(probe.isin("LEFT", "RIGHT") & fresh, "PRIMARY_CONTACT_PATH")
            .when(probe.isin("NOT_FOUND", "AMBIGUOUS") & fresh, "RAIL_FALLBACK").otherwise("NEAR_ONLY"))


def path_policy(df: DataFrame, longer: float = 4.0) -> DataFrame:
    """Scope of the path a frame uses and whether a fresh solve is due. Hit counts play no part.

    Needs has_primary, has_fallback, primary_ok, fallback_ok (agreement with
    the near rails), primary_end, fallback_end, prefix_lateral, prefix_vertical,
    contact_status, reanchored and near_end.
    """
    both = c("has_primary") & c("has_fallback") & c("primary_ok") & c("fallback_ok") & (c("fallback_end") > c("primary_end") + longer)
    same = (c("prefix_lateral") <= 0.10) & (c("prefix_vertical") <= 0.08)
    lost = c("contact_status").isin("NOT_FOUND", "AMBIGUOUS") & c("has_fallback") & c("reanchored")
    long = c("primary_end") > c("near_end")
    scope = (F.when(both & same, "HELD_OBSERVED_TAIL_AFTER_SHORT_MARCH").when(both, "NEAR_ONLY_CONFLICTING_PATHS")
             .when(lost, "RAIL_FALLBACK_AFTER_FULL_STEP2_FAILURE").when(~c("has_primary"), "NEAR_ONLY_WAITING_FULL_CHAIN")
             .when(~c("primary_ok"), "NEAR_ONLY_RECOMPUTE_CONTRADICTORY_PATH").when(long, "HELD_COMPLETE_PIPELINE_PATH").otherwise("NEAR_ONLY_SHORT_PRIMARY"))
    df = df.withColumn("scope", scope)
    calm = c("scope").isin("RAIL_FALLBACK_AFTER_FULL_STEP2_FAILURE", "HELD_COMPLETE_PIPELINE_PATH")
    return df.withColumns({"retry": ~calm, "fallback": c("scope").isin("HELD_OBSERVED_TAIL_AFTER_SHORT_MARCH", "RAIL_FALLBACK_AFTER_FULL_STEP2_FAILURE")})


def fuse_history(points: DataFrame, history: DataFrame, frames: DataFrame, keys: list[str] = ("run",)) -> DataFrame:
    """Causal clouds of each start stacked in the start's coordinates, with age and travelled distance.

    ``history``: keys, frame, source, age. Two poses per (start, source) are
    joined first; each point is read once per start that uses it.
    """
    from ..functions import rotation as rot
    from ..functions.vector import named, norm, vec

    keys = list(keys)
    src = frames.select(*keys, c("frame").alias("source"), *rot.POSE, c("header_time_ns").alias("s_ns"))
    tgt = frames.select(*keys, "frame", *[c(n).alias("g" + n) for n in rot.POSE], c("header_time_ns").alias("t_ns"))
    h = history.join(src, [*keys, "source"]).join(tgt, [*keys, "frame"])
    h = h.withColumns({"age_s": (c("t_ns") - c("s_ns")) / 1e9, "age_m": norm(tuple(c("t" + a) - c("gt" + a) for a in "xyz"))})
    j = points.withColumnRenamed("frame", "source").join(h, [*keys, "source"])
    j = j.select("*", *named(rot.to_world(vec("x", "y", "z"), rot.matrix("r"), vec("t")), "w"))
    return j.select("*", *named(rot.to_sensor(vec("w"), rot.matrix("gr"), vec("gt")), "s"))


def history_select(distances: DataFrame, keys: list[str], targets: list[float], uniform: int) -> DataFrame:
    """Frames chosen by nearest key distance, and evenly spaced ones, with the reason.

    ``distances``: keys, source, age, age_m.
    """
    t = F.array(*[F.lit(float(x)) for x in targets])
    d = distances.withColumn("target", F.explode(t))
    best = d.groupBy(*keys, "target").agg(F.min_by("source", F.struct(F.abs(c("age_m") - c("target")), "age")).alias("source"))
    a = best.select(*keys, "source", F.lit("KEY_DISTANCE").alias("rule")).distinct()
    n = distances.groupBy(*keys).agg(F.max("age").alias("__a"))
    u = distances.join(n, keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(uniform - 1))))
    u = u.where(c("age") == F.floor(c("i") * c("__a") / (uniform - 1))).select(*keys, "source", F.lit("UNIFORM").alias("rule")).distinct()
    return a.unionByName(u)


def greedy_coverage(cells: DataFrame, keys: list[str], rounds: int = 12) -> DataFrame:
    """Sources by greedy set cover: each round takes the source with most new cells. ``cells``: keys, source, cell.

    A key has the sources of one history, each with one list of its cells; its rounds run in its row.
    """
    lists = cells.where(c("cell").isNotNull()).groupBy(*keys, "source").agg(F.collect_set("cell").alias("cells"))
    return cover_lists(lists, keys, rounds)


def cover_lists(lists: DataFrame, keys: list[str], rounds: int = 12) -> DataFrame:
    """``greedy_coverage`` of keys, source and ``cells``, a list of distinct ones."""
    item = F.struct(F.size("cells").alias("gain"), (-c("source")).alias("__o"), "source", "cells")
    todo = lists.groupBy(*keys).agg(F.collect_list(item).alias("todo"))
    picked = f"array<struct<round:int,source:{lists.schema['source'].dataType.simpleString()},gain:bigint>>"
    sized = lambda x, cells: F.struct(F.size(cells).alias("gain"), x["__o"].alias("__o"), x["source"].alias("source"), cells.alias("cells"))

    def take(s: Column, i: Column) -> Column:
        def without(_: Column, b: Column) -> Column:
            rest = F.transform(F.filter(s["todo"], lambda x: x["__o"] != b["__o"]), lambda x: sized(x, F.array_except(x["cells"], b["cells"])))
            one = F.struct(i.cast("int").alias("round"), b["source"].alias("source"), b["gain"].cast("long").alias("gain"))
            return F.struct(F.filter(rest, lambda x: x["gain"] > 0).alias("todo"), F.concat(s["picked"], F.array(one)).cast(picked).alias("picked"))

        return F.when(F.size(s["todo"]) > 0, F.aggregate(F.array(F.array_max(s["todo"])), s, without)).otherwise(s)

    start = F.struct("todo", F.array().cast(picked).alias("picked"))
    out = todo.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, take).alias("s"))
    return out.select(*keys, F.explode("s.picked").alias("p")).select(*keys, "p.round", "p.source", "p.gain")


def future_reference(heads: DataFrame, frames: DataFrame, keys: list[str] = ("run",), bin_m: float = 0.5, at_least: int = 2, lead: int = 2) -> DataFrame:
    """Evaluation only: heads of later frames binned by travelled station, medians and spread.

    ``heads``: keys, frame, u, x, y (world); ``frames``: keys, frame, arc_m.
    Column names start with ``ref_`` so no inference whitelist admits them.
    """
    keys = list(keys)
    h = heads.join(frames.select(*keys, "frame", "arc_m"), [*keys, "frame"])
    h = h.withColumn("bin", F.floor((c("arc_m") + c("u")) / bin_m))
    m = h.groupBy(*keys, "bin").agg(F.median("x").alias("ref_x"), F.median("y").alias("ref_y"), F.count(F.lit(1)).alias("ref_n")).where(c("ref_n") >= at_least)
    d = h.join(m, [*keys, "bin"]).groupBy(*keys, "bin").agg((F.median(F.abs(c("x") - c("ref_x"))) * 1.4826).alias("ref_spread"))
    return m.join(d, [*keys, "bin"]).withColumn("ref_s", (c("bin") + 0.5) * bin_m)


def _linked_locally(v: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Voxels (keys, id, x, y, z) linked within cells of eight times ``radius``: id, the least id of the component there, whether the cell is the voxel's own, and whether it lies in several."""
    from ..functions.cells import CELL, explode_box
    from ..functions.vector import vec
    from ..operators.groups import changes, close, components, whole
    from ..operators.joins import PAD

    width, place = 8 * radius * PAD, [*keys, *CELL]
    at = tuple(p + width / 2 for p in vec("x", "y", "z"))
    # Two voxels meet in the cell of their larger coordinates, so a voxel is copied upwards only.
    spread = explode_box(v.select(*keys, "id", "x", "y", "z"), at, tuple(p + radius * PAD for p in at), width)
    same = lambda up: [F.floor((p + up) / width) == c(k) for p, k in zip(at, CELL)]
    own, last = same(0.0), [F.floor((p + radius * PAD) / width) == F.floor(p / width) for p in at]
    rows = spread.select("*", (own[0] & own[1] & own[2]).alias("home"), (~(last[0] & last[1] & last[2])).alias("shared"))
    rows = rows.repartition(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place).sortWithinPartitions(*place, "id")

    def run(batches):
        for table in whole(batches, place, 20_000):
            group = np.cumsum(changes(table, place))
            xyz = np.stack([table.column(n).to_numpy() for n in "xyz"], axis=1)
            ids = table.column("id").to_numpy()
            label = ids[components(len(ids), *close(xyz, group, xyz, group, radius))]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label), *[table.column(n).combine_chunks() for n in ("home", "shared")]], ["id", "label", "home", "shared"])

    return cut(rows.mapInArrow(run, "id long, label long, home boolean, shared boolean"), "linked")


def linked_component(points: DataFrame, seeds: DataFrame, keys: list[str], voxel: float = 0.15, radius: float = 0.37, max_gap: float = 0.5) -> DataFrame:
    """Points of the component whose nearest cell centre lies within ``max_gap`` of the key's seed.

    ``points``: keys, id, x, y, z with global ids; ``seeds``: keys, x, y, z.
    """
    from ..functions.cells import CELL, cell_of
    from ..functions.vector import vec

    p = points.select(*keys, "id", "x", "y", "z", *cell_of(vec("x", "y", "z"), voxel))
    v = p.groupBy(*keys, *CELL).agg(F.min("id").alias("first")).select(*keys, *CELL, "first", *[((c(k) + 0.5) * voxel).alias(a) for k, a in zip(CELL, "xyz")])
    # Cells are numbered once and for all by being written: a number costs the rounds of the search a fraction of a text.
    v = cut(v.withColumn("id", F.monotonically_increasing_id()), "linked")
    local = _linked_locally(v, keys, radius)
    # Voxels that lie in several cells link the components found in each; only these take part in the search over all.
    shared = local.where("shared").withColumn("__m", F.min("label").over(Window.partitionBy("id")))
    links = shared.where("label <> __m").select(c("label").alias("a_id"), c("__m").alias("b_id"))
    home = local.where("home").select("id", "label")
    comp = connected_components(home.select(c("label").alias("id")).distinct(), links).select(c("id").alias("label"), "component")
    comp = home.join(comp, "label").select("id", "component")
    named = v.select(*keys, "first", *"xyz").withColumnRenamed("first", "id")
    near = bounded_nearest(seeds.withColumn("id", F.lit(0).cast(named.schema["id"].dataType)), named, keys, "id", max_gap).where(c("near_id").isNotNull())
    labelled = v.select(*keys, *CELL, "first", "id").join(comp, "id")
    want = near.select(*keys, c("near_id").alias("first")).join(labelled, [*keys, "first"]).select(*keys, c("component").alias("__c")).distinct()
    cells = cut(labelled.withColumnRenamed("component", "__c").join(want, [*keys, "__c"], "left_semi").drop("id"), "linked")
    least = cells.groupBy("__c").agg(F.min("first").alias("component"))
    return p.join(cells.join(least, "__c").select(*keys, *CELL, "component"), [*keys, *CELL])


def _percentile(values: Column, q: float) -> Column:
    """``percentile`` of a sorted array, weighed as that function does."""
    pos = (F.size(values) - 1) * F.lit(float(q))
    lo, hi = F.floor(pos), F.ceil(pos)
    a, b = F.get(values, lo.cast("int")), F.get(values, hi.cast("int"))
    return F.when(a == b, a).otherwise((hi - pos) * a + (pos - lo) * b)


def split_heads(df: DataFrame, keys: list[str], value: str = "v", rounds: int = 12, min_side: int = 5, width: tuple[float, float] = (0.8, 2.5)) -> DataFrame:
    """Two clusters of one coordinate per key by iterated medians; only keys with a plausible split remain.

    A key's values (a section's, bounded by geometry) are sorted once, and its rounds run in its row until its medians rest.
    """
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(c(value).cast("double"))).alias("q"))
    rows = rows.select(*keys, "q", _percentile(c("q"), 0.2).alias("a"), _percentile(c("q"), 0.8).alias("b"))
    none, no = F.lit(None).cast("double"), F.lit(0).cast("long")
    start = F.struct(c("a").alias("a"), c("b").alias("b"), none.alias("na"), none.alias("nb"), no.alias("n_left"), no.alias("n_right"), F.lit(True).alias("moving"))

    def step(s: Column, i: Column) -> Column:
        left = lambda x: F.abs(x - s["a"]) <= F.abs(x - s["b"])
        parts = F.struct(F.filter("q", left).alias("l"), F.filter("q", lambda x: ~left(x)).alias("r"))

        def moved(_: Column, p: Column) -> Column:
            na, nb = _percentile(p["l"], 0.5), _percentile(p["r"], 0.5)
            far = F.coalesce(F.greatest(F.abs(na - s["a"]), F.abs(nb - s["b"])) >= 1e-5, F.lit(False))
            return F.struct(F.coalesce(na, s["a"]).alias("a"), F.coalesce(nb, s["b"]).alias("b"), na.alias("na"), nb.alias("nb"),
                            F.size(p["l"]).cast("long").alias("n_left"), F.size(p["r"]).cast("long").alias("n_right"), far.alias("moving"))

        return F.when(s["moving"], F.aggregate(F.array(parts), s, moved)).otherwise(s)

    new = rows.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("s")).select(*keys, "s.*")
    out = new.where((c("n_left") >= min_side) & (c("n_right") >= min_side)).withColumn("width", c("nb") - c("na"))
    return out.where((c("width") > width[0]) & (c("width") < width[1])).select(*keys, c("na").alias("left"), c("nb").alias("right"), "n_left", "n_right")
