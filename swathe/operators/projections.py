"""Row-wise operators: filters, transforms, statuses and section geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rotation as rot
from ..functions.numeric import is_finite
from ..functions.vector import Vec, const, cross, dot, named, norm, scale, sub, unit, vec

XYZ = ("x", "y", "z")
c = F.col


def is_valid(x: Column, y: Column, z: Column) -> Column:
    """A return counts iff all coordinates are finite and not all exactly zero."""
    return is_finite(x) & is_finite(y) & is_finite(z) & ((x != 0) | (y != 0) | (z != 0))


def valid_points(df: DataFrame, names=XYZ) -> DataFrame:
    return df.where(is_valid(*[F.col(n) for n in names]))


def range_gate(df: DataFrame, lo: float = 1.2, hi: float = 140.0, names=XYZ) -> DataFrame:
    """Strict ``lo < r < hi``, with r added as ``range_m``."""
    r = norm(vec(*names))
    return df.withColumn("range_m", r).where((F.col("range_m") > lo) & (F.col("range_m") < hi))


def add_world(df: DataFrame, names=XYZ, out: str = "w") -> DataFrame:
    """World coordinates of rows that carry their pose columns."""
    w = rot.to_world(vec(*names), rot.matrix(), vec("t"))
    return df.select("*", *named(w, out))


def add_sensor(df: DataFrame, names=("wx", "wy", "wz"), out: str = "s") -> DataFrame:
    p = rot.to_sensor(vec(*names), rot.matrix(), vec("t"))
    return df.select("*", *named(p, out))


def transform_path(df: DataFrame, vectors: list[str], covariances: list[str], to_map: bool = True) -> DataFrame:
    """Move path points (prefix columns) and 3x3 covariances (prefix ``p`` with
    pxx, pxy, pxz, pyy, pyz, pzz) by the row's pose: ``R v + t`` and ``R C R^T``."""
    m = rot.matrix() if to_map else rot.transpose(rot.matrix())
    cols = {}
    for p in vectors:
        v = rot.to_world(vec(p), rot.matrix(), vec("t")) if to_map else rot.to_sensor(vec(p), rot.matrix(), vec("t"))
        cols.update({p + a: c for a, c in zip("xyz", v)})
    for p in covariances:
        xx, xy, xz, yy, yz, zz = (F.col(p + s) for s in ("xx", "xy", "xz", "yy", "yz", "zz"))
        c = [[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]
        full = rot.compose(rot.compose(m, c), rot.transpose(m))
        for i, a in enumerate("xyz"):
            for j in range(i, 3):
                cols[p + a + "xyz"[j]] = full[i][j]
    return df.withColumns(cols)


def forward_basis(df: DataFrame, names=("dx", "dy", "dz")) -> DataFrame:
    """Orthonormal forward / lateral / up columns; null with a ``reason`` when the
    direction is shorter than 1 cm or nearly vertical."""
    # Staged: each step reads the columns of the one before, so no expression is repeated.
    keep = df.columns
    out = df.select("*", norm(vec(*names)).alias("__n"))
    out = out.select("*", *named(unit(vec(*names), 1e-300), "__f"))
    out = out.select("*", *named(sub(const(0, 0, 1), scale(vec("__f"), c("__fz"))), "__v"))
    out = out.withColumn("__un", norm(vec("__v")))
    out = out.select("*", *named(unit(cross(vec("__v"), vec("__f"))), "__l"))
    out = out.select("*", *named(cross(vec("__f"), vec("__l")), "__u"))
    reason = (
        F.when(~is_finite(c("__n")) | (c("__n") < 0.01), "stationary_or_invalid_direction")
        .when(c("__un") < 0.1, "near_vertical_direction").otherwise("")
    )
    out = out.withColumn("reason", reason)
    ok = c("reason") == ""
    return out.select(*keep, "reason", *[F.when(ok, c(f"__{p}{a}")).alias(p + a) for p in "flu" for a in XYZ])


def slab_roi(df: DataFrame, lo: float = 0.0, hi: float = 8.0) -> DataFrame:
    """Forward slab of a sensor cloud as (u, v, w) = (-y, x, z)."""
    u = -F.col("y")
    return df.where((u >= lo) & (u <= hi)).withColumns({"u": u, "v": F.col("x"), "w": F.col("z")})


def range_azimuth(df: DataFrame, names=XYZ) -> DataFrame:
    x, y, _ = (F.col(n) for n in names)
    return df.withColumns({
        "range_m": norm(vec(*names)),
        "azimuth": F.rint(F.atan2(y, x) / 1e-5).cast("int"),
    })


def far_weight(r: Column, start: float = 70.0) -> Column:
    return F.least(F.lit(1.0), (start / r) * (start / r))


def pack_owner(frame: Column, row: Column) -> Column:
    """``frame << 32 | row``; null unless the row fits 32 bits."""
    fits = (row >= 0) & (row < F.lit(1 << 32))
    return F.when(fits, F.shiftleft(frame.cast("long"), 32) + row.cast("long"))


def unpack_owner(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 32).cast("int"), key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("long")


def corridor_box(
    df: DataFrame, center: Vec, basis: tuple[Vec, Vec, Vec], lo: tuple, hi: tuple,
    window: float = 8.0, margin: float = 0.14, names=XYZ,
) -> DataFrame:
    """Points in the oriented box u in [0, window], (v, w) in the template bounds
    widened by ``margin``. A plain axis-aligned box comes first, so it can reach the scan."""
    p = vec(*names)
    d = sub(p, center)
    u, v, w = (dot(d, b) for b in basis)
    mid = (window / 2, (lo[0] + hi[0]) / 2, (lo[1] + hi[1]) / 2)
    half = (window / 2, (hi[0] - lo[0]) / 2 + margin, (hi[1] - lo[1]) / 2 + margin)
    cheap = F.lit(True)
    for axis in range(3):
        c = center[axis] + sum((b[axis] * m for b, m in zip(basis, mid)), F.lit(0.0))
        r = sum((F.abs(b[axis]) * h for b, h in zip(basis, half)), F.lit(1e-7))
        cheap = cheap & (p[axis] >= c - r) & (p[axis] <= c + r)
    df = df.where(cheap).withColumns({"u": u, "v": v, "w": w})
    exact = (F.col("u") >= 0) & (F.col("u") <= window)
    for name, a, b in (("v", lo[0], hi[0]), ("w", lo[1], hi[1])):
        exact = exact & (F.col(name) >= a - margin) & (F.col(name) <= b + margin)
    return df.where(exact)


def in_box(v: Vec, lo: tuple, hi: tuple) -> Column:
    ok = F.lit(True)
    for c, a, b in zip(v, lo, hi):
        ok = ok & (c >= a) & (c <= b)
    return ok


def self_mask(df: DataFrame, lo: tuple, hi: tuple, seeds: DataFrame, keys: list[str], names=XYZ) -> DataFrame:
    """Drop returns inside the vehicle's own box, but never a seed row."""
    inside = in_box(vec(*names), lo, hi)
    marked = df.join(seeds.select(*keys).distinct().withColumn("__seed", F.lit(True)), keys, "left")
    return marked.where(~inside | F.col("__seed").isNotNull()).drop("__seed")


def classify_status(reference: Column, late: Column, components: Column) -> Column:
    """Ordered: an unknown reference beats lateness, lateness beats evidence."""
    return (
        F.when(~reference, "UNKNOWN_NEAR_REFERENCE")
        .when(late, "EXPIRED_RESULT")
        .when(components > 0, "INTRUSION")
        .otherwise("NO_CONFIRMED_COMPONENT_THIS_BATCH")
    )


def classify_far(eligible: Column, late: Column, hits: Column, far_available: Column) -> Column:
    """Status of the near/far checker; no returns at all is unknown, not clear."""
    some = hits > 0
    return (
        F.when(eligible == 0, "UNKNOWN_NO_RETURNS")
        .when(late, F.when(some, "EXPIRED_INTRUSION").otherwise("UNKNOWN_EXPIRED_RESULT"))
        .when(far_available, F.when(some, "INTRUSION").otherwise("NO_HITS_IN_MODELED_PRISMS"))
        .otherwise(F.when(some, "NEAR_ONLY_INTRUSION").otherwise("NEAR_ONLY_FAR_UNAVAILABLE"))
    )


def rail_relative(df: DataFrame, lo: tuple, hi: tuple) -> DataFrame:
    """Each slab point relative to both rails, the left side mirrored, kept inside the box.

    Needs v, w and the head pair lv, lw, rv, rw.
    """
    sides = F.array(F.struct(F.lit("LEFT").alias("n"), F.lit(-1.0).alias("g"), F.col("lv").alias("v"), F.col("lw").alias("w")),
                    F.struct(F.lit("RIGHT").alias("n"), F.lit(1.0).alias("g"), F.col("rv").alias("v"), F.col("rw").alias("w")))
    out = df.select("*", F.explode(sides).alias("__s")).withColumns({
        "side": F.col("__s.n"),
        "d": F.col("__s.g") * (F.col("v") - F.col("__s.v")),
        "h": F.col("w") - F.col("__s.w"),
    }).drop("__s")
    return out.where(in_box((F.col("d"), F.col("h"), F.lit(0.0)), (*lo, 0.0), (*hi, 0.0)))


def validate_gauge(df: DataFrame, lo: float = 1.48, hi: float = 1.62, metrics: list[str] = ()) -> DataFrame:
    """Distance of the two reference heads, a reason, and metrics masked where it fails."""
    dv, dw = F.col("rv") - F.col("lv"), F.col("rw") - F.col("lw")
    gap = F.sqrt(dv * dv + dw * dw)
    parts = [F.col(c) for c in ("lv", "lw", "rv", "rw")]
    missing, finite = F.lit(False), F.lit(True)
    for c in parts:
        missing, finite = missing | c.isNull(), finite & is_finite(c)
    reason = (
        F.when(missing, "reference_unavailable").when(~finite, "reference_nonfinite")
        .when(gap < lo, "reference_too_narrow").when(gap > hi, "reference_too_wide").otherwise("passed")
    )
    df = df.withColumns({"separation_m": F.when(~missing & finite, gap), "gauge_reason": reason})
    ok = F.col("gauge_reason") == "passed"
    return df.withColumns({"gauge_valid": ok, **{m: F.when(ok, F.col(m)) for m in metrics}})


def require_columns(df: DataFrame, required: list[str], allowed: list[str] | None = None) -> DataFrame:
    """Fail early on missing columns, and on columns outside the whitelist if one is given."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if allowed is not None:
        extra = [c for c in df.columns if c not in set(required) | set(allowed)]
        if extra:
            raise ValueError(f"columns not allowed here: {', '.join(extra)}")
    return df


def assign_labels(points: DataFrame, supports: dict[int, DataFrame], keys: list[str]) -> DataFrame:
    """Class of each point from the support sets; ``conflicts`` counts the sets it is in beyond one."""
    total, label = F.lit(0), F.lit(0)
    out = points
    for cls, ids in supports.items():
        flag = f"__c{cls}"
        out = out.join(ids.select(*keys).distinct().withColumn(flag, F.lit(1)), keys, "left")
        label = F.when(F.col(flag).isNotNull(), cls).otherwise(label)
        total = total + F.coalesce(F.col(flag), F.lit(0))
    out = out.withColumns({"label": label.cast("int"), "conflicts": F.greatest(total - 1, F.lit(0)).cast("int")})
    return out.drop(*[f"__c{c}" for c in supports])


# --- rails from a contact curve ------------------------------------------------------------------


def cross_axes(alpha: Column, e1: Vec, e2: Vec) -> tuple[Vec, Vec]:
    """Cross-section axes (b, n) rotated by ``alpha`` from the transported frame."""
    c, s = F.cos(alpha), F.sin(alpha)
    b = tuple(c * p + s * q for p, q in zip(e1, e2))
    n = tuple(c * q - s * p for p, q in zip(e1, e2))
    return b, n


def rails_from_contact(C: Vec, e1: Vec, e2: Vec, state: dict[str, Column], q: Column | float) -> tuple[Vec, Vec]:
    """Near and far rail of a station with state alpha, d, h, g, hf on side ``q`` (+/-1)."""
    b, n = cross_axes(state["alpha"], e1, e2)
    near = tuple(c - q * state["d"] * p - state["h"] * m for c, p, m in zip(C, b, n))
    far = tuple(c - q * (state["d"] + state["g"]) * p - state["hf"] * m for c, p, m in zip(C, b, n))
    return near, far


def section_offsets(df: DataFrame, C: str, near: str, far: str, t: Vec, e1: Vec, e2: Vec, q: float) -> DataFrame:
    """State of a station from its rail pair (prefixes of columns): the inverse of ``rails_from_contact``."""
    keep = df.columns
    out = df.select("*", *named(unit(scale(sub(vec(near), vec(far)), q)), "__a"))
    out = out.select("*", *named(sub(vec("__a"), scale(t, dot(vec("__a"), t))), "__p"))
    out = out.select("*", *named(unit(vec("__p")), "__b"))
    out = out.select("*", *named(cross(t, vec("__b")), "__n"))
    b, n = vec("__b"), vec("__n")
    v, vf = sub(vec(C), vec(near)), sub(vec(C), vec(far))
    return out.select(
        *keep, F.atan2(dot(b, e2), dot(b, e1)).alias("alpha"), (q * dot(v, b)).alias("d"), dot(v, n).alias("h"),
        (q * dot(sub(vec(near), vec(far)), b)).alias("g"), dot(vf, n).alias("hf"),
    )


def rail_covariance(e1: Vec, e2: Vec, state: dict[str, Column], q, sx: list[Column], sp: Column, st: Column, far: bool):
    """First-order covariance (xx, xy, xz, yy, yz, zz) of one rail.

    ``sx`` are the variances of alpha, d, h, g, hf, ``sp`` the position sigma
    of the contact curve and ``st`` the tangent sigma.
    """
    b, n = cross_axes(state["alpha"], e1, e2)
    d = state["d"] + state["g"] if far else state["d"]
    h = state["hf"] if far else state["h"]
    r = tuple(-q * d * p - h * m for p, m in zip(b, n))
    ja = tuple(-q * d * m + h * p for p, m in zip(b, n))
    jd = tuple(-q * p for p in b)
    jh = tuple(-m for m in n)
    terms = [(ja, sx[0]), (jd, sx[1]), (jh, sx[4] if far else sx[2])]
    if far:
        terms.append((jd, sx[3]))
    terms += [(cross(b, r), st * st), (cross(n, r), st * st)]
    out = {}
    for i in range(3):
        for j in range(i, 3):
            value = sp * sp if i == j else F.lit(0.0)
            for v, var in terms:
                value = value + v[i] * v[j] * var
            out["xyz"[i] + "xyz"[j]] = value
    return out


def continue_alpha(x0: Column, slope: Column, dist: Column, family: str, damping: float = 50.0) -> Column:
    """Roll angle ahead of the seed: constant, exponential or flattening cubic, all with
    a twice-differentiable onset ``d^3 / (d^2 + 4)``."""
    elapsed = dist * dist * dist / (dist * dist + 4)
    if family == "constant":
        return x0
    if family == "smooth":
        return x0 + slope * damping * (1 - F.exp(-elapsed / damping))
    if family == "spline":
        z = F.least(elapsed / damping, F.lit(1.0))
        return x0 + slope * damping * (z - z * z + z * z * z / 3)
    raise ValueError(f"unknown family {family}")


def continue_variance(p0: Column, slope_sigma: Column, dist: Column, gap_age: Column,
                      q_roll_deg: float = 0.05, damping: float = 50.0) -> Column:
    """Variance of alpha: diffusion with distance, slope uncertainty, and growth inside gaps."""
    q = math.radians(q_roll_deg) ** 2
    reach = damping * (1 - F.exp(-dist / damping)) * slope_sigma
    return p0 + dist * q + reach * reach + math.radians(0.1) ** 2 * gap_age


def adaptive_limits(df: DataFrame, mode: str, shape: float, gate: float, overlap: float) -> DataFrame:
    """Shape, gate and overlap limits, loosened in steps at 40, 60 and 80 m of range or track
    age, and only once 24 m of track are confirmed. Needs range_m and maturity_m."""
    z = F.col("maturity_m") if mode == "age" else F.col("range_m")
    level = F.when(z >= 80, 3).when(z >= 60, 2).when(z >= 40, 1).otherwise(0)
    # Limits per level.
    steps = {"shape": (0.025, 0.03, 0.04, 0.05), "gate": (0.03, 0.05, 0.08, 0.12), "overlap": (0.03, 0.035, 0.04, 0.05)}
    base = {"shape": shape, "gate": gate, "overlap": overlap}
    df = df.withColumn("level", F.when((F.col("maturity_m") >= 24) & (F.lit(mode) != "none"), level))
    out = {}
    for name, values in steps.items():
        loose = F.when(F.col("level") == 0, values[0])
        for i in (1, 2, 3):
            loose = loose.when(F.col("level") == i, values[i])
        out[f"{name}_limit"] = F.greatest(F.lit(float(base[name])), loose)
    return df.withColumns(out)


def dewarp(u: Column, v: Column, w: Column, kv: Column, kw: Column, width: float = 4.0) -> tuple[Column, Column]:
    """Remove ``.5 u^2 kappa`` at the middle of each sub-window before pooling a profile."""
    mid = F.floor(u / width) * width + width / 2
    return v - 0.5 * mid * mid * kv, w - 0.5 * mid * mid * kw


def perturb_points(df: DataFrame, scenarios: DataFrame, key: Column, seed: int = 7) -> DataFrame:
    """Every scenario of shift and keep-share applied to the cloud; rows are drawn by hash, so
    a rerun draws the same ones. ``scenarios``: scenario, shift_x, shift_z, keep_permille."""
    out = df.crossJoin(F.broadcast(scenarios))  # a fixed handful of scenarios
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000))
    out = out.where(draw < F.col("keep_permille"))
    return out.withColumns({"x": F.col("x") + F.col("shift_x"), "z": F.col("z") + F.col("shift_z")})
