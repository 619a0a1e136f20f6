"""Fits: Spark sums the normal equations, each group solves one small system."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vector import named, norm, sub, vec
from ..operators.groups import changes, close, spans, whole
from ..session import cut, discard

c = F.col


def normal_equations(df: DataFrame, keys: list[str], columns: list[Column], target: Column, weight: Column, total: str | None = None) -> DataFrame:
    """Sums a_i_j (upper triangle) of ``A^T W A`` and b_i of ``A^T W y`` per group; ``total`` names a sum of the weights."""
    n = len(columns)
    rows = df.select(*keys, *[e.cast("double").alias(f"__x{i}") for i, e in enumerate(columns)], target.alias("__y"), weight.alias("__w"))
    x = [c(f"__x{i}") for i in range(n)]
    sums = [F.sum(c("__w") * x[i] * x[j]).alias(f"a_{i}_{j}") for i in range(n) for j in range(i, n)]
    sums += [F.sum(c("__w") * x[i] * c("__y")).alias(f"b_{i}") for i in range(n)]
    sums += [F.sum("__w").alias(total)] if total else []
    return rows.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("n"), F.sum(c("__w") * c("__y") * c("__y")).alias("yy"))


def solutions(m: np.ndarray, b: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Solutions and condition numbers of symmetric systems; columns are scaled to unit diagonal, so that units do not decide the conditioning."""
    d = np.sqrt(np.maximum(np.einsum("kii->ki", m), 1e-12))
    ms = m / d[:, :, None] / d[:, None, :] + ridge * np.eye(m.shape[1])
    e = np.linalg.eigvalsh(ms)
    x = np.einsum("kij,kj->ki", np.linalg.pinv(ms, rcond=1e-8, hermitian=True), b / d) / d
    return x, e[:, -1] / np.maximum(e[:, 0], 1e-12)


def solve(df: DataFrame, n: int, ridge: float = 0.0) -> DataFrame:
    """Solutions x_0.. and the condition number of systems held as a_i_j, b_i; one row per system, in Arrow batches."""
    names = [f"a_{i}_{j}" for i in range(n) for j in range(i, n)] + [f"b_{i}" for i in range(n)]
    out = [f"x_{i}" for i in range(n)] + ["condition"]

    @F.pandas_udf(", ".join(f"{o} double" for o in out))
    def run(s: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((len(s), n, n))
        at = 0
        for i in range(n):
            for j in range(i, n):
                m[:, i, j] = m[:, j, i] = s.iloc[:, at].fillna(0.0)
                at += 1
        x, cond = solutions(m, s.iloc[:, at:at + n].fillna(0.0).to_numpy(dtype=float), ridge)
        return pd.DataFrame(np.concatenate([x, cond[:, None]], axis=1), columns=out)

    return df.withColumn("__s", run(F.struct(*names))).select(*df.columns, "__s.*")


# --- alignment of frame pairs ---------------------------------------------------------------------

IDENTITY = {f"r{i}{j}": float(i == j) for i in range(3) for j in range(3)} | {"tx": 0.0, "ty": 0.0, "tz": 0.0}


# Rows that a task aligns at once, and pairs that are dealt to a task.
ROWS, PAIRS_A_TASK = 20_000, 200
# Metres that a point may move before its list of targets is made anew.
SLACK = 0.3


def _rodrigues(v: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(v, axis=1)
    small = a < 1e-8
    safe = np.where(small, 1.0, a)
    k = np.zeros((len(v), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    k -= k.transpose(0, 2, 1)
    one, two = np.where(small, 1.0, np.sin(safe) / safe), np.where(small, 0.5, (1 - np.cos(safe)) / safe ** 2)
    return np.eye(3) + one[:, None, None] * k + two[:, None, None] * (k @ k)


def _rotation_vector(m: np.ndarray) -> np.ndarray:
    v = np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], axis=1) / 2
    sine = np.linalg.norm(v, axis=1)
    scale = np.where(sine < 1e-12, 1.0, np.arctan2(sine, (np.trace(m, axis1=1, axis2=2) - 1) / 2) / np.where(sine < 1e-12, 1.0, sine))
    return v * scale[:, None]


class Clouds:
    """Source and target clouds of some groups, and pairs of them that are aligned at once: group, rotation, place.

    A point keeps a list of the targets that it can meet while it moves no farther than ``SLACK``, so a round looks at a few
    targets a point and nothing is searched anew.
    """

    def __init__(self, table, keys: list[str]):
        group = np.cumsum(changes(table, keys))
        kind = table.column("__kind").to_numpy()
        self.groups = group[-1] + 1
        xyz = np.stack([table.column(n).to_numpy() for n in "xyz"], axis=1)
        self.source, self.target = xyz[kind == 1], xyz[kind == 2]
        self.normal = np.stack([table.column(n).to_numpy()[kind == 2] for n in ("nx", "ny", "nz")], axis=1)
        self.mine = np.searchsorted(group[kind == 1], np.arange(self.groups + 1))
        self.of = group[kind == 2]
        first = np.flatnonzero(kind == 0)
        self.names = list(zip(*(table.column(k).take(first).to_pylist() for k in keys)))
        self.starts = table.column("__start").take(first).to_pylist()
        self.pair = group[first]

    def size(self, pairs: np.ndarray) -> np.ndarray:
        return self.mine[self.pair[pairs] + 1] - self.mine[self.pair[pairs]]

    def place(self, pairs: np.ndarray, limit: float) -> None:
        """The points of ``pairs`` from here on, which may be matched up to ``limit``."""
        n = self.size(pairs)
        self.row, self.who = spans(self.mine[self.pair[pairs]], n), np.repeat(np.arange(len(pairs)), n)
        self.group, self.listed, self.limit = np.repeat(self.pair[pairs], n), None, limit

    def _list(self, p: np.ndarray, limit: float) -> None:
        """All (point, target) within ``limit`` and the slack, ordered by point and target."""
        self.listed, self.limit, far = p, limit, limit + SLACK
        self.i, self.j = close(p, self.group, self.target, self.of, far)
        order = np.lexsort((self.j, self.i))
        self.i, self.j = self.i[order], self.j[order]
        self.first = np.flatnonzero(np.diff(self.i, prepend=-1))

    def matched(self, r: np.ndarray, t: np.ndarray, limit: float):
        """(pair, place, target place, normal) of the points that have a target nearer than ``limit``, the nearest; of equal ones the first in order."""
        p = np.einsum("kij,kj->ki", r[self.who], self.source[self.row]) + t[self.who]
        if self.listed is None or limit > self.limit or (len(p) and ((p - self.listed) ** 2).sum(axis=1).max() > SLACK * SLACK):
            self._list(p, limit)
        if not len(self.i):
            return self.who[:0], p[:0], p[:0], p[:0]
        d = p[self.i] - self.target[self.j]
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        least = np.minimum.reduceat(d2, self.first)
        hit = np.flatnonzero(d2 == np.repeat(least, np.diff(self.first, append=len(d2))))
        best = hit[np.searchsorted(hit, self.first)]
        best = best[least < limit * limit]
        i, j = self.i[best], self.j[best]
        return self.who[i], p[i], self.target[j], self.normal[j]

    @staticmethod
    def systems(who: np.ndarray, a: np.ndarray, res: np.ndarray, pairs: int):
        """Weighted normal equations, rows and sum of weights per pair."""
        w = np.minimum(1.0, 0.1 / np.maximum(np.abs(res), 1e-10))
        sums = np.concatenate([(w[:, None, None] * a[:, :, None] * a[:, None, :]).reshape(-1, 36), -(w * res)[:, None] * a, w[:, None]], axis=1)
        total = np.zeros((pairs, 43))
        first = np.flatnonzero(np.diff(who, prepend=-1))
        if len(who):
            total[who[first]] = np.add.reduceat(sums, first, axis=0)
        return total[:, :36].reshape(-1, 6, 6), total[:, 36:42], np.bincount(who, minlength=pairs), total[:, 42]

    def align(self, r: np.ndarray, t: np.ndarray, rounds: int, gate: tuple[float, float], step):
        """All pairs until they rest: ``step`` gives their new poses, which have enough points and which rest. Returns poses, which pairs have one, and their last condition."""
        r, t, live, condition = r.copy(), t.copy(), np.arange(len(r)), np.full(len(r), np.nan)
        kept = np.ones(len(r), bool)
        self.place(live, gate[0])
        for i in range(rounds):
            if not len(live):
                break
            limit = max(gate[1], gate[0] * (1 - i / rounds))
            who, p, q, n = self.matched(r[live], t[live], limit)
            new, enough, still = step(live, r[live], t[live], who, p, q, n)
            r[live], t[live], condition[live] = new
            kept[live[~enough]] = False
            going = enough & ~still
            if not going.all():
                live = live[going]
                self.place(live, limit)
        return r, t, kept, condition

    def quality(self, r: np.ndarray, t: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of matched points within 0.5 m, and the root of their mean squared distance from the planes (NaN without any)."""
        self.place(pairs, 0.5)
        who, p, q, n = self.matched(r[pairs], t[pairs], 0.5)
        res = np.einsum("ki,ki->k", p - q, n)
        count = np.bincount(who, minlength=len(pairs))
        square = np.bincount(who, res * res, len(pairs))
        some = np.maximum(count, 1)
        return count / np.maximum(self.size(pairs), 1), np.where(count > 0, np.sqrt(square / some), np.nan)


def _poses(starts: list[dict], prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    r = np.array([[[s[f"{prefix}r{a}{b}"] for b in range(3)] for a in range(3)] for s in starts], float).reshape(-1, 3, 3)
    return r, np.array([[s[f"{prefix}t{a}"] for a in "xyz"] for s in starts], float).reshape(-1, 3)


def _aligned(source: DataFrame, target: DataFrame, starts: DataFrame, keys: list[str], told: list[str], more: list[str], fit) -> DataFrame:
    """``fit`` of whole groups of clouds: all rows of ``keys`` in one task, starts first, clouds moved once.

    Returns keys, ``told`` of the starts, the pose columns and ``more`` numbers.
    """
    from ..functions import rotation as rot

    start = F.struct(*[c(n) for n in starts.columns if n not in keys])
    blank = lambda names: [F.lit(None).cast("double").alias(n) for n in names]
    normal, place = ["nx", "ny", "nz"], [c(n).cast("double").alias(n) for n in "xyz"]
    first = starts.select(*keys, F.lit(0).alias("__kind"), *blank("xyz"), *blank(normal), start.alias("__start"))
    none = F.lit(None).cast(first.schema["__start"].dataType).alias("__start")
    rows = first.unionByName(source.select(*keys, F.lit(1).alias("__kind"), *place, *blank(normal), none))
    rows = rows.unionByName(target.select(*keys, F.lit(2).alias("__kind"), *place, *[c(n).cast("double").alias(n) for n in normal], none))
    rows = rows.where(" and ".join(f"`{k}` is not null" for k in keys)).where("__kind = 0 or x + y + z is not null")
    tasks = max(1, -(-starts.select(*keys).distinct().count() // PAIRS_A_TASK))
    rows = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "__kind", *"xyz", *normal)
    shape = T.StructType(starts.select(*keys, *told).schema.fields + [T.StructField(n, T.DoubleType()) for n in (*rot.POSE, *more)])
    schema = to_arrow_schema(shape)

    def run(batches):
        for table in whole(batches, keys, ROWS):
            clouds = Clouds(table, keys)
            if not clouds.starts:
                continue
            pairs, r, t, numbers = fit(clouds)
            columns = [*zip(*[(*clouds.names[i], *[clouds.starts[i][n] for n in told]) for i in pairs])] or [()] * (len(keys) + len(told))
            columns += [*r[pairs].reshape(-1, 9).T, *t[pairs].T, *numbers]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type, from_pandas=True) for x, f in zip(columns, schema)], schema=schema)

    return cut(rows.mapInArrow(run, shape), "aligned")


def align_clouds(source: DataFrame, target: DataFrame, initial: DataFrame, keys: list[str], seeds: list[str] = (), rounds: int = 24,
                 gate: tuple[float, float] = (1.8, 0.35)) -> DataFrame:
    """Point-to-plane alignment of all pairs at once: pose columns and quality per pair.

    ``source``: keys, sid, x, y, z (voxelised); ``target``: keys, x, y, z and
    the normal nx, ny, nz; ``initial``: keys, ``seeds`` and the pose columns.
    Clouds are moved once, and a pair's rounds run in the task that holds its two clouds:
    a round matches each moved point to its nearest target, sums 27 numbers per
    pair and solves one 6x6 system per pair. Pairs that no longer move drop out of the later rounds.
    """
    from ..functions import rotation as rot

    def step(live, r, t, who, p, q, n):
        m, b, count, _ = Clouds.systems(who, np.concatenate([np.cross(p, n), n], axis=1), np.einsum("ki,ki->k", p - q, n), len(live))
        x, condition = solutions(m, b, 1e-6)
        turn = _rodrigues(x[:, :3])
        still = (np.linalg.norm(x[:, :3], axis=1) < 2e-5) & (np.linalg.norm(x[:, 3:], axis=1) < 8e-4)
        return (turn @ r, np.einsum("kij,kj->ki", turn, t) + x[:, 3:], condition), count > 0, still

    def fit(clouds: Clouds):
        r, t, kept, condition = clouds.align(*_poses(clouds.starts), rounds, gate, step)
        pairs = np.flatnonzero(kept)
        overlap, rmse = clouds.quality(r, t, pairs)
        return pairs, r, t, [condition[pairs], rmse, overlap]

    starts = initial.select(*keys, *seeds, *rot.POSE)
    return _aligned(source, target, starts, keys, list(seeds), ["condition", "rmse_plane_m", "overlap"], fit)


def accept_alignment(df: DataFrame) -> DataFrame:
    """Status and reason of an alignment from its metrics.

    Needs points, span_m, base_points, base_span_m, overlap, rmse_plane_m, condition, error_m, angle_rad, elapsed_s, history.
    """
    weak_support = (c("points") < F.greatest(F.lit(1000.0), 0.65 * c("base_points"))) | (c("span_m") < F.greatest(F.lit(15.0), 0.5 * c("base_span_m")))
    weak = (c("overlap") < 0.45) | (c("rmse_plane_m") > 0.22) | (c("condition") > 3000)
    moved = (c("history") >= 3) & ((c("error_m") > F.greatest(F.lit(0.5), c("elapsed_s") * 1.5)) | (c("angle_rad") > F.greatest(F.lit(0.025), c("elapsed_s") * 0.06)))
    reason = F.when(weak_support, "insufficient_spatial_support").when(weak, "weak_registration").when(moved, "inconsistent_motion").otherwise("")
    df = df.withColumn("reason", reason)
    lost = (c("reason") != "") & (c("elapsed_s") > 2)
    return df.withColumns({"pose_status": F.when(c("reason") == "", "ok").otherwise("unavailable"), "ends_session": lost})


# Starting offsets (x, y in metres, yaw in radians) of a recovery, and the scales of its motion prior (rad, m).
RECOVERY_SEEDS = [(0.0, 0.0, 0.0), (0.25, 0.0, 0.0), (-0.25, 0.0, 0.0), (0.0, 0.5, 0.005), (0.0, -0.5, -0.005)]
PRIOR_SCALE = (0.1, 0.1, 0.1, 10.0, 10.0, 10.0)


def _held_to_prior(source: DataFrame, target: DataFrame, starts: DataFrame, keys: list[str], rounds: int, gate: tuple[float, float], least: int) -> DataFrame:
    """Point-to-plane alignment in which a motion prior (columns o + pose) adds to every pair's system, for what the points leave open.

    The points' part is a mean, so that the prior weighs the same in thin and dense clouds. Pairs with fewer than ``least``
    matched points in a round are given up.
    """
    stiff = np.array([1 / x ** 2 for x in PRIOR_SCALE])

    def fit(clouds: Clouds):
        prior = _poses(clouds.starts, "o")

        def step(live, r, t, who, p, q, n):
            a = np.concatenate([np.cross(p - t[who], n), n], axis=1)
            m, b, count, total = Clouds.systems(who, a, np.einsum("ki,ki->k", p - q, n), len(live))
            off = np.concatenate([_rotation_vector(r @ prior[0][live].transpose(0, 2, 1)), t - prior[1][live]], axis=1)
            total = np.maximum(total, 1e-300)
            x, condition = solutions(m / total[:, None, None] + np.diag(stiff), b / total[:, None] - stiff * off, 0.0)
            return (_rodrigues(x[:, :3]) @ r, t + x[:, 3:], condition), count >= max(least, 1), np.linalg.norm(x, axis=1) < 1e-5

        r, t, kept, _ = clouds.align(*_poses(clouds.starts), rounds, gate, step)
        pairs = np.flatnonzero(kept)
        overlap, rmse = clouds.quality(r, t, pairs)
        some = overlap > 0
        return pairs[some], r, t, [overlap[some], rmse[some]]

    return _aligned(source, target, starts, keys, ["seed"], ["overlap", "rmse_plane_m"], fit)


def recover_alignment(source: DataFrame, target: DataFrame, predicted: DataFrame, references: DataFrame, keys: list[str], rounds: int = 60,
                      gate: tuple[float, float] = (1.8, 0.35), least: int = 100) -> DataFrame:
    """The pose of each frame after a gap, against the newest of several references that gives a stable one.

    ``source``: keys, sid, x, y, z (voxelised); ``predicted``: keys and the pose that the motion before the gap foretells; ``references``:
    keys, ref (larger is newer) and the reference's pose, one row per frame and reference; ``target``: ref, x, y, z and the normal nx, ny, nz.
    A reference is stable if five starts all end with enough overlap and a small rest, within 10 cm and 0.01 rad of the first; the
    best fit of them counts. Only frames without a stable reference go on to the next older one.

    Returns per row of ``predicted``: keys, accepted, ref, the pose in the world, spread_m, spread_rad, overlap and rmse_plane_m (null if none is stable).
    """
    from pyspark.sql import Window

    from ..functions import rotation as rot

    source, target = (cut(d, "clouds") for d in (source.select(*keys, "x", "y", "z"), target.select("ref", "x", "y", "z", "nx", "ny", "nz")))
    newest = Window.partitionBy(*keys).orderBy(c("ref").desc())  # a frame's references: a few rows
    world = references.select(*keys, "ref", *[c(n).alias("w" + n) for n in rot.POSE])
    first = predicted.select(*keys, *rot.POSE).join(world, keys).withColumn("__rank", F.row_number().over(newest))
    back = rot.transpose(rot.matrix("wr"))
    r, t = rot.compose(back, rot.matrix()), rot.to_sensor(vec("t"), rot.matrix("wr"), vec("wt"))
    begin = cut(first.select(*keys, "ref", "__rank", *[r[a][b].alias(f"or{a}{b}") for a in range(3) for b in range(3)], *named(t, "ot")), "recover")
    seeds = F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), *[F.lit(v).alias(n) for n, v in zip(("dx", "dy", "yaw"), s)]) for i, s in enumerate(RECOVERY_SEEDS)]))
    yaw = rot.rodrigues((F.lit(0.0), F.lit(0.0), c("s.yaw")))
    turned = rot.compose(yaw, rot.matrix("or"))
    found, rank = None, 0
    while True:
        rank += 1
        now = begin.where(c("__rank") == rank)
        if found is not None:
            now = now.join(found, keys, "left_anti")
        if now.isEmpty():
            break
        starts = now.withColumn("s", seeds).select(*keys, "ref", "s.seed", *[f"o{n}" for n in rot.POSE], *[turned[a][b].alias(f"r{a}{b}") for a in range(3) for b in range(3)],
                                                   (c("otx") + c("s.dx")).alias("tx"), (c("oty") + c("s.dy")).alias("ty"), c("otz").alias("tz"))
        pair = now.select(*keys, "ref")
        fits = _held_to_prior(source.join(pair, keys), target.join(pair, "ref"), starts, [*keys, "ref"], rounds, gate, least)
        centre = fits.where("seed = 0").select(*keys, *[c(n).alias("z" + n) for n in rot.POSE])
        j = fits.join(centre, keys)
        turn = rot.angle(rot.compose(rot.transpose(rot.matrix("zr")), rot.matrix("r")))
        j = j.withColumns({"shift": norm(sub(vec("t"), vec("zt"))), "angle": turn, "good": (c("overlap") >= 0.45) & (c("rmse_plane_m") <= 0.22)})
        best = j.groupBy(*keys, "ref").agg(F.max("shift").alias("spread_m"), F.max("angle").alias("spread_rad"), F.bool_and("good").alias("__g"), F.count(F.lit(1)).alias("__n"),
                                           F.min_by(F.struct(*rot.POSE, "overlap", "rmse_plane_m"), F.struct("rmse_plane_m", "seed")).alias("b"))
        stable = c("__g") & (c("__n") == len(RECOVERY_SEEDS)) & (c("spread_m") <= 0.1) & (c("spread_rad") <= 0.01)
        good = cut(best.where(stable).select(*keys, "ref", "spread_m", "spread_rad", "b.*"), "recover")
        found = good if found is None else found.unionByName(good)
    if found is None:
        found = begin.limit(0).select(*keys, "ref", *[F.lit(0.0).alias(n) for n in ("spread_m", "spread_rad", *rot.POSE, "overlap", "rmse_plane_m")])
    out = predicted.select(*keys).join(found, keys, "left").join(world, [*keys, "ref"], "left")
    r, t = rot.compose(rot.matrix("wr"), rot.matrix()), rot.to_world(vec("t"), rot.matrix("wr"), vec("wt"))
    return out.select(*keys, c("ref").isNotNull().alias("accepted"), "ref", *[r[a][b].alias(f"r{a}{b}") for a in range(3) for b in range(3)], *named(t, "t"),
                      "spread_m", "spread_rad", "overlap", "rmse_plane_m")


_MUL = """named_struct({rot}, {tra})"""


def _product(a: str, b: str) -> str:
    rot_ = ", ".join(f"'r{i}{j}', " + " + ".join(f"{a}.r{i}{k}*{b}.r{k}{j}" for k in range(3)) for i in range(3) for j in range(3))
    tra = ", ".join(f"'t{x}', " + " + ".join(f"{a}.r{i}{k}*{b}.t{'xyz'[k]}" for k in range(3)) + f" + {a}.t{x}" for i, x in enumerate("xyz"))
    return _MUL.format(rot=rot_, tra=tra)


def compose_poses(df: DataFrame, keys: list[str], order: str, block: int = 256) -> DataFrame:
    """Cumulative product of relative poses along ``order``.

    Products are associative: each block of ``block`` frames folds on its own,
    the block products fold per key, and every frame takes the product of the
    earlier blocks. No task ever holds more than a block or one row per block.
    """
    from ..functions import rotation as rot

    pose = F.struct(*[c(n).cast("double").alias(n) for n in rot.POSE])
    eye = "named_struct(" + ", ".join(f"'{n}', CAST({IDENTITY[n]} AS DOUBLE)" for n in rot.POSE) + ")"

    def fold(rows: DataFrame, by: list[str], o: str) -> DataFrame:
        g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(c(o).alias("o"), c("__p").alias("p")))).alias("v"))
        typ = "struct<" + ",".join(f"{n}:double" for n in rot.POSE) + ">"
        step = f"named_struct('acc', {_product('a.acc', 'e.p')}, 'out', concat(a.out, array(named_struct('o', e.o, 'p', {_product('a.acc', 'e.p')}))))"
        expr = f"aggregate(v, named_struct('acc', {eye}, 'out', CAST(array() AS array<struct<o:bigint,p:{typ}>>)), (a, e) -> {step}, a -> a.out)"
        return g.select(*by, F.explode(F.expr(expr)).alias("r")).select(*by, c("r.o").alias(o), c("r.p").alias("__c"))

    rows = df.select(*keys, c(order).cast("long").alias(order), pose.alias("__p")).withColumn("__b", F.floor(c(order) / block))
    inner = fold(rows, [*keys, "__b"], order)
    ends = inner.groupBy(*keys, "__b").agg(F.max_by("__c", order).alias("__p"))
    upto = fold(ends, keys, "__b")
    # The product over all earlier blocks sits at the newest block before this one.
    from ..operators.ordered import blocked_scan

    before = blocked_scan(upto, keys, "__b", {"__pre": ("lag", c("__c"))}).select(*keys, "__b", "__pre")
    j = inner.join(before, [*keys, "__b"], "left")
    total = F.when(c("__pre").isNull(), c("__c")).otherwise(F.expr(_product("__pre", "__c")))
    return j.select(*keys, c(order).cast(df.schema[order].dataType).alias(order), total.alias("__t")).select(*keys, order, "__t.*")


def anchor_chain(poses: DataFrame, correction: DataFrame, keys: list[str], order: str = "frame") -> DataFrame:
    """Left-multiply the poses from ``since`` on by the key's one correction (columns c00.., cx, cy, cz)."""
    from ..functions import rotation as rot

    j = poses.join(correction, keys, "left")
    m, t = rot.matrix("c"), (c("cx"), c("cy"), c("cz"))
    r = rot.compose(m, rot.matrix("r"))
    p = rot.to_world(vec("t"), m, t)
    on = c("since").isNotNull() & (c(order) >= c("since"))
    out = {f"r{a}{b}": F.when(on, r[a][b]).otherwise(c(f"r{a}{b}")) for a in range(3) for b in range(3)}
    out |= {"t" + a: F.when(on, v).otherwise(c("t" + a)) for a, v in zip("xyz", p)}
    return j.select(*[c(n) for n in poses.columns if n not in out], *[e.alias(n) for n, e in out.items()])


# --- smooth curves --------------------------------------------------------------------------------


def _band_solve(bands: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of symmetric systems of half-width 3, and the same bands of their inverses.

    ``bands[a, i, d]`` is entry (i, i + d) of system ``a``. The systems are taken as block
    tridiagonal in blocks of three, so time and memory grow with the number of rows.
    """
    systems, n = b.shape
    size = -(-n // 3) * 3
    m, y = np.zeros((systems, size + 3, 4)), np.zeros((systems, size))
    m[:, n:, 0] = 1.0
    m[:, :n], y[:, :n] = bands, b
    blocks = size // 3
    diag, low = np.zeros((systems, blocks, 3, 3)), np.zeros((systems, blocks, 3, 3))
    for r in range(3):
        for q in range(3):
            diag[:, :, r, q] = m[:, min(r, q):size:3, abs(r - q)]
            if r <= q:  # entry (3 (k + 1) + r, 3 k + q)
                low[:, :, r, q] = m[:, q:size:3, 3 + r - q]
    y = y.reshape(systems, blocks, 3, 1)
    gain, inv = np.zeros_like(low), np.zeros_like(diag)
    for k in range(blocks):
        d = diag[:, k]
        if k:
            gain[:, k] = low[:, k - 1] @ inv[:, k - 1]
            d = d - gain[:, k] @ low[:, k - 1].transpose(0, 2, 1)
            y[:, k] -= gain[:, k] @ y[:, k - 1]
        inv[:, k] = np.linalg.inv(d)
    x, z = np.zeros_like(y), np.zeros((systems, size + 3, 4))
    here = None
    for k in range(blocks - 1, -1, -1):
        x[:, k] = inv[:, k] @ y[:, k]
        beside = np.zeros((systems, 3, 3))
        if k + 1 < blocks:
            g = gain[:, k + 1]
            x[:, k] -= g.transpose(0, 2, 1) @ x[:, k + 1]
            beside = -g.transpose(0, 2, 1) @ here
            here = inv[:, k] - beside @ g
        else:
            here = inv[:, k]
        both = np.concatenate([here, beside], axis=2)
        for r in range(3):
            z[:, 3 * k + r] = both[:, r, r:r + 4]
    return x.reshape(systems, size)[:, :n], z[:, :n]


def _bends(length: float, intervals: int, spacing: float, step: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Per interval the products (10 pairs) of second and of third derivatives of its four basis functions, summed over points every ``step``."""
    at = np.arange(0.0, length, step)
    at = np.append(at[at < length - 1e-7], length)
    j = np.minimum((at / spacing).astype(int), intervals - 1)
    t = at / spacing - j
    second = np.stack([1 - t, 3 * t - 2, 1 - 3 * t, t]) / spacing ** 2
    third = np.repeat(np.array([-1.0, 3.0, -3.0, 1.0])[:, None], len(t), axis=1) / spacing ** 3
    sums = [np.stack([np.bincount(j, d[p] * d[q], intervals) for p, q in PAIRS], axis=1) for d in (second, third)]
    return sums[0], sums[1]


PAIRS = [(p, q) for p in range(4) for q in range(p, 4)]
RIDGE = 1e-8


def smooth_curves(obs: DataFrame, keys: list[str], s: str, values: list[str], sigma: str | list[str], spacing: float = 4.0, smooth: float = 1.0,
                  prior: tuple[float, float] | list[tuple[float, float]] = (0.025, 0.004), loss: str = "huber", rounds: int = 6,
                  query: DataFrame | None = None) -> DataFrame:
    """Cubic spline through noisy stations with covariance: ``<value>_fit`` and ``<value>_var`` for every row of ``query`` (default: ``obs``).

    Knots lie every ``spacing`` from the curve's first station. A plain fit gives the first residuals, then ``rounds`` times the rows are
    weighted by ``loss`` of their residual over all values and solved again with priors on the second and third derivative
    (one pair for all values or one each). The variance is that of the last system, at least 3 mm squared. ``sigma`` is one column or one per value,
    taken as at least 1 mm. Observations with a null or non-finite station, value or sigma are left out of the fit;
    rows without a station, or of a curve without observations, get nulls.

    Spark sums ten products per (curve, interval) and value. What a task solves is one curve's knots, whose number is its length over
    ``spacing`` whatever the number of rows, by a banded factorisation.
    """
    from ..functions.numeric import is_finite, robust_weight

    sigmas = [sigma] * len(values) if isinstance(sigma, str) else sigma
    priors = [prior] * len(values) if isinstance(prior, tuple) else prior
    asked = obs if query is None else query
    ends = obs.select(*keys, s).unionByName(asked.select(*keys, s)).where(is_finite(c(s))).groupBy(*keys).agg(F.min(s).alias("__s0"), F.max(s).alias("__s1"))
    ends = ends.withColumn("__n", F.greatest(F.lit(1), F.ceil((c("__s1") - c("__s0") - 1e-8) / spacing)).cast("long"))

    def placed(df: DataFrame, how: str) -> DataFrame:
        u = (c(s) - c("__s0")) / spacing
        return df.join(ends, keys, how).withColumn("__j", F.least(F.floor(u), c("__n") - 1)).withColumn("__t", u - c("__j"))

    t = c("__t")
    basis = [(1 - t) ** 3 / 6, (3 * t ** 3 - 6 * t ** 2 + 4) / 6, (-3 * t ** 3 + 3 * t ** 2 + 3 * t + 1) / 6, t ** 3 / 6]
    good = is_finite(c(s))
    for n in {*values, *sigmas}:
        good = good & is_finite(c(n))
    used = obs.where(good).select(*keys, c(s), *[c(v).cast("double").alias(f"__y{a}") for a, v in enumerate(values)],
                                  *[F.greatest(c(n).cast("double"), F.lit(1e-3)).alias(f"__e{a}") for a, n in enumerate(sigmas)])
    used = cut(placed(used, "inner").select(*keys, "__j", "__n", (c("__s1") - c("__s0")).alias("__len"), *[b.alias(f"__b{k}") for k, b in enumerate(basis)],
                                            *[f"__y{a}" for a in range(len(values))], *[f"__e{a}" for a in range(len(values))]), "spline-rows")
    kt = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in obs.select(*keys).schema.fields)

    def solved(weighted: DataFrame, first: bool, last: bool) -> DataFrame:
        w = [c("__w") if first else c("__w") / (c(f"__e{a}") * c(f"__e{a}")) for a in range(len(values))]
        sums = []
        for a in range(len(values)):
            sums += [F.sum(w[a] * c(f"__b{p}") * c(f"__b{q}")).alias(f"m{a}_{i}") for i, (p, q) in enumerate(PAIRS)]
            sums += [F.sum(w[a] * c(f"__b{p}") * c(f"__y{a}")).alias(f"r{a}_{p}") for p in range(4)]
        per = weighted.groupBy(*keys, "__j").agg(F.first("__n").alias("__n"), F.first("__len").alias("__len"), *sums)

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            count = int(pdf["__n"].iloc[0])
            j = pdf["__j"].to_numpy()
            bands, right = np.zeros((len(values), count + 3, 4)), np.zeros((len(values), count + 3))
            bands[:, :, 0] = RIDGE
            bends = None if first else _bends(float(pdf["__len"].iloc[0]), count, spacing)
            for a in range(len(values)):
                for i, (p, q) in enumerate(PAIRS):
                    bands[a, j + p, q - p] += pdf[f"m{a}_{i}"].to_numpy()
                    if bends:
                        bands[a, p:p + count, q - p] += sum(d[:, i] * smooth / x ** 2 for d, x in zip(bends, priors[a]))
                for p in range(4):
                    right[a, j + p] += pdf[f"r{a}_{p}"].to_numpy()
            x, z = _band_solve(bands, right)
            out = {k: [pdf[k].iloc[0]] * count for k in keys} | {"__j": np.arange(count)}
            for a in range(len(values)):
                out[f"__c{a}"] = list(np.stack([x[a, p:p + count] for p in range(4)], axis=1))
                if last:
                    out[f"__z{a}"] = list(np.stack([z[a, p:p + count, q - p] for p, q in PAIRS], axis=1))
            return pd.DataFrame(out)

        shape = kt + "__j long" + "".join(f", __c{a} array<double>" + (f", __z{a} array<double>" if last else "") for a in range(len(values)))
        return cut(per.groupBy(*keys).applyInPandas(fit, shape), "spline")

    coef = solved(used.withColumn("__w", F.lit(1.0)), True, rounds == 0)
    for step in range(rounds):
        at = [sum(c(f"__b{p}") * c(f"__c{a}")[p] for p in range(4)) for a in range(len(values))]
        far = F.sqrt(sum(((y - c(f"__y{a}")) / c(f"__e{a}")) ** 2 for a, y in enumerate(at)))
        rows = used.join(coef, [*keys, "__j"]).withColumn("__w", F.greatest(robust_weight(far, loss), F.lit(1e-5)))
        before, coef = coef, solved(rows, False, step == rounds - 1)
        discard(before)

    out = placed(asked, "left").select(*asked.columns, "__j", *[b.alias(f"__b{k}") for k, b in enumerate(basis)]).join(coef, [*keys, "__j"], "left")
    made = {}
    for a, v in enumerate(values):
        made[f"{v}_fit"] = sum(c(f"__b{p}") * c(f"__c{a}")[p] for p in range(4))
        spread = sum((1 if p == q else 2) * c(f"__b{p}") * c(f"__b{q}") * c(f"__z{a}")[i] for i, (p, q) in enumerate(PAIRS))
        made[f"{v}_var"] = F.when(spread.isNotNull(), F.greatest(spread, F.lit(0.003 ** 2)))
    return out.select(*asked.columns, *[e.alias(n) for n, e in made.items()])
