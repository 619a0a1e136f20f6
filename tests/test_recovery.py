"""Recovery after a gap against the same steps in plain NumPy over all pairs of points."""

import numpy as np
from pyspark.sql import functions as F

from swathe.functions import rotation as rot
from swathe.plans import fit

c = F.col
ROUNDS, GATE = 3, (1.8, 0.35)


def turn(v):
    a = np.linalg.norm(v)
    if a < 1e-15:
        return np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / a
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def vector(m):
    a = np.arccos(np.clip((np.trace(m) - 1) / 2, -1, 1))
    v = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]]) / 2
    return v if a < 1e-9 else v * a / np.sin(a)


def nearest(p, q):
    d = np.linalg.norm(p[:, None] - q[None], axis=2)
    return d.min(axis=1), d.argmin(axis=1)


def one_start(s, q, n, r, t, r0, t0, least):
    stiff = np.array([100, 100, 100, 0.01, 0.01, 0.01])
    for i in range(ROUNDS):
        p = s @ r.T + t
        d, j = nearest(p, q)
        keep = d < max(GATE[1], GATE[0] * (1 - i / ROUNDS))
        if keep.sum() < least:
            return None
        p, m = p[keep], n[j[keep]]
        res = np.einsum("ij,ij->i", p - q[j[keep]], m)
        w = np.minimum(1, 0.1 / np.maximum(np.abs(res), 1e-10))
        w /= w.sum()
        jac = np.hstack([np.cross(p - t, m), m])
        off = np.r_[vector(r @ r0.T), t - t0]
        x = np.linalg.solve((jac * w[:, None]).T @ jac + np.diag(stiff), -(jac * w[:, None]).T @ res - stiff * off)
        r, t = turn(x[:3]) @ r, t + x[3:]
        if np.linalg.norm(x) < 1e-5:
            break
    p = s @ r.T + t
    d, j = nearest(p, q)
    keep = d < 0.5
    res = np.einsum("ij,ij->i", p[keep] - q[j[keep]], n[j[keep]])
    return r, t, keep.mean(), np.sqrt(np.mean(res ** 2)) if keep.any() else np.inf


def recovered(s, refs, pose, least):
    """(ref, rotation, place, spread) of the newest stable reference, or None."""
    for name, q, n, (rw, tw) in refs:
        r0, t0 = rw.T @ pose[0], rw.T @ (pose[1] - tw)
        fits = [one_start(s, q, n, turn(np.array([0, 0, yaw])) @ r0, t0 + [dx, dy, 0], r0, t0, least) for dx, dy, yaw in fit.RECOVERY_SEEDS]
        if any(f is None or f[2] < 0.45 or f[3] > 0.22 for f in fits):
            continue
        shift = max(np.linalg.norm(f[1] - fits[0][1]) for f in fits)
        angle = max(np.linalg.norm(vector(fits[0][0].T @ f[0])) for f in fits)
        if shift <= 0.1 and angle <= 0.01:
            best = min(fits, key=lambda f: f[3])
            return name, rw @ best[0], rw @ best[1] + tw, shift
    return None


def room(rng, n=420):
    """Floor, two walls and an end, with normals."""
    k = np.arange(n) % 4
    u, v = rng.uniform(-4, 4, n), rng.uniform(0, 3, n)
    p = np.where((k == 0)[:, None], np.c_[u, rng.uniform(-3, 3, n), 0 * u], np.where((k == 1)[:, None], np.c_[u, 0 * u + 3, v], np.where((k == 2)[:, None], np.c_[u, 0 * u - 3, v], np.c_[0 * u + 4, rng.uniform(-3, 3, n), v])))
    return p, np.array([[0, 0, 1.0], [0, 1, 0], [0, 1, 0], [1, 0, 0]])[k]


def test_recovery_equals_plain_steps(spark):
    rng = np.random.default_rng(8)
    source, target, predicted, references, want = [], [], [], [], {}
    for frame in range(4):
        q, n = room(rng)
        world = turn(np.array([0, 0, 0.3 * frame])), np.array([10.0 * frame, 1, 0])
        move = turn(np.array([0.002, -0.003, 0.006])), np.array([0.12, -0.08, 0.03])
        s = ((q - move[1]) @ move[0] + rng.normal(0, 0.01, q.shape))[rng.random(len(q)) < 0.9]
        pose = world[0] @ turn(np.array([0, 0, 0.002])), world[1] + [0.02, 0.01, 0]
        other, on = room(rng)
        far = other * [2.5, 2.5, 6] + [0, 0, 4]
        refs = [(20 + frame, far, on, world)] * (frame in (1, 3)) + [(10 + frame, q if frame != 3 else far + 50, n, world)]
        predicted.append((frame, *map(float, pose[0].ravel()), *map(float, pose[1])))
        source += [(frame, i, *map(float, p)) for i, p in enumerate(s)]
        for name, cloud, normal, (rw, tw) in refs:
            references.append((frame, name, *map(float, rw.ravel()), *map(float, tw)))
            target += [(name, *map(float, (*p, *m))) for p, m in zip(cloud, normal)]
        want[frame] = recovered(s, refs, pose, 100)
    numbers = ", ".join(f"{n} double" for n in rot.POSE)
    out = fit.recover_alignment(
        spark.createDataFrame(source, "frame int, sid int, x double, y double, z double"),
        spark.createDataFrame(target, "ref int, x double, y double, z double, nx double, ny double, nz double"),
        spark.createDataFrame(predicted, f"frame int, {numbers}"), spark.createDataFrame(references, f"frame int, ref int, {numbers}"), ["frame"], rounds=ROUNDS)
    got = {r["frame"]: r for r in out.collect()}
    assert {f: got[f]["ref"] for f in got} == {0: 10, 1: 11, 2: 12, 3: None}
    for frame, w in want.items():
        assert got[frame]["accepted"] == (w is not None)
        if w is None:
            assert got[frame]["tx"] is None and got[frame]["overlap"] is None
            continue
        assert w[0] == got[frame]["ref"]
        r = np.array([got[frame][n] for n in rot.R_NAMES]).reshape(3, 3)
        t = np.array([got[frame]["t" + a] for a in "xyz"])
        assert np.abs(r - w[1]).max() < 1e-6 and np.abs(t - w[2]).max() < 1e-6 and abs(got[frame]["spread_m"] - w[3]) < 1e-6


def test_rotation_vector_undoes_rodrigues(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0), (1e-13, 0.0, 0.0), (0.1, -0.2, 0.3), (2.0, 1.0, -2.0), (0.0, 3.1, 0.0)], "x double, y double, z double")
    v = rot.rotation_vector(rot.rodrigues((c("x"), c("y"), c("z"))))
    for r in rows.select("x", "y", "z", *[e.alias("v" + a) for e, a in zip(v, "xyz")]).collect():
        assert max(abs(r[a] - r["v" + a]) for a in "xyz") < 1e-9
