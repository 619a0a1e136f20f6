"""Pairs of components that share support, found inside a task that holds a stretch of time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .groups import changes, whole

# Voxels that a task matches at once, in whole components.
CHUNK = 1024


def _sides(pair: np.ndarray, who: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, least distance) of each voxel that a pair has met, ordered by pair and distance."""
    key = pair * most + who
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    pair, d = key[first] // most, np.minimum.reduceat(d[order], first)
    order = np.lexsort((d, pair))
    return pair[order], d[order]


def _median(pairs: np.ndarray, pair: np.ndarray, d: np.ndarray, size: np.ndarray):
    """Per pair: voxels met, the median distance of all ``size`` of them (NaN unless known), and whether it is beyond the radius."""
    first, end = np.searchsorted(pair, pairs, "left"), np.searchsorted(pair, pairs, "right")
    low, high = (size + 1) // 2, (size + 2) // 2
    known = end - first >= high
    middle = np.full(len(pairs), np.nan)
    middle[known] = (d[(first + low - 1)[known]] + d[(first + high - 1)[known]]) / 2
    return end - first, middle, end - first < low


def _met(a, b, radius: float, gap: float, wanted: np.ndarray | None):
    """(pair, voxel of a, voxel of b, distance) within ``radius`` and ``gap``; of the ``wanted`` pairs, if given."""
    from ..streaming.tracks import meetings

    found = []
    for i, j, d in meetings(a["xyz"], b["xyz"], radius):
        age = a["t"][i] - b["t"][j]
        pair = a["part"][i] * b["parts"] + b["part"][j]
        ok = (age >= 0) & (age <= gap)
        if wanted is not None:
            at = np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)
            ok &= wanted[at] == pair
        found.append((pair[ok], i[ok], j[ok], d[ok]))
    return [np.concatenate(x) for x in zip(*found)]


def _rows(side: dict, keep: np.ndarray) -> dict:
    return side | {n: side[n][keep] for n in ("xyz", "t", "part")}


def matched(a: dict, b: dict, radius: float, fraction: float, gap: float):
    """(component of a, of b, shared fraction, score) of all pairs. Sides have xyz, t, part (components numbered in order), size and parts."""
    lo, out = 0, []
    while lo < len(a["t"]):
        hi = np.searchsorted(a["part"], a["part"][min(lo + CHUNK, len(a["t"])) - 1], "right")
        mine = _rows(a, slice(lo, hi))
        lo = hi
        near = _rows(b, (b["t"] <= mine["t"].max()) & (b["t"] >= mine["t"].min() - gap))
        wanted, r, share = None, radius, None
        while len(near["t"]):
            pair, i, j, d = _met(mine, near, r, gap, wanted)
            if not len(pair):
                break
            pairs = np.unique(pair) if wanted is None else wanted
            size = a["size"][pairs // b["parts"]], b["size"][pairs % b["parts"]]
            hit_a, ma, far_a = _median(pairs, *_sides(pair, i, d, len(mine["t"])), size[0])
            hit_b, mb, far_b = _median(pairs, *_sides(pair, j, d, len(near["t"])), size[1])
            if share is None:
                share = np.maximum(hit_a / size[0], hit_b / size[1])
            # The middle voxels of a side that met more than half lie within the radius; with fewer, its median is beyond it and so beyond the other side's.
            settled = (~np.isnan(ma) & (~np.isnan(mb) | far_b)) | (~np.isnan(mb) & far_a)
            ok = settled & (share >= fraction)
            score = np.fmin(ma, mb) + (1 - share) * 0.1
            out.append((pairs[ok] // b["parts"], pairs[ok] % b["parts"], share[ok], score[ok]))
            left = ~settled & (share >= fraction)
            if not left.any():
                break
            # What is left open looks twice as far.
            wanted, share, r = pairs[left], share[left], 2 * r
            mine = _rows(mine, np.isin(mine["part"], wanted // b["parts"]))
            near = _rows(near, np.isin(near["part"], wanted % b["parts"]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)]


def matching(place: list[str], keys: list[str], schema: pa.Schema, radius: float, fraction: float, gap: float):
    """For ``mapInArrow``: sorted rows of whole places, a side after the other, as keys, component, track, fraction and score."""
    def run(batches):
        for table in whole(batches, place, 1):
            new = np.flatnonzero(changes(table, place))
            bounds = [0, *new, table.num_rows]
            for lo, hi in zip(bounds, bounds[1:]):
                rows = table.slice(lo, hi - lo)
                side = rows.column("__side").to_numpy()
                part = np.cumsum(changes(rows, ["__side", "t_s", "id"]))
                half = int(np.searchsorted(side, 1))
                if not 0 < half < len(side):
                    continue
                xyz, t = np.stack([rows.column(n).to_numpy() for n in "xyz"], axis=1), rows.column("t_s").to_numpy()
                of = lambda s, base: {"xyz": xyz[s], "t": t[s], "part": part[s] - base, "size": np.bincount(part[s] - base), "parts": int(part[s][-1]) - base + 1}
                a, b = of(slice(0, half), 0), of(slice(half, None), int(part[half]))
                x, y, share, score = matched(a, b, radius, fraction, gap)
                if not len(x):
                    continue
                first = np.flatnonzero(np.diff(part, prepend=-1))
                ids = rows.column("id")
                columns = [pa.array([rows.column(k)[0].as_py()] * len(x), schema.field(k).type) for k in keys]
                columns += [ids.take(first[x]).combine_chunks(), ids.take(first[y + int(part[half])]).combine_chunks(), pa.array(share), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run
