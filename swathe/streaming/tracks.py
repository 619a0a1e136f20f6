"""Tracks: components of successive frames that keep one id while they share support.

In batch a session is dealt into islands, sets of components that can never
meet a track of another island, and an island into eras, between which nothing of it is seen
for so long that all its tracks have ended. Eras are followed in parallel.
Within an era frames arrive in order; only one frame and the live tracks are held.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

from ..functions.cells import CELL, cell_of, explode_neighbours
from ..functions.vector import vec
from ..operators.graph import connected_components
from ..operators.joins import PAD
from ..operators.ordered import blocked_scan, islands
from ..session import cut

c = F.col

# Association limits in metres, share and seconds, and the support cap.
TRACK = {"voxel": 0.05, "radius": 0.35, "fraction": 0.20, "gap_s": 3.0, "confirm": 2, "cap": 12_000}
SESSION = ["run", "generation"]
VOXELS = [*SESSION, "frame", "t_s", "component", "x", "y", "z"]
TRACK_OUT = "run int, generation int, frame int, component string, track long, confirmed boolean"
CHUNK, ROWS_OUT, ROWS_A_TASK = 1024, 8192, 20_000


def meetings(a: np.ndarray, b: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, distances) of all pairs within ``r``, in pieces.

    Cells are numbered so that three neighbours along z are one range of the sorted numbers.
    """
    width, low = r * PAD, np.minimum(a.min(axis=0), b.min(axis=0)) - 1.5 * r
    at_a, at_b = (np.floor((p - low) / width).astype(np.int64) for p in (a, b))
    span = np.maximum(at_a.max(axis=0), at_b.max(axis=0)) + 2
    strides = np.array([span[1] * span[2], span[2], 1])
    number = at_b @ strides
    order = np.argsort(number, kind="stable")
    number = number[order]
    for lo in range(0, len(a), CHUNK):
        rows = np.arange(lo, min(lo + CHUNK, len(a)))
        for step in itertools.product((-1, 0, 1), repeat=2):
            centre = (at_a[rows] + (*step, 0)) @ strides
            first = np.searchsorted(number, centre - 1, "left")
            n = np.searchsorted(number, centre + 1, "right") - first
            i = np.repeat(rows, n)
            j = order[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]
            d = np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1))
            yield i[d <= r], j[d <= r], d[d <= r]


def smaller_median(a: np.ndarray, b: np.ndarray, r: float) -> float:
    """The smaller of two medians, of nearest distances from a to b and from b to a.

    Distances beyond ``r`` are unknown; ``r`` doubles until they can't matter.
    """
    while True:
        near = np.full(len(a), np.inf), np.full(len(b), np.inf)
        for i, j, d in meetings(a, b, r):
            np.minimum.at(near[0], i, d)
            np.minimum.at(near[1], j, d)
        if (known := min(map(np.median, near))) <= min(np.median(np.minimum(x, r)) for x in near):
            return float(known)
        r *= 2


@dataclass
class Track:
    born: tuple[int, str]
    t_s: float
    frame: int
    frames: int
    support: np.ndarray


class TrackBook:
    """Live tracks of one session or island."""

    def __init__(self, cfg: dict | None = None):
        self.cfg, self.tracks, self.given = {**TRACK, **(cfg or {})}, {}, 0

    def _partners(self, points: np.ndarray, owner: np.ndarray, t_s: float) -> dict[int, int]:
        """Best track per component number: all voxels of the frame meet all live support at once."""
        g = self.cfg
        live = {i: t for i, t in self.tracks.items() if 0 <= t_s - t.t_s <= g["gap_s"]}
        if not live or not len(points):
            return {}
        names, sizes = list(live), np.array([len(t.support) for t in live.values()])
        support = np.concatenate([t.support for t in live.values()])
        track = np.repeat(np.arange(len(names)), sizes)
        i, j = (np.concatenate(x) for x in zip(*[(i, j) for i, j, _ in meetings(points, support, g["radius"])]))
        pair = owner[i] * len(names) + track[j]
        # Voxels of a side that a pair of component and track has met, each counted once.
        (pairs, n), (_, m) = (np.unique(np.unique(pair * len(of) + x) // len(of), return_counts=True) for of, x in ((points, i), (support, j)))
        share = np.maximum(n / np.bincount(owner)[pairs // len(names)], m / sizes[pairs % len(names)])
        best: dict[int, tuple[float, int]] = {}
        for k, tid, part in zip(pairs // len(names), pairs % len(names), share):
            if part >= g["fraction"]:
                score = smaller_median(points[owner == k], live[names[tid]].support, g["radius"]) + (1 - part) * 0.1
                best[int(k)] = min(best.get(int(k), (np.inf, names[tid])), (score, names[tid]))
        return {k: tid for k, (_, tid) in best.items()}

    def _grown(self, support: np.ndarray, voxels: np.ndarray) -> np.ndarray:
        """Means per cell of the support and the new voxels; beyond the cap an even sample in the order of the cells."""
        rows = np.concatenate([support, voxels])
        cells = np.floor(rows / self.cfg["voxel"]).astype(np.int64)
        order = np.lexsort(cells.T[::-1])
        cells = cells[order]
        first = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(axis=1))) if len(cells) else np.zeros(0, int)
        means = np.add.reduceat(rows[order], first, axis=0) / np.diff(first, append=len(rows))[:, None] if len(rows) else rows
        n, cap = len(means), self.cfg["cap"]
        return means if n <= cap else means[np.arange(cap) * (n - 1) // (cap - 1)]

    def observe(self, frame: int, t_s: float, components: dict[str, np.ndarray]) -> list[tuple]:
        """(frame, component, track, confirmed) of a frame's components; several may share a track, tracks are never merged."""
        owner = np.repeat(np.arange(len(components)), [len(v) for v in components.values()])
        partner = self._partners(np.concatenate(list(components.values())), owner, t_s) if components else {}
        out = []
        for k, (name, voxels) in enumerate(components.items()):
            if k in partner:
                tid = int(partner[k])
                t = self.tracks[tid]
                t.frames, t.frame, t.t_s, t.support = t.frames + (frame != t.frame), frame, t_s, self._grown(t.support, voxels)
            else:
                self.given = tid = self.given + 1
                t = self.tracks[tid] = Track((frame, name), t_s, frame, 1, self._grown(voxels[:0], voxels))
            out.append((frame, name, tid, t.frames >= self.cfg["confirm"]))
        return out

    def forget(self, t_s: float) -> None:
        """Drop the tracks that can no longer match."""
        self.tracks = {i: t for i, t in self.tracks.items() if t_s - t.t_s <= self.cfg["gap_s"]}


def _components(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    names, xyz = rows["component"].to_numpy(), rows[["x", "y", "z"]].to_numpy()
    named = np.flatnonzero(pd.notna(names))
    order = named[np.argsort(names[named], kind="stable")]
    first = [n for n in range(len(order)) if not n or names[order[n]] != names[order[n - 1]]]
    return {names[order[lo]]: xyz[order[lo:hi]] for lo, hi in zip(first, [*first[1:], len(order)])}


def _frames_in_order(pdfs, keys: list[str]):
    """(key, rows) of whole frames from sorted batches; only the open frame is carried on."""
    held = None
    for pdf in pdfs:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if len(held):
            still = (held[keys] == held[keys].iloc[-1]).all(axis=1)
            yield from held[~still].groupby(keys, sort=False)
            held = held[still]
    if held is not None and len(held):
        yield from held.groupby(keys, sort=False)


def _followed(cfg: dict | None):
    cols = [*SESSION, "frame", "component", "born_frame", "born_component", "confirmed"]

    def run(pdfs):
        place, book, out = None, None, []
        for (*here, frame), rows in _frames_in_order(pdfs, [*SESSION, "island", "era", "frame"]):
            if here != place:
                place, book = here, TrackBook(cfg)
            t_s = float(rows["t_s"].iloc[0])
            for _, name, tid, sure in book.observe(int(frame), t_s, _components(rows)):
                out.append((*here[:2], frame, name, *book.tracks[tid].born, sure))
            book.forget(t_s)
            if len(out) >= ROWS_OUT:
                yield pd.DataFrame(out, columns=cols)
                out = []
        yield pd.DataFrame(out, columns=cols)

    return run


def islands_of(voxels: DataFrame, reach: float) -> DataFrame:
    """The island of each component: components of a session whose chain of cells of width ``reach`` touches, whatever their frames."""
    part = [*SESSION, "frame", "component"]
    node = F.xxhash64(*SESSION, *CELL)
    cells = voxels.select(*part, *cell_of(vec(""), reach)).distinct()
    taken = cut(cells.select(*SESSION, *CELL).distinct(), "cells")
    beside = explode_neighbours(taken.withColumn("a_id", node), 1).join(taken, [*SESSION, *CELL]).select("a_id", node.alias("b_id"))
    home = cells.groupBy(*part).agg(F.min(node).alias("home"))
    inside = cells.join(home, part).select(node.alias("a_id"), c("home").alias("b_id"))
    found = connected_components(taken.select(node.alias("id")), beside.unionByName(inside)).select(c("id").alias("home"), c("component").alias("island"))
    return home.join(found.distinct(), "home").select(*part, "island")


def with_eras(placed: DataFrame, gap_s: float) -> DataFrame:
    """Adds ``era``, which counts up where an island's next frame comes more than ``gap_s`` after all its earlier ones."""
    island = [*SESSION, "island"]
    seen = placed.groupBy(*island, "frame").agg(F.min("t_s").alias("t_s"))
    seen = blocked_scan(seen, island, "frame", {"__top": ("max", c("t_s"))})
    seen = blocked_scan(seen, island, "frame", {"__before": ("lag", c("__top"))})
    seen = islands(seen, island, "frame", F.coalesce(c("t_s") - c("__before") > gap_s, F.lit(False)), "era")
    return placed.join(seen.select(*island, "frame", "era"), [*island, "frame"])


def track_batch(voxels: DataFrame, cfg: dict | None = None) -> DataFrame:
    """Tracks of whole sessions. ``voxels``: run, generation, frame, t_s, component, x, y, z (world).

    Support is a mean within a voxel, so a component can only meet a track
    when some of their voxels are closer than the radius and a voxel's
    diagonal. Ids count a session's new tracks by frame and component.
    """
    g = {**TRACK, **(cfg or {})}
    rows = cut(voxels.select(*VOXELS), "voxels")
    placed = rows.join(islands_of(rows, (g["radius"] + math.sqrt(3) * g["voxel"]) * PAD), [*SESSION, "frame", "component"])
    placed = with_eras(placed, g["gap_s"])
    # A number given here isn't coalesced: a few bytes of an era are much work.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_TASK))
    dealt = placed.repartition(tasks, *SESSION, "island", "era").sortWithinPartitions(*SESSION, "island", "era", "frame", "component")
    out = "run int, generation int, frame int, component string, born_frame int, born_component string, confirmed boolean"
    told = cut(dealt.mapInPandas(_followed(cfg), out), "tracks")
    new = told.where((c("frame") == c("born_frame")) & (c("component") == c("born_component"))).select(*SESSION, "born_frame", "born_component")
    place = F.row_number().over(Window.partitionBy(*SESSION, "born_frame").orderBy("born_component"))
    upto = blocked_scan(new.groupBy(*SESSION, "born_frame").agg(F.count(F.lit(1)).alias("n")), SESSION, "born_frame", {"upto": ("sum", c("n"))})
    ids = new.withColumn("place", place).join(upto, [*SESSION, "born_frame"]).withColumn("track", c("upto") - c("n") + c("place"))
    named = told.join(ids, [*SESSION, "born_frame", "born_component"])
    return named.select(*SESSION, "frame", "component", "track", "confirmed")


def stream_track(stream: DataFrame, cfg: dict | None = None) -> DataFrame:
    """The same association as frames arrive; a frame's components arrive together. The state of a session is its live tracks."""
    state_schema = "given long, tid array<long>, born array<int>, name array<string>, t_s array<double>, frame array<int>, frames array<int>, support array<binary>"

    def step(key, pdfs, state):
        book = TrackBook(cfg)
        if state.exists:
            book.given, *lists = state.get
            for tid, born, name, t_s, frame, frames, blob in zip(*lists, strict=True):
                book.tracks[int(tid)] = Track((born, name), t_s, frame, frames, np.frombuffer(bytes(blob)).reshape(-1, 3))
        rows = []
        for frame, part in pd.concat(list(pdfs), ignore_index=True).groupby("frame", sort=True):
            t_s = float(part["t_s"].iloc[0])
            rows += [(*key, *r) for r in book.observe(int(frame), t_s, _components(part))]
            book.forget(t_s)
        held = [(int(i), int(t.born[0]), t.born[1], float(t.t_s), int(t.frame), int(t.frames), np.ascontiguousarray(t.support).tobytes()) for i, t in book.tracks.items()]
        state.update((int(book.given), *([list(x) for x in zip(*held, strict=True)] or [[] for _ in range(7)])))
        yield pd.DataFrame(rows, columns=["run", "generation", "frame", "component", "track", "confirmed"])

    return stream.select(*VOXELS).groupBy(*SESSION).applyInPandasWithState(step, TRACK_OUT, state_schema, "append", GroupStateTimeout.NoTimeout)
