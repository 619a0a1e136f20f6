"""Sorted rows as whole groups in Arrow tables, for what runs inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(table, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; never of the first."""
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        x = table.column(k)
        new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy()
    return new


def whole(batches, keys: list[str], least: int):
    """Sorted rows as tables of whole groups, of ``least`` rows or more; a group is never cut."""
    held, rows, tail = [], 0, None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if not part.num_rows:
            continue
        new = changes(part, keys)
        new[0] = tail is not None and tail != [part.column(k)[0].as_py() for k in keys]
        tail = [part.column(k)[-1].as_py() for k in keys]
        ends = np.flatnonzero(new)
        if len(ends) and rows + ends[-1] >= least:
            yield pa.concat_tables([*held, part.slice(0, ends[-1])]).combine_chunks()
            part, held, rows = part.slice(ends[-1]), [], 0
        held.append(part)
        rows += part.num_rows
    if held:
        yield pa.concat_tables(held).combine_chunks()


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first .. first + n - 1 of all spans, one after the other."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def close(p: np.ndarray, group: np.ndarray, q: np.ndarray, of: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of p, row of q) of all pairs of one group that are at most ``far`` apart; ``group`` and ``of`` number the groups.

    Cells are numbered so that three neighbours along z are one range of the sorted numbers.
    """
    low = np.full((max(group.max(initial=0), of.max(initial=0)) + 1, 3), np.inf)
    np.minimum.at(low, of, q)
    low[~np.isfinite(low)] = 0.0
    at = q - low[of]
    most = float(at.max(initial=0.0))
    width = max(far * (1 + 1e-6), most / 2 ** 16)
    cell, own = (np.floor(x / width).astype(np.int64) for x in (at, np.clip(p - low[group], -4 * width, most + 4 * width)))
    span = cell.max(axis=0, initial=0) + 12
    strides, whole_span = np.array([span[1] * span[2], span[2], 1]), span[0] * span[1] * span[2]
    number = of * whole_span + (cell + 5) @ strides
    order = np.argsort(number, kind="stable")
    number = number[order]
    found = []
    for x in (-1, 0, 1):
        for y in (-1, 0, 1):
            centre = group * whole_span + (np.minimum(own, span - 7) + 5 + (x, y, 0)) @ strides
            first = np.searchsorted(number, centre - 1, "left")
            n = np.searchsorted(number, centre + 1, "right") - first
            i, j = np.repeat(np.arange(len(p)), n), order[spans(first, n)]
            d = p[i] - q[j]
            near = (of[j] == group[i]) & (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= far * far)
            found.append((i[near], j[near]))
    return tuple(np.concatenate(x) for x in zip(*found))


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's component under the links i, j: roots link to lower ones, then all rows to their roots."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
