"""Words and word shingles of whole texts as NumPy arrays of hashes.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters, with A-Z in lower case. Everything works on the UTF-8 bytes of an
Arrow column, slice by slice, so the memory needed besides the hashes is that
of one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U = np.uint64

_byte = np.arange(256)
IS_WORD = (_byte >= 128) | ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122))
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=U)
    p[0] = 1
    return np.cumprod(p, dtype=U)


POWERS, INVERSES = _powers(BASE, SLICE + 4096), _powers(INVERSE, SLICE + 4096)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def _slices(b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts the bytes behind bytes that belong to no word; a word longer than a slice makes it longer."""
    lo = 0
    while lo < len(b):
        hi = min(lo + SLICE, len(b))
        while hi < len(b) and IS_WORD[b[hi - 1]]:
            hi += 1
        yield lo, hi
        lo = hi


def word_hashes(b: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash of every word, offsets of the texts in it), then one array of hashes for each prefix length in bytes."""
    short: list[list[np.ndarray]] = [[np.zeros(0, U)] for _ in prefixes]
    hashes, starts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    heads = np.zeros(len(b) + 1, bool)
    heads[offsets] = True
    for lo, hi in _slices(b):
        part = b[lo:hi]
        inside, cut = IS_WORD[part], heads[lo:hi]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        first = np.flatnonzero(inside & (cut | ~before))
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:] & ~cut[1:]
        last = np.flatnonzero(inside & ~after) + 1
        up, down = (POWERS, INVERSES) if len(part) <= len(POWERS) else (_powers(BASE, len(part)), _powers(INVERSE, len(part)))
        total = np.zeros(len(part) + 1, U)
        np.cumsum(LOWER[part].astype(U) * up[: len(part)], out=total[1:])
        hashes.append(mix((total[last] - total[first]) * down[first]))
        for k, some in zip(prefixes, short, strict=True):
            some.append(mix((total[np.minimum(last, first + k)] - total[first]) * down[first] + U(k)))
        starts.append(first + lo)
    h, s = np.concatenate(hashes), np.concatenate(starts)
    return h, np.searchsorted(s, offsets), *map(np.concatenate, short)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words, offsets of the texts in it), repeats included.

    A text of one to k - 1 words has one shingle of all its words, a text
    without words none.
    """
    counts = np.diff(offsets)
    n = np.maximum(counts - k + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], n)
    end = np.repeat(offsets[1:], n)
    h = np.zeros(len(at), U)
    for i in range(k):
        inside = at + i < end
        nxt = words[np.minimum(at + i, len(words) - 1)] if len(words) else h
        h = np.where(inside, h * U(0xD6E8FEB86659FD93) + nxt + U(i + 1), h)
    return mix(h), out


def text_slices(batch: pa.RecordBatch, column: str, size: int = 4 * SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``size`` bytes of text; a longer text stands alone."""
    _, offsets = column_bytes(batch.column(column))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
