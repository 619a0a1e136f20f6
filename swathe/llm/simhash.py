"""Near duplicates by SimHash fingerprints in a Gray-order hierarchical index.

Fingerprints within ``radius`` bits agree on one of ``radius + 1`` blocks of
bits. Each block gives one table in which the fingerprints are rotated so that the
block stands first, and sorted by Gray rank, range-partitioned by
Spark. A page of consecutive rows of a table is indexed bottom-up: the bits
that consecutive entries share are factored out into an upper node, a masked
pattern, again and again. A search goes top-down for many fingerprints at
once, adds up the differences in the bits that each node adds to those above
it, and leaves a whole group as soon as the sum passes the radius, the leading
block differs, or all of the group is known to be in the same component.

A leading block that spans several pages is finished by pairs of pages whose
masked patterns are near enough; only pages, never rows, are paired beforehand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .batches import bounds, by_group
from .components import linked_components
from .words import LOWER, U, column_bytes, text_slices

BITS = 64
#: Fingerprints that one task indexes together.
PAGE = 1 << 16
FAN = 8
#: Words whose shingles are hashed at a time, and pairs of fingerprint and node that are held at a time.
WORDS, HELD = 1 << 16, 1 << 20
SEED = 42
IS_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
c = F.col


def _word_spans(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end) of every word, offsets of the texts in them."""
    inside = ~IS_SPACE[b]
    heads = np.zeros(len(b) + 1, bool)
    heads[offsets] = True
    before, after = np.zeros(len(b), bool), np.zeros(len(b), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:] & ~heads[1:-1]
    first = np.flatnonzero(inside & (heads[:-1] | ~before))
    return first, np.flatnonzero(inside & ~after) + 1, np.searchsorted(first, offsets)


def _shingle_values(b: np.ndarray, first: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """XXH64 of the words lo to hi - 1, joined by single spaces, for each pair of lo and hi."""
    base, last = int(lo[0]), int(hi.max())
    size = end[base:last] - first[base:last] + 1
    put = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(put[-1]) + np.repeat(first[base:last] - put[:-1], size)
    data = LOWER[b[np.minimum(at, len(b) - 1)]]
    data[put[1:] - 1] = 0x20
    data, one = data.tobytes(), xxhash.xxh64_intdigest
    return np.array([one(data[i:j], SEED) for i, j in zip(put[lo - base].tolist(), (put[hi - base] - 1).tolist(), strict=True)], U)


def fingerprints(b: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """SimHash of every text over its runs of k words."""
    first, end, at = _word_spans(b, offsets)
    n = np.diff(at)
    count = np.maximum(n - k + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    ones = np.zeros((len(n), BITS), np.int64)
    for s in range(0, int(ends[-1]), WORDS):
        index = np.arange(s, min(s + WORDS, int(ends[-1])))
        text = np.searchsorted(ends, index, "right") - 1
        lo = at[text] + index - ends[text]
        h = _shingle_values(b, first, end, lo, np.minimum(lo + k, at[text + 1]))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = bounds(text)[:-1]
        ones[text[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(U).ravel()


def _fingerprinted(k: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                fp = fingerprints(*column_bytes(part.column("text")), k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of each pattern in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        v = v ^ (v >> U(shift))
    return v


def _rotated(radius: int):
    width = -(-BITS // (radius + 1))

    def run(batches):
        for batch in batches:
            v = batch.column("fp").to_numpy().view(U)
            for t in range(radius + 1):
                s = U(t * width % BITS)
                r = (v << s) | (v >> (U(BITS) - s)) if s else v
                rank = gray_rank(r) ^ U(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(rank.view(np.int64)), pa.array(r.view(np.int64)), batch.column("rep")], ["t", "rank", "v", "rep"])

    return run


class _Index:
    """Masked patterns over runs of entries sorted by Gray rank; level 0 are the entries."""

    def __init__(self, v: np.ndarray):
        self.pattern, self.mask = [v], [np.full(len(v), ~U(0))]
        every, some = v, v
        while len(every) > FAN:
            at = np.arange(0, len(every), FAN)
            every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
            self.mask.append(~(every ^ some)), self.pattern.append(every)

    def spread(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level the component that all entries of a node are in, else -1."""
        low = high = labels
        out = [labels]
        for level in range(1, len(self.mask)):
            at = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        return out

    def near(self, query: np.ndarray, own: np.ndarray, after: np.ndarray, labels: list[np.ndarray], radius: int, head: np.uint64):
        """Pairs (query, entry) within the radius that may join two components; entries up to ``after`` are left out."""
        top = len(self.mask) - 1
        q = np.arange(len(query))
        work = [(top, np.repeat(q, len(self.mask[top])), np.tile(np.arange(len(self.mask[top])), len(q)), np.zeros(len(q) * len(self.mask[top]), np.uint8))]
        while work:
            level, q, node, sum_ = work.pop()
            if len(q) > HELD:
                half = len(q) // 2
                work += [(level, q[half:], node[half:], sum_[half:]), (level, q[:half], node[:half], sum_[:half])]
                continue
            odd = query[q] ^ self.pattern[level][node]
            new = self.mask[level][node]
            if level < top:
                new = new & ~self.mask[level + 1][node // FAN]
            odd &= new
            sum_ = sum_ + np.bitwise_count(odd)
            keep = (sum_ <= radius) & (odd & head == 0) & (labels[level][node] != own[q]) & ((node + 1) * FAN**level - 1 > after[q])
            q, node, sum_ = q[keep], node[keep], sum_[keep]
            if not level:
                yield q, node
                continue
            below = len(self.mask[level - 1])
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            real = child < below
            work.append((level - 1, np.repeat(q, FAN)[real], child[real], np.repeat(sum_, FAN)[real]))


def _united(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Every component gets the least label of those that the links join."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def page_components(v: np.ndarray, radius: int, head: np.uint64, split: int = 0) -> np.ndarray:
    """Label of each row: the first row that chains of links lead to.

    ``v`` is sorted by Gray rank. With ``split``, it holds two sorted runs, and
    only links between them count.
    """
    labels = np.arange(len(v))
    index = _Index(v[split:])
    first, size, end = 0, 64, split or len(v)
    levels = index.spread(labels[split:])
    while first < end:
        q = np.arange(first, min(first + size, end))
        changed = False
        after = np.full(len(q), -1) if split else q
        for i, j in index.near(v[q], labels[q], after, levels, radius, head):
            if len(i):
                _united(labels, q[i], j + split)
                changed = True
        if changed:
            levels = index.spread(labels[split:])
        first, size = first + size, min(2 * size, 4096)
    return labels


def _stars(labels: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = np.flatnonzero(labels != np.arange(len(labels)))
    return rep[own], rep[labels[own]]


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _paged(radius: int, head: np.uint64, size: int):
    """Links inside each page of consecutive rows; the rows of a page's first and last leading block follow, for other pages."""
    from pyspark import TaskContext

    def page(t: np.ndarray, v: np.ndarray, rep: np.ndarray, number: int):
        a, b = _stars(page_components(v, radius, head), rep)
        none = np.zeros(len(a), np.int64)
        yield _rows(page=np.full(len(a), -1), t=none.astype(np.int32), block=none, v=none, a=a, b=b)
        block = v & head
        edge = np.flatnonzero((block == block[0]) | (block == block[-1]))
        yield _rows(page=np.full(len(edge), number), t=t[edge], block=block[edge].view(np.int64), v=v[edge].view(np.int64), a=rep[edge], b=rep[edge])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        rows = 0

        def full(table: pa.Table, last: bool):
            nonlocal number
            t, v, rep = table.column("t").to_numpy(), table.column("v").to_numpy().view(U), table.column("rep").to_numpy()
            lo = 0
            while lo < len(t):
                hi = min(lo + size, int(np.searchsorted(t, t[lo], "right")))
                if hi == len(t) and hi - lo < size and not last:
                    break
                yield from page(t[lo:hi], v[lo:hi], rep[lo:hi], number)
                number, lo = number + 1, hi
            held[:] = table.slice(lo).to_batches()

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= size:
                yield from full(pa.Table.from_batches(held), False)
                rows = sum(map(len, held))
        if rows:
            yield from full(pa.Table.from_batches(held), True)

    return run


def _across(radius: int, head: np.uint64):
    def work(table: pa.Table) -> pa.RecordBatch:
        pair, side, v, rep = (table.column(x).to_numpy() for x in ("pair", "side", "v", "a"))
        v = v.view(U)
        out = []
        ends = bounds(pair)
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            order = np.lexsort((gray_rank(v[lo:hi]), side[lo:hi])) + lo
            split = int((side[lo:hi] == 0).sum())
            if 0 < split < hi - lo:
                out.append(_stars(page_components(v[order], radius, head, split), rep[order]))
        a, b = ([np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2)
        return _rows(a=a, b=b)

    return work


def _between(edges: DataFrame, radius: int, head: np.uint64) -> DataFrame:
    """Links between rows of different pages that share a leading block."""
    rows = edges.select("t", "block", "page", "v", "a")
    pages = rows.groupBy("t", "block", "page").agg(F.bit_and("v").alias("every"), F.bit_or("v").alias("some"))
    shared = pages.groupBy("t", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "block")
    pages = cut(pages.join(shared, ["t", "block"]), "nodes")
    other = pages.select("t", "block", *[c(x).alias(f"{x}_2") for x in ("page", "every", "some")])
    odd = F.expr("bit_count((every ^ every_2) & ~(every ^ some) & ~(every_2 ^ some_2))")
    pairs = pages.join(other, ["t", "block"]).where((c("page") < c("page_2")) & (odd <= radius))
    pairs = pairs.select("t", "block", "page", "page_2", F.xxhash64("t", "block", "page", "page_2").alias("pair"))
    sides = pairs.select("t", "block", "page", "pair", F.lit(0).alias("side")).unionByName(pairs.select("t", "block", c("page_2").alias("page"), "pair", F.lit(1).alias("side")))
    dealt = rows.join(sides, ["t", "block", "page"]).select("pair", "side", "v", "a")
    return by_group(dealt, "pair", _across(radius, head), "a long, b long", PAGE)


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """Fingerprint of every document and the component that links of at most ``radius`` differing bits make.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored.
    Words are runs of bytes other than space, tab and line breaks, with A-Z in
    lower case; shingles are runs of ``k`` words, joined by spaces and counted as often as
    they stand. A text of fewer words has one shingle of all of them; one
    without words (null and empty too) has the fingerprint 0 and is linked like
    any other. A bit is set if it is set in more than half of the XXH64 values
    (seed 42). Returns one row per row of ``docs``: ``doc_id``, ``fp`` (the
    64 bits as a long) and ``component_id``, the least doc_id reachable. Rows
    without a doc_id get a fingerprint but no component, and link nothing. Repeated rows and
    equal fingerprints are one entry of the index.
    """
    head = U((1 << BITS) - (1 << (BITS - -(-BITS // (radius + 1)))))
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprinted(k), "doc_id long, fp long")
    rows = cut(rows, "fingerprints")
    entries = cut(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "entries")
    tables = entries.mapInArrow(_rotated(radius), "t int, rank long, v long, rep long")
    ordered = tables.repartitionByRange("t", "rank").sortWithinPartitions("t", "rank").select("t", "v", "rep")
    paged = cut(ordered.mapInArrow(_paged(radius, head, PAGE), "page long, t int, block long, v long, a long, b long"), "pages")
    links = paged.where("page < 0").select("a", "b").unionByName(_between(paged.where("page >= 0"), radius, head))
    found = linked_components(links).withColumnRenamed("id", "rep")
    told = entries.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    known = rows.where("doc_id is not null").join(told, "fp").select("doc_id", "fp", "component_id")
    return known.unionByName(rows.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))
