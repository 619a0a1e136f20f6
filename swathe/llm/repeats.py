"""Removal of byte strings that occur earlier in the corpus.

Every string of ``length`` bytes belongs to the run of strings around it that
share a minimizer: the least hashed ``GRAM``-byte gram among those inside the
string. Equal strings have equal minimizers, so strings that occur twice meet
when the runs are dealt by that gram. Runs with equal bytes need no further
look: all but the first are repeats. The distinct runs of a gram are indexed
together: a suffix array of them, its Burrows-Wheeler transform, and the
longest common prefixes by breadth-first backward extension, which
stops at ``length``. Rows of the suffix array that aren't separated by then
start with the same string, of which all but the earliest go.

Grams with very many distinct runs are cut into single strings, which are
counted by Spark's own aggregation, so no task gathers them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .batches import bounds, by_group
from .words import U, column_bytes, mix, text_slices

GRAM = 24
SLICE = 1 << 20
#: Distinct runs of one gram that are indexed together; about 140 bytes each.
GROUP = 4096
INDEX_ROWS = 1024
_rng = np.random.default_rng(8)
TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
STEP = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
ROLL = 0x2545F4914F6CDD1D
UNROLL = pow(ROLL, -1, 1 << 64)
c = F.col


def _windowed(v: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over every window of that width, by doubling."""
    done, n = v, 1
    while 2 * n <= width:
        done, n = join(done[:-n], done[n:], n), 2 * n
    return join(done[: len(done) - (width - n)], done[width - n :], width - n) if n < width else done


def gram_hashes(b: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` bytes, a power of two."""
    return _windowed(TABLE[b], width, lambda x, y, n: x * U(STEP[n.bit_length() - 1]) + (y ^ (y >> U(29))))


def runs(b: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first start, number of starts, offset of the gram, gram hash, hash of the run's bytes, left, right) of every run.

    Starts count from the document's first byte; strings stay inside a
    document. Left and right are short hashes of the gram with half of the
    other bytes of a string before or behind it: a string shared by two runs covers
    one of these in both. A run that doesn't reach so far has a value of its own there.
    """
    out = []
    width = length - GRAM + 1
    half = -(-(length - GRAM) // 2)
    for lo in range(0, max(len(b) - length + 1, 0), SLICE):
        part = b[lo : lo + SLICE + length - 1]
        h = gram_hashes(part, GRAM)
        if len(h) < width:
            continue
        rank = ((h ^ (h >> U(31))) * U(STEP[0])) & ~U((1 << 22) - 1) | np.arange(len(h), dtype=U)
        at = (_windowed(rank, width, lambda x, y, n: np.minimum(x, y)) & U((1 << 22) - 1)).astype(np.int64)
        edge = np.zeros(len(at) + 1, np.int32)
        np.add.at(edge, np.clip(offsets[1:] - length + 1 - lo, 0, len(at)), 1)
        np.add.at(edge, np.clip(offsets[1:] - lo, 0, len(at)), -1)
        ok = np.cumsum(edge[:-1]) <= 0
        new = np.empty(len(at), bool)
        new[0], new[1:] = True, (at[1:] != at[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new & ok)
        stop = np.empty(len(at), bool)
        stop[-1], stop[:-1] = True, (at[1:] != at[:-1]) | ~ok[1:]
        last = np.flatnonzero(stop & ok)
        doc = np.searchsorted(offsets, first + lo, "right") - 1
        up = np.full(len(part), ROLL, U)
        up[0] = 1
        up = np.cumprod(up, dtype=U)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(TABLE[part] * up, out=total[1:])
        down = np.full(len(part), UNROLL, U)
        down[0] = 1
        down = np.cumprod(down, dtype=U)
        n = last - first + 1
        x = mix((total[last + length] - total[first]) * down[first] + n.astype(U))
        gram = at[first]
        sides = []
        for reached, i, j in ((first <= gram - half, gram - half, gram + GRAM), (last + length >= gram + GRAM + half, gram, gram + GRAM + half)):
            i, j = np.where(reached, i, first), np.where(reached, j, first)
            sides.append(np.where(reached, mix((total[j] - total[i]) * down[i]), x).astype(np.uint32).view(np.int32))
        out.append((doc, first + lo - offsets[doc], n, gram - first, h[gram].view(np.int64), x.view(np.int64), *sides))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 6 + (np.zeros(0, np.int32),) * 2


def _run_rows(length: int):
    """Runs of each text. One that equals an earlier run of the same batch is known as a repeat and goes to any task."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                row, first, n, gram, h, x, left, right = runs(*column_bytes(part.column("text")), length)
                doc, at = part.column("doc").to_numpy()[row], first << 16 | n << 8 | gram
                order = np.lexsort((at, doc, x, h))
                h, x, doc, at, left, right = (v[order] for v in (h, x, doc, at, left, right))
                head = np.ones(len(h), bool)
                head[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
                first_of = np.flatnonzero(head)[np.cumsum(head) - 1] if len(h) else np.zeros(0, np.int64)
                known = (doc != doc[first_of]) | (at != at[first_of])
                h = np.where(known, mix(doc.astype(U) ^ (at.astype(U) << U(20))).view(np.int64), h)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(x), pa.array(doc), pa.array(at), pa.array(left), pa.array(right), pa.array(known)], ["h", "x", "doc", "at", "l", "r", "known"])

    return run


def suffix_rows(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by prefix doubling, down to ``depth`` symbols at least; equal beyond that, by position.

    ``text`` ends with zeros, which no other symbol equals.
    """
    n = len(text)
    key = np.zeros(n, U)
    for i in range(8):
        key |= np.concatenate([text[i:], np.zeros(min(i, n), text.dtype)]).astype(U) << U(56 - 8 * i)
    known = 8
    while True:
        rows = np.argsort(key)
        k = key[rows]
        rank = np.empty(n, np.int64)
        rank[rows] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
        if known >= depth:
            return rows
        nxt = np.zeros(n, np.int64)
        nxt[: max(n - known, 0)] = rank[known:] + 1
        key = (rank.astype(U) << U(32)) | nxt.astype(U)
        known *= 2


def suffix_rows_wide(text: np.ndarray, depth: int) -> np.ndarray:
    """As ``suffix_rows`` for runs that hold all 256 byte values: symbols of 16 bits, four in the first key."""
    n = len(text)
    key = np.zeros(n, U)
    for i in range(4):
        key |= np.concatenate([text[i:], np.zeros(min(i, n), text.dtype)]).astype(U) << U(48 - 16 * i)
    known = 4
    while True:
        rows = np.argsort(key)
        if known >= depth:
            return rows
        k = key[rows]
        rank = np.empty(n, np.int64)
        rank[rows] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
        nxt = np.zeros(n, np.int64)
        nxt[: max(n - known, 0)] = rank[known:] + 1
        key = (rank.astype(U) << U(32)) | nxt.astype(U)
        known *= 2


def equal_prefixes(rows: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """True where a row of the suffix array has at least ``length`` symbols in common with the row before.

    Works on the Burrows-Wheeler transform alone. A pair of neighbouring equal
    symbols in it is carried by the backward step to neighbouring rows; these
    have one symbol more in common than the least value between the pair.
    Values are settled in increasing order: level v settles the pairs
    that a row of value v - 1 has come to separate. Pairs left at ``length``
    are equal strings.
    """
    n = len(rows)
    before = text[rows - 1]  # row 0's suffix starts the text: its symbol is the closing zero
    order = np.argsort(before, kind="stable")  # backward step: row order[i] goes to row i
    settled = np.zeros(n, bool)  # value below the level
    settled[0] = True
    symbol = before[order]
    settled[1:] = symbol[1:] != symbol[:-1]
    zero = symbol == 0
    settled |= zero
    row = np.flatnonzero(~settled)
    left, right = order[row - 1].astype(np.int32), order[row].astype(np.int32)
    for _ in range(1, length):
        separated = np.cumsum(settled, dtype=np.int32)
        hit = separated[right] != separated[left]
        if not hit.any():
            break
        settled[row[hit]] = True
        row, left, right = row[~hit], left[~hit], right[~hit]
    return ~settled


def _indexed(length: int):
    def work(table: pa.Table) -> pa.RecordBatch:
        """Starts that repeat an earlier string, as spans (document, first start, number of starts)."""
        doc, at = table.column("doc").to_numpy(), table.column("at").to_numpy()
        b, offsets = column_bytes(table.column("bytes").combine_chunks())
        first, n = at >> 16, (at >> 8) & 255
        size = np.diff(offsets)
        # One byte per symbol: 0 between the runs, the rest moved up where the text itself holds a zero.
        used = np.unique(b)
        code = np.zeros(256, np.int64)
        code[used] = np.arange(1, len(used) + 1)
        put = np.arange(len(b)) + np.repeat(np.arange(len(size)), size)
        text = np.zeros(len(b) + len(size), np.uint8 if len(used) < 256 else np.uint16)
        text[put] = code[b]
        rows = suffix_rows(text, length) if len(used) < 256 else suffix_rows_wide(text, length)
        same = equal_prefixes(rows, text, length)
        starts = np.concatenate([[0], np.cumsum(size + 1)])
        run = np.searchsorted(starts, rows, "right") - 1
        inside = rows - starts[run]
        ok = inside < n[run]
        group = np.cumsum(~same)
        # A row that is no start of a full string never equals one: its string would hold a closing zero.
        group, run, inside = group[ok], run[ok], inside[ok]
        order = np.lexsort((first[run] + inside, doc[run], group))
        group, run, inside = group[order], run[order], inside[order]
        head = np.ones(len(group), bool)
        head[1:] = group[1:] != group[:-1]
        earliest = np.flatnonzero(head)[np.cumsum(head) - 1] if len(group) else np.zeros(0, np.int64)
        place = first[run] + inside
        again = (doc[run] != doc[run[earliest]]) | (place != place[earliest])
        run, inside = run[again], inside[again]
        order = np.lexsort((inside, run))
        run, inside = run[order], inside[order]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (inside[1:] != inside[:-1] + 1)
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(run)))
        return pa.RecordBatch.from_arrays([pa.array(doc[run[heads]]), pa.array(first[run[heads]] + inside[heads]), pa.array(count)], ["doc", "start", "n"])

    return work


def _fetched(length: int, single: bool):
    """The bytes of the wanted runs, or of each string in them."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                b, offsets = column_bytes(part.column("text"))
                wanted = part.column("wanted")
                count = np.diff(wanted.offsets.to_numpy())
                item = wanted.flatten()
                h, at = item.field(0).to_numpy(), item.field(1).to_numpy()
                doc, base = np.repeat(part.column("doc").to_numpy(), count), np.repeat(offsets[:-1], count)
                end = np.repeat(offsets[1:], count)
                lo, n = base + (at >> 16), (at >> 8) & 255
                ok = lo + n + length - 1 <= end  # rows that share a doc_id may differ in their text
                h, at, doc, lo, n = h[ok], at[ok], doc[ok], lo[ok], n[ok]
                if single:
                    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    h, doc, lo, at = np.repeat(h, n), np.repeat(doc, n), np.repeat(lo, n) + each, (np.repeat(at >> 16, n) + each) << 16 | 1 << 8
                    n = np.ones(len(h), np.int64)
                data = b.tobytes()
                pieces = [data[i:j] for i, j in zip(lo.tolist(), (lo + n + length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(at), pa.array(pieces, pa.binary())], ["h", "doc", "at", "bytes"])

    return run


def repeat_starts(docs: DataFrame, length: int = 100) -> DataFrame:
    """Spans (doc, start, n): n consecutive starts, from byte ``start`` of the document, of strings that start earlier too."""
    texts = docs.select(c("doc_id").cast("long").alias("doc"), "text").where("doc is not null and octet_length(text) >= {n}".replace("{n}", str(length)))
    rows = texts.mapInArrow(_run_rows(length), "h long, x long, doc long, at long, l int, r int, known boolean")
    found = rows.selectExpr(
        "*",
        "first_value(struct(doc, at)) over (partition by h, x order by doc, at) as head",
        "min(x) over (partition by h) as low",
        "max(x) over (partition by h) as high",
    )
    first = c("head.doc").eqNullSafe(c("doc")) & c("head.at").eqNullSafe(c("at")) & ~c("known")
    found = found.select("h", "x", "doc", "at", "l", "r", first.alias("first"), (c("low") != c("high")).alias("several")).where("not first or several")
    apart = [f"{f}(x) over (partition by h, {side})" for side in ("l", "r") for f in ("min", "max")]
    found = found.selectExpr("h", "doc", "at", "first", f"several and ({apart[0]} <> {apart[1]} or {apart[2]} <> {apart[3]}) as several")
    found = cut(found.where("not first or several"), "runs")
    spans = found.where("not first").select("doc", F.expr("shiftright(at, 16)").alias("start"), F.expr("shiftright(at, 8) & 255").alias("n"))
    wanted = found.where("first and several").select("h", "doc", "at")
    crowded = wanted.groupBy("h").agg(F.count(F.lit(1)).alias("runs")).where(c("runs") > GROUP).select("h")

    def fetch(w: DataFrame, single: bool) -> DataFrame:
        per_doc = w.groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("wanted"))
        return texts.join(per_doc, "doc").select("doc", "text", "wanted").mapInArrow(_fetched(length, single), "h long, doc long, at long, bytes binary")

    crowd = wanted.join(crowded, "h").select("h", "doc", "at")
    if crowd.isEmpty():
        return spans.unionByName(by_group(fetch(wanted, False), "h", _indexed(length), "doc long, start long, n long", INDEX_ROWS))
    alone = cut(fetch(crowd, True).select("doc", F.expr("shiftright(at, 16)").alias("start"), "bytes"), "strings")
    heads = alone.groupBy("bytes").agg(F.min(F.struct("doc", "start")).alias("head"))
    later = alone.join(heads, "bytes").where("head.doc <> doc or head.start <> start").select("doc", "start", F.lit(1).cast("long").alias("n"))
    rest = fetch(wanted.join(crowded, "h", "left_anti"), False)
    return spans.unionByName(by_group(rest, "h", _indexed(length), "doc long, start long, n long", INDEX_ROWS)).unionByName(later)


def _cut_out(length: int, names: list[str], whole_characters: bool):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, names[0]):
                b, offsets = column_bytes(part.column(names[0]))
                spans = part.column("__spans")
                count = np.diff(spans.offsets.to_numpy())
                item = spans.flatten()
                start, n = item.field(0).to_numpy(), item.field(1).to_numpy()
                edge = np.zeros(len(b) + 1, np.int32)
                lo = np.repeat(offsets[:-1], count) + start
                end = np.repeat(offsets[1:], count)
                np.add.at(edge, np.minimum(lo, end), 1)
                np.add.at(edge, np.minimum(lo + n + length - 1, end), -1)
                gone = np.cumsum(edge[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = offsets[:-1][offsets[:-1] < len(b)]
                begins[inner] = gone[inner]
                totals = [np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, begins)]
                at = offsets - totals[0]
                if whole_characters:
                    begin = (b & 0xC0) != 0x80
                    begin[inner] = True
                    character = np.cumsum(begin) - 1
                    split = np.zeros(len(b) + 1, bool)
                    split[character[gone]] = True
                    out = gone | split[character]
                    at = offsets - np.concatenate([[0], np.cumsum(out)])[offsets]
                    kept = b[~out].tobytes()
                else:
                    kept = b[~gone].tobytes()
                pieces = [kept[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                arrays = [part.column(x) for x in part.schema.names if x != "__spans"]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(np.diff(offsets)), pa.array(np.diff(totals[0])), pa.array(np.diff(totals[1])), pa.array(pieces, pa.binary())],
                    [*(x for x in part.schema.names if x != "__spans"), "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def without_repeats(docs: DataFrame, length: int = 100, whole_characters: bool = False) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also starts earlier in the corpus.

    Earlier is a smaller doc_id, or a smaller start in the same document.
    Strings never cross documents and are judged on the input. ``docs`` has
    ``doc_id`` (long) and ``text``; other columns pass through. Returns the
    columns of ``docs`` and, replacing any of the same name, ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (the
    remaining bytes; with ``whole_characters`` without what a cut leaves of a
    split character). Null texts are empty; rows without a doc_id are not
    compared and stay whole; repeated rows with one doc_id are one document and come out alike.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept"]
    names = [x for x in docs.columns if x not in made]
    per_doc = repeat_starts(docs, length).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("__spans")).withColumnRenamed("doc", "__doc")
    none = F.array().cast("array<struct<start:bigint,n:bigint>>")
    joined = docs.select(names).join(per_doc, c("doc_id").cast("long") == c("__doc"), "left").select(*names, F.coalesce("__spans", none).alias("__spans"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema), "n_bytes long", "n_removed long", "n_spans long", "kept binary"])
    return joined.mapInArrow(_cut_out(length, ["text"], whole_characters), schema)


def kept_text(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with what ``without_repeats`` keeps of each ``text``, and its ``n_chars``; characters that a cut splits go whole."""
    own = {x: f"__own_{x}" for x in docs.columns if x in ("n_bytes", "n_removed", "n_spans", "kept")}
    removed = without_repeats(docs.withColumnsRenamed(own), length, whole_characters=True)
    text = F.when(c("n_removed") == 0, c("text")).otherwise(c("kept").cast("string"))
    changed = removed.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long"))
    return changed.select([c(own.get(x, x)).alias(x) for x in docs.columns])
