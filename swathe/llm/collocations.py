"""Phrase collocations by relational mining of sorted occurrence relations.

The relation of length k holds, in the order of pieces and positions, the
phrase of k words that starts at each position. It is persisted chunk by chunk:
a row has the phrases of a few megabytes of text as numbers of the chunk's own list of
phrases, with -1 at the end of a piece. Counting groups the lists of all
chunks, dealt into buckets of phrases; phrases that are frequent enough are
semi-joined back to the chunks; what is left is merge-joined with itself at the
adjacent position, which gives the relation of length k + 1.

Only lists of distinct phrases are grouped, and each chunk has a phrase once,
so a very common phrase is no larger group than the number of chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, discard
from .batches import bounds, by_group
from .words import column_bytes, text_slices

CHUNK = 8 << 20
#: Distinct phrases of all chunks that a bucket holds, about; they take some 150 bytes each while they are counted.
BUCKET = 1 << 19
#: A phrase is named after its first place: 22 bits for the task, 14 for its chunk, 27 for the chunk's phrase.
TASK, PLACE = 14, 27
ENDS = b".,;:!?\n\x0b\x0c\r"
CODES = bytes.maketrans(ENDS + bytes(range(65, 91)), b"." * len(ENDS) + bytes(range(97, 123)))
LEVEL = "chunk long, items array<int>, bucket int, base int, a array<long>, b array<long>, n array<int>"
COUNTED = "chunk long, local array<int>, id array<long>, own array<int>, f array<long>, a array<long>, b array<long>"
c = F.col


class _Numbers(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _one(values: np.ndarray) -> pa.ListArray:
    return _lists(values, np.array([0, len(values)]))


def _words(size: int):
    """The relation of single words: one row per chunk of about ``size`` bytes and language."""
    from pyspark import TaskContext

    def run(batches):
        chunk = TaskContext.get().partitionId() << TASK
        top = chunk + (1 << TASK)
        for batch in batches:
            for part in text_slices(batch, "text", size):
                b, offsets = column_bytes(part.column("text"))
                data, lang = b.tobytes(), part.column("lang").to_pylist()
                for one in dict.fromkeys(lang):
                    texts = [data[offsets[i] : offsets[i + 1]] for i, x in enumerate(lang) if x == one]
                    tokens = b" . ".join(texts).translate(CODES).replace(b".", b" . ").split()
                    numbers = _Numbers({b".": 0})
                    items = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)) - 1
                    if len(numbers) == 1:
                        continue
                    if chunk == top or len(numbers) >> PLACE:
                        raise OverflowError("more chunks in a task, or phrases in a chunk, than names are made for")
                    n = np.bincount(items[items >= 0], minlength=len(numbers) - 1)
                    words = pa.array(list(numbers)[1:], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk]), pa.array([one]), _one(items), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), _one(n.astype(np.int64))],
                        ["chunk", "lang", "items", "words", "n"],
                    )
                    chunk += 1

    return run


def _named(local: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Name by the chunk's own number; -1 for phrases that aren't frequent."""
    out = np.full(size + 1, -1)
    out[local] = ids
    return out


def _extended(buckets: int, last: bool):
    """Merge-joins each chunk's frequent phrases with those at the next position; rows of kind bucket -1 hold the new relation, the others its phrases."""

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                chunk = batch.column("chunk")[row].as_py()
                items, local, ids = (np.asarray(batch.column(x)[row].values) for x in ("items", "local", "id"))
                order = np.argsort(local)
                local, ids = local[order], ids[order]
                rank = _named(local, np.arange(len(local)), int(items.max(initial=-1)) + 1)[items]
                both = np.flatnonzero((rank[:-1] >= 0) & (rank[1:] >= 0))
                pairs, inverse, n = np.unique(rank[both] * len(local) + rank[both + 1], return_inverse=True, return_counts=True)
                a, b = (ids[x] for x in np.divmod(pairs, max(len(local), 1)))
                bucket = (((a * 0x9E3779B1 + b) ^ (b >> 17)) * 0x2545F4914F6CDD1D >> 20) % buckets
                order = np.argsort(bucket, kind="stable")
                a, b, n, bucket = a[order], b[order], n[order].astype(np.int32), bucket[order]
                if len(pairs) >> PLACE:
                    raise OverflowError("more phrases in a chunk than names are made for")
                if not last:
                    place = np.empty(len(pairs), np.int32)
                    place[order] = np.arange(len(pairs))
                    new = np.full(len(items), -1, np.int32)
                    new[both] = place[inverse]
                    new = new[(new >= 0) | (np.append(new[1:], -1) >= 0)]  # one gap says as much as many
                    none = _one(np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), _one(new), pa.array([-1], pa.int32()), pa.array([0], pa.int32()), none, none, _one(np.zeros(0, np.int32))], LEVEL.split(" ")[::2])
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(starts, len(bucket))
                empty = np.zeros(len(starts) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), chunk)), _lists(np.zeros(0, np.int32), empty), pa.array(bucket[starts].astype(np.int32)), pa.array(starts.astype(np.int32)), _lists(a, ends), _lists(b, ends), _lists(n, ends)],
                    LEVEL.split(" ")[::2],
                )

    return run


def _counted(least: int):
    """Of every chunk the phrases that occur ``least`` times or more in all chunks; each phrase's counts once, beside its first place."""

    def bucket(table: pa.Table) -> pa.RecordBatch:
        chunk, base = table.column("chunk").to_numpy(), table.column("base").to_numpy()
        a, b, n = (table.column(x).combine_chunks() for x in ("a", "b", "n"))
        size = np.diff(np.asarray(a.offsets))
        a, b, n = (np.asarray(x.flatten()) for x in (a, b, n))
        row = np.repeat(np.arange(len(size)), size)
        local = base[row] + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        name = chunk[row] << PLACE | local
        order = np.lexsort((name, b, a))
        a, b, n, name = a[order], b[order], n[order], name[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, first, dtype=np.int64) if len(a) else first
        often = np.repeat(total >= least, np.diff(np.append(first, len(a))))
        f = np.repeat(total, np.diff(np.append(first, len(a))))[often]
        head = np.repeat(name[first], np.diff(np.append(first, len(a))))[often] if len(a) else name
        a, b, row, name, local = a[often], b[often], row[order][often], name[often], local[order][often]
        order = np.argsort(row, kind="stable")
        f, head, a, b, row, name, local = (x[order] for x in (f, head, a, b, row, name, local))
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        ends = np.append(starts, len(row))
        own = name == head
        owned = np.concatenate([[0], np.cumsum(own)])[ends]
        return pa.RecordBatch.from_arrays(
            [pa.array(chunk[row[starts]]), _lists(local.astype(np.int32), ends), _lists(head, ends), *(_lists(x[own], owned) for x in (local.astype(np.int32), f, a, b))],
            COUNTED.split(" ")[::2],
        )

    def work(table: pa.Table) -> pa.RecordBatch:
        ends = bounds(table.column("bucket").to_numpy())
        parts = [bucket(table.slice(lo, hi - lo)) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0] if any(map(len, parts)) else parts[0]

    return work


def _by_chunk(counted: DataFrame) -> DataFrame:
    joined = [F.flatten(F.collect_list(F.struct("local", "id")).getField(x)).alias(x) for x in ("local", "id")]
    return counted.groupBy("chunk").agg(*joined)


def _next_level(level: DataFrame, frequent: DataFrame, buckets: int, last: bool) -> DataFrame:
    return level.join(frequent, "chunk").select("chunk", "items", "local", "id").mapInArrow(_extended(buckets, last), LEVEL)


def phrase_counts(docs: DataFrame, longest: int, least: int) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of each length, and the number of words per lang.

    A phrase has ``id``, ``f``, ``lang``, ``phrase``, ``a`` and ``b`` (the ids of the
    phrases without its last and its first word), ``heads`` and ``tails`` (the
    counts of its first 1, 2, ... and last 1, 2, ... words).
    """
    rows = docs.select(F.coalesce(c("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    level = cut(rows.mapInArrow(_words(CHUNK), "chunk long, lang string, items array<int>, words array<string>, n array<long>"), "words")
    each = level.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "n")).alias("local", "w")).select("chunk", "lang", "local", c("w.words").alias("word"), c("w.n").alias("n"))
    same = Window.partitionBy("lang", "word")
    known = each.withColumn("f", F.sum("n").over(same)).withColumn("id", F.min(F.shiftleft("chunk", PLACE) + c("local")).over(same))
    known = cut(known.where(c("f") >= least).select("chunk", "lang", "local", "word", "f", "id"), "frequent")
    totals = level.select("lang", F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    totals = cut(totals, "totals")
    none = F.array().cast("array<long>")
    phrases = [cut(known.where(c("id") == F.shiftleft("chunk", PLACE) + c("local")).select("id", "f", "lang", c("word").alias("phrase"), none.alias("heads"), none.alias("tails")), "phrases")]
    listed = known.groupBy("chunk").agg(F.collect_list(F.struct("local", "id")).alias("x")).select("chunk", c("x.local").alias("local"), c("x.id").alias("id"))
    buckets = max(1, (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET)
    for k in range(2, longest + 1):
        new = cut(_next_level(level, listed, buckets, k == longest), "level")
        found = cut(by_group(new.where("bucket >= 0").select(c("bucket").cast("long").alias("bucket"), "chunk", "base", "a", "b", "n"), "bucket", _counted(least), COUNTED, 1), "counted")
        discard(level)
        level = new.where("bucket < 0").select("chunk", "items")
        level._written_to = new._written_to
        listed = _by_chunk(found)
        pairs = found.select(F.explode(F.arrays_zip("own", "f", "a", "b")).alias("p"), "chunk").select((F.shiftleft("chunk", PLACE) + c("p.own")).alias("id"), c("p.f").alias("f"), c("p.a").alias("a"), c("p.b").alias("b"))
        before = phrases[-1].select(c("id").alias("a"), "lang", c("phrase").alias("start"), F.array_append("heads", c("f")).alias("heads"))
        behind = phrases[-1].select(c("id").alias("b"), F.substring_index("phrase", " ", -1).alias("word"), F.array_append("tails", c("f")).alias("tails"))
        full = pairs.join(before, "a").join(behind, "b")
        phrases.append(cut(full.select("id", "f", "lang", F.concat_ws(" ", "start", "word").alias("phrase"), "a", "b", "heads", "tails"), "phrases"))
    return phrases, totals


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each lang by how firmly their parts belong together.

    ``docs`` has ``text`` and ``lang`` (null: ``und``); other columns are
    ignored and null texts are empty. A-Z are lowered; pieces end at
    ``.,;:!?`` and line breaks, words at spaces and tabs. Candidates occur
    ``least`` times or more; cut after k words, one has the score
    floor(10^6 a^2 / (l r)) of its count a and those of its parts, and the
    least cut counts (ties: smallest k). Candidates inside a longer one that
    occurs in ``share`` percent of their places or more are dropped. Returns
    ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of the
    lang) and ``score``, by score and a descending, then phrase by its bytes.
    Repeated rows count as often as they stand; no texts give no rows.

    A candidate inside a longer one is inside one with a single word more that is
    at least as frequent, so these are the only ones looked at.
    """
    phrases, totals = phrase_counts(docs, longest, least)
    kept = None
    for k in range(2, longest + 1):
        own = phrases[k - 1]
        if k < longest:
            longer = phrases[k]
            around = longer.select(c("a").alias("id"), c("f").alias("most")).unionByName(longer.select(c("b").alias("id"), c("f").alias("most"))).groupBy("id").agg(F.max("most").alias("most"))
            own = own.join(around, "id", "left").where("most is null or 100 * cast(most as decimal(19,0)) < {s} * cast(f as decimal(19,0))".replace("{s}", str(share)))
        score = "((1000000BD * cast({f} as decimal(19,0)) * cast({f} as decimal(19,0))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0))))"
        cuts = [f"named_struct('score', {score.format(f='f', l=f'heads[{j}]', r=f'tails[{k - 2 - j}]')}, 'k', {j}, 'l', heads[{j}], 'r', tails[{k - 2 - j}])" for j in range(k - 1)]
        best = F.expr(f"array_min(array({', '.join(cuts)}))")
        own = own.select("lang", "phrase", "id", c("f").alias("a"), best.alias("best")).select("lang", "phrase", "id", "a", c("best.l").alias("l"), c("best.r").alias("r"), c("best.score").alias("score"))
        kept = own if kept is None else kept.unionByName(own)
    order = [c("score").desc(), c("a").desc(), c("phrase")]
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(c("rank") <= top)
    best = first.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(c("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
