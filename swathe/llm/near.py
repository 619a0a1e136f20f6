"""Similarity join of documents by the Jaccard coefficient of their word shingles.

Candidates come from an LSH forest: every signature is cut into labels, one
per trie, and documents that share a label's prefix meet. The prefixes start
long and are shortened until the links found so far say that the recall is
reached. The candidates only decide which documents are compared: every link
is verified on the whole shingle sets.

Groups of any size stay whole. Texts with equal words are one node; a trie
node or cluster beyond ``BLOCK`` members is compared block by block; only stars
and counts leave a task, never the pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import connected_components
from ..session import cut
from .batches import bounds, by_group
from .words import U, column_bytes, mix, shingle_hashes, text_slices, word_hashes

TRIES, OWN, HASHES = 16, 4, 64
LEVELS = (4, 3, 2)
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Below this share of equal signature values a pair isn't followed. A pair at 0.8 falls below it with a chance under 1e-10.
AGREE = 29
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.int64).astype(U) | U(1)
SHIFTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.int64).astype(U)
c = F.col


def signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``HASHES`` minima per text with shingles."""
    has = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(has), HASHES), np.uint32)
    if len(has):
        for j in range(HASHES):
            out[:, j] = np.minimum.reduceat(((shingles * FACTORS[j] + SHIFTS[j]) >> U(32)).astype(np.uint32), offsets[has])
    return out


def _signed(k: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                words, at = word_hashes(*column_bytes(part.column("text")))
                shingles, offsets = shingle_hashes(words, at, k)
                n = np.diff(at)
                has = np.flatnonzero(n)
                if not len(has):
                    continue
                order = np.arange(len(words), dtype=np.int64) - np.repeat(at[:-1], n)
                one = np.add.reduceat(mix(words + mix(order.astype(U))), at[has])
                two = np.add.reduceat(mix((words ^ U(0x5851F42D4C957F2D)) + mix(~order.astype(U))), at[has])
                sig = signatures(shingles, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(has)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary())],
                    ["doc_id", "d1", "d2", "sig"],
                )

    return run


def recall(similarity, depth: int, tries: int = TRIES):
    """Chance that a pair shares at least one prefix of that depth; a number or a column."""
    return 1 - (1 - similarity**depth) ** tries


def _agreeing(sig: np.ndarray, n: int, i: int, rest: np.ndarray) -> np.ndarray:
    return (sig[rest] == sig[i]).sum(axis=1)


def _stars(table: pa.Table) -> pa.RecordBatch:
    """Links of every member to the one it was reached from, within each trie node.

    Each member that is reached looks at all that aren't yet, so two members
    alike enough always end in one tree, and a group of near copies needs one
    look. In a pair of blocks only looks across count when the blocks differ.
    """
    keys, ids = table.column("node").to_numpy(), table.column("id").to_numpy()
    b, _ = column_bytes(table.column("sig").combine_chunks())
    sig = b.view(np.uint32).reshape(len(ids), HASHES)
    a, z, same = [], [], []
    ends = bounds(keys)
    size = np.diff(ends)
    two = ends[:-1][size == 2]  # most nodes are pairs
    agree = (sig[two] == sig[two + 1]).sum(axis=1)
    ok = agree >= AGREE
    a.append(ids[two[ok]]), z.append(ids[two[ok] + 1]), same.append(agree[ok])
    for lo, hi in zip(ends[:-1][size > 2], ends[1:][size > 2], strict=True):
        left = np.arange(lo, hi)
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                i = queue.pop()
                agree = (sig[left] == sig[i]).sum(axis=1)
                ok = agree >= AGREE
                if ok.any():
                    a.append(np.full(int(ok.sum()), ids[i])), z.append(ids[left[ok]]), same.append(agree[ok])
                    queue += list(left[ok])
                    left = left[~ok]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(cat(a).astype(np.int64)), pa.array(cat(z).astype(np.int64)), pa.array(cat(same).astype(np.int64))], ["a", "b", "agree"])


def _blocked(rows: DataFrame, key: str, id_: str, blocks) -> DataFrame:
    """Rows with a column ``node``: the key itself, or one value for each pair of blocks that the row's block takes part in.

    ``blocks``: how many blocks the key's rows are dealt into, a column.
    """
    own = F.pmod(F.xxhash64(id_, F.lit(7)), c("blocks"))
    other = F.explode(F.when(c("blocks") <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), c("blocks") - 1)))
    dealt = rows.withColumn("blocks", blocks.cast("long")).withColumn("own", own).withColumn("other", other)
    return dealt.withColumn("node", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).withColumn("across", c("own") != c("other")).drop("other")


def _candidates(reps: DataFrame, depth: int) -> DataFrame:
    """Stars (a, b, agree) over documents that share a prefix of that depth in some trie."""
    piece = lambda t: F.xxhash64(F.lit(t), *[F.substring("sig", 4 * ((OWN * t + j) % HASHES) + 1, 4) for j in range(depth)])
    at = reps.select("id", F.explode(F.array(*[piece(t) for t in range(TRIES)])).alias("prefix"))
    full = at.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = at.join(full, "prefix").join(reps.select("id", "sig"), "id")
    return by_group(_blocked(met, "prefix", "id", F.ceil(c("n") / BLOCK)).select("node", "id", "sig"), "node", _stars, "a long, b long, agree long")


def _forest(reps: DataFrame, threshold: float, target: float) -> DataFrame:
    """Candidate stars at the first depth whose estimated recall reaches the target.

    The estimate weighs each distinct star link of at least the threshold by
    the chance that its depth finds it.
    """
    for depth in LEVELS:
        stars = cut(_candidates(reps, depth).groupBy("a", "b").agg(F.max("agree").alias("agree")), "stars")
        s = F.greatest(c("agree") / HASHES, F.lit(threshold))
        seen = stars.where(c("agree") >= threshold * HASHES).agg(F.count(F.lit(1)).alias("n"), F.sum(1 / recall(s, depth)).alias("all")).first()
        if not seen["n"] or seen["n"] / seen["all"] >= target:
            break
    return stars


def _shingled(k: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                shingles, offsets = shingle_hashes(*word_hashes(*column_bytes(part.column("text"))), k)
                sets = [np.unique(shingles[lo:hi]).tobytes() for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("cluster"), part.column("copies"), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["id", "cluster", "copies", "shingles"])

    return run


def _verified(threshold: float):
    def work(table: pa.Table) -> pa.RecordBatch:
        """Per member: the number of documents it is linked to, and a member of its class."""
        keys, ids, copies, own, across = (table.column(x).to_numpy() for x in ("node", "id", "copies", "own", "across"))
        b, at = column_bytes(table.column("shingles").combine_chunks())
        values, at = b.view(U), at // 8
        root, links = ids.copy(), np.zeros(len(ids), np.int64)
        ends = bounds(keys)
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            if hi - lo < 2:
                continue
            order = np.argsort(at[lo + 1 : hi + 1] - at[lo:hi], kind="stable") + lo
            parts = [values[at[i] : at[i + 1]] for i in order]
            _, code = np.unique(np.concatenate(parts), return_inverse=True)
            size = np.array([len(p) for p in parts])
            start = np.concatenate([[0], np.cumsum(size)])
            mark = np.zeros(int(code.max()) + 1, np.int32)
            parent = np.arange(hi - lo)
            half = across[lo]
            for i in range(hi - lo - 1):
                last = int(np.searchsorted(size, size[i] / threshold + 1e-9, "right"))
                if last <= i + 1:
                    continue
                mark[code[start[i] : start[i + 1]]] = 1
                shared = np.add.reduceat(mark[code[start[i + 1] : start[last]]], start[i + 1 : last] - start[i + 1])
                mark[code[start[i] : start[i + 1]]] = 0
                hit = np.flatnonzero(shared >= threshold * (size[i] + size[i + 1 : last] - shared) - 1e-9) + i + 1
                if half:
                    hit = hit[own[order[hit]] != own[order[i]]]
                if len(hit):
                    links[order[i]] += copies[order[hit]].sum()
                    links[order[hit]] += copies[order[i]]
                    parts_of = np.unique(parent[np.append(hit, i)])
                    parent[np.isin(parent, parts_of)] = parts_of[0]
            root[order] = ids[order[parent]]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root), pa.array(links)], ["id", "root", "links"])

    return work


def jaccard_classes(docs: DataFrame, k: int = 5, threshold: float = 0.8, target: float = 0.9999) -> DataFrame:
    """Classes of documents linked by a Jaccard coefficient of at least ``threshold``.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored.
    Returns one row per row of ``docs``: ``doc_id``; ``class_id``, the least
    doc_id of the class; ``rep_id``, the least doc_id with the same words;
    ``copies``, how many rows have these words; ``links``, how many rows with
    other words are linked to this one. Shingles are runs of ``k`` words; a text of
    fewer words has one shingle of all of them. Texts without words (null,
    empty, punctuation only) and rows without a doc_id are never linked; the
    latter have no class. Repeated rows count as copies.
    """
    spark = docs.sparkSession
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(rows.where("doc_id is not null").mapInArrow(_signed(k), "doc_id long, d1 long, d2 long, sig binary"), "signed")
    nodes = signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    nodes = cut(nodes, "nodes")
    sigs = signed.join(nodes.select("d1", "d2", "id"), ["d1", "d2"]).where("doc_id = id").groupBy("id").agg(F.min("sig").alias("sig"))
    reps = cut(sigs, "reps")
    stars = _forest(reps, threshold, target)
    touched = stars.select(c("a").alias("id")).union(stars.select("b")).distinct()
    clusters = connected_components(touched, stars, "a", "b").withColumnRenamed("component", "cluster")
    members = clusters.join(nodes.groupBy("id").agg(F.max("copies").alias("copies")), "id")
    texts = rows.join(members.select(c("id").alias("doc_id"), "id", "cluster", "copies"), "doc_id")
    sets = texts.mapInArrow(_shingled(k), "id long, cluster long, copies long, shingles binary")
    sets = cut(sets.groupBy("id").agg(F.min("cluster").alias("cluster"), F.max("copies").alias("copies"), F.min("shingles").alias("shingles")), "sets")
    sizes = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    blocks = F.greatest(F.ceil(c("n") / BLOCK), F.ceil(c("bytes") / BLOCK_BYTES))
    dealt = _blocked(sets.join(sizes, "cluster"), "cluster", "id", blocks)
    checked = cut(by_group(dealt.select("node", "id", "copies", "own", "across", "shingles"), "node", _verified(threshold), "id long, root long, links long", 512), "checked")
    found = connected_components(checked.select("id").distinct(), checked, "id", "root").withColumnRenamed("component", "class_id")
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    told = nodes.join(found, "id", "left").join(links, "id", "left").select("d1", "d2", c("id").alias("rep_id"), F.coalesce("class_id", "id").alias("class_id"), "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    linked = signed.select("doc_id", "d1", "d2").join(told, ["d1", "d2"]).select("doc_id", "class_id", "rep_id", "copies", "links")
    alone = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(c("doc_id").isNull() | ~c("text").rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"))
    return linked.unionByName(alone.select("doc_id", c("doc_id").alias("class_id"), c("doc_id").alias("rep_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links")))


def keep_one_per_class(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, that of the least doc_id; rows without a doc_id or words all stay.

    Of repeated rows with one doc_id all but one go.
    """
    classes = jaccard_classes(docs, **options)
    kept = classes.where("doc_id = class_id").groupBy(c("doc_id").alias("kept_id")).agg(F.max("copies").alias("_copies"))
    firsts = docs.join(kept, docs["doc_id"].cast("long") == c("kept_id"))
    w = Window.partitionBy("kept_id").orderBy("text")
    once = firsts.where("_copies = 1").select(docs.columns)
    rest = firsts.where("_copies > 1").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(docs.columns)
    return once.unionByName(rest).unionByName(docs.where("doc_id is null"))
