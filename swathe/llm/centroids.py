"""Centroid clustering of integer vectors through dictionaries of subvectors.

Dimensions are taken in blocks. Equal subvectors of a block share a code, so a
vector is a short row of codes and nothing is lost. A round computes the exact
distance of every distinct subvector to every centroid once; a vector's
distances are sums of these partial distances, looked up by code, and the new
centroids follow from how often each code occurs in each cluster.

A block whose subvectors hardly repeat gains nothing from a dictionary: where
the dictionaries of all blocks would pass ``ENTRIES`` entries, the largest stay out and
their dimensions are kept as they are. The distances are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

WIDTH = 2
#: Entries of all dictionaries that tasks hold at once: a table of k distances of 8 bytes each.
ENTRIES = 1 << 18
#: Components stay below this after scaling, so that squared distances of 64 of them fit into a long.
REACH = 1 << 27
c = F.col


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _packed(q: np.ndarray) -> np.ndarray:
    """One long for each subvector of a block."""
    key = np.zeros(len(q), np.int64)
    for j in range(q.shape[1]):
        key = key << 28 | (q[:, j].astype(np.int64) + REACH)
    return key


def _unpacked(keys: np.ndarray, width: int) -> np.ndarray:
    return np.stack([((keys >> (28 * (width - 1 - j))) & ((1 << 28) - 1)) - REACH for j in range(width)], axis=1)


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and q, the scaled and floored components, of the vectors that take part."""
    x = c("embedding")
    fine = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    wide = F.exists(scaled, lambda e: (e >= REACH) | (e < -REACH))
    q = F.when(wide, F.raise_error(F.lit(f"a scaled component lies outside +-{REACH}"))).otherwise(scaled)
    return vectors.select("vec_id", "embedding").where(fine).select("vec_id", q.cast("array<int>").alias("q"))


def _distinct_subvectors(blocks: list[slice], dims: int):
    def run(batches):
        for batch in batches:
            q = _matrix(batch.column("q"), dims)
            for b, block in enumerate(blocks):
                keys = np.unique(_packed(q[:, block]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b, np.int32)), pa.array(keys)], ["block", "sub"])

    return run


def _dictionaries(q: DataFrame, blocks: list[slice], dims: int) -> dict[int, np.ndarray]:
    """Sorted distinct subvectors of each block that has a dictionary."""
    subs = cut(q.select("q").mapInArrow(_distinct_subvectors(blocks, dims), "block int, sub long").distinct(), "subvectors")
    sizes = sorted((r["count"], r["block"]) for r in subs.groupBy("block").count().collect())
    held, total = [], 0
    for n, b in sizes:
        total += n
        if total > ENTRIES:
            break
        held.append(b)
    if not held:
        return {}
    table = subs.where(c("block").isin(held)).toArrow()
    block, sub = table.column("block").to_numpy(), table.column("sub").to_numpy()
    return {b: np.sort(sub[block == b]) for b in sorted(held)}


def _coded(blocks: list[slice], dims: int, books):
    def run(batches):
        held = books.value
        plain = [j for b, block in enumerate(blocks) if b not in held for j in range(dims)[block]]
        for batch in batches:
            q = _matrix(batch.column("q"), dims)
            codes = np.empty((len(q), len(held)), np.int32)
            for i, (b, book) in enumerate(held.items()):
                codes[:, i] = np.searchsorted(book, _packed(q[:, blocks[b]]))
            rest = np.ascontiguousarray(q[:, plain])
            lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(q) + 1, np.int32), x.ravel()) for x in (codes, rest)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *lists], ["vec_id", "codes", "rest"])

    return run


def _partial(books: dict[int, np.ndarray], blocks: list[slice], centroids: np.ndarray) -> list[np.ndarray]:
    """Squared distances of every subvector of every dictionary to every centroid, once a round."""
    out = []
    for b, book in books.items():
        at = centroids[:, blocks[b]]
        sub = _unpacked(book, at.shape[1])
        out.append(((sub[:, None, :] - at[None, :, :]) ** 2).sum(axis=2))
    return out


def _nearest(codes: np.ndarray, rest: np.ndarray, tables: list[np.ndarray], far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance): the partial distances added up by code; the smaller number wins a tie."""
    total = np.zeros((len(codes), len(far)), np.int64)
    for i, table in enumerate(tables):
        total += table[codes[:, i]]
    for k in range(len(far) if rest.shape[1] else 0):
        total[:, k] += ((rest - far[k]) ** 2).sum(axis=1)
    label = total.argmin(axis=1)
    return label, total[np.arange(len(label)), label]


def _columns(batch: pa.RecordBatch, tables: list[np.ndarray], far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(batch.column("codes"), len(tables)), _matrix(batch.column("rest"), far.shape[1]).astype(np.int64)


def _summed(round_, books, blocks: list[slice], plain: list[int], k: int):
    """Sums of the components of each cluster, from the counts of codes: k x dims rows a task."""

    def run(batches):
        tables, far = round_.value
        counts = [np.zeros((k, len(t)), np.int64) for t in tables]
        others, n = np.zeros((k, len(plain)), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            codes, rest = _columns(batch, tables, far)
            label, _ = _nearest(codes, rest, tables, far)
            n += np.bincount(label, minlength=k)
            for i, count in enumerate(counts):
                count += np.bincount(label * count.shape[1] + codes[:, i], minlength=count.size).reshape(count.shape)
            for g in range(k if plain else 0):
                others[g] += rest[label == g].sum(axis=0)
        cluster, dim, total = [], [], []
        for i, (b, book) in enumerate(books.value.items()):
            own = list(range(1 << 16)[blocks[b]])
            sums = counts[i] @ _unpacked(book, len(own))
            cluster.append(np.repeat(np.arange(k), len(own))), dim.append(np.tile(own, k)), total.append(sums.ravel())
        cluster.append(np.repeat(np.arange(k), len(plain))), dim.append(np.tile(plain, k)), total.append(others.ravel())
        cluster.append(np.arange(k)), dim.append(np.full(k, -1)), total.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (cluster, dim, total)], ["cluster", "dim", "total"])

    return run


def _assigned(round_):
    def run(batches):
        tables, far = round_.value
        for batch in batches:
            label, distance = _nearest(*_columns(batch, tables, far), tables, far)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """Exact rounds of assignment and update over the floored vectors ``floor(scale * x)``.

    ``vectors`` has ``vec_id`` (long) and ``embedding`` (array of float or
    double); other columns are ignored. Vectors that are null, hold another
    number of components than ``dims`` or a null or non-finite one take no part and have no row. Repeated
    rows count as often as they stand. Centroids start as the ``k`` vectors of
    the least SHA-256 of ``1:<vec_id>`` (of one vec_id, the least vector first;
    rows without a vec_id are clustered but start none); with fewer vectors there are fewer.
    Every round assigns each vector to the nearest centroid, ties to the
    smaller number, and moves every centroid that has vectors to their floored mean. Returns ``vec_id``,
    ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid`` (array of longs) after a last assignment. A scaled component
    outside +-2^27 is an error, since distances would pass a long.

    A round reads the codes once and shuffles k x dims sums a task; only
    these sums and dictionaries of ``ENTRIES`` entries at most reach the driver.
    """
    spark = vectors.sparkSession
    blocks = [slice(i, min(i + WIDTH, dims)) for i in range(0, dims, WIDTH)]
    q = cut(quantised(vectors, dims, scale), "quantised")
    first = q.where("vec_id is not null").withColumn("o", F.sha2(F.concat(F.lit("1:"), c("vec_id").cast("string")), 256))
    start = [r["q"] for r in first.orderBy("o", "q").limit(k).collect()]
    k = len(start)
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not k:
        return spark.createDataFrame([], empty)
    held = _dictionaries(q, blocks, dims)
    plain = [j for b, block in enumerate(blocks) if b not in held for j in range(dims)[block]]
    books = spark.sparkContext.broadcast(held)
    coded = cut(q.select(c("vec_id").cast("long").alias("vec_id"), "q").mapInArrow(_coded(blocks, dims, books), "vec_id long, codes array<int>, rest array<int>"), "codes")
    centroids = np.array(start, np.int64)

    def shared():
        return spark.sparkContext.broadcast((_partial(held, blocks, centroids), centroids[:, plain]))

    for _ in range(rounds):
        sums = coded.select("codes", "rest").mapInArrow(_summed(shared(), books, blocks, plain, k), "cluster long, dim long, total long")
        got = {(r["cluster"], r["dim"]): int(r["total"]) for r in sums.groupBy("cluster", "dim").agg(F.sum(c("total").cast("decimal(38,0)")).alias("total")).collect()}
        for g in range(k):
            if n := got[g, -1]:
                centroids[g] = [got[g, j] // n for j in range(dims)]
    done = cut(coded.mapInArrow(_assigned(shared()), "vec_id long, cluster int, distance long"), "assigned")
    parts = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(c("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(g, parts.get(g), sum(parts.values()), centroids[g].tolist()) for g in range(k)]
    few = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return done.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
