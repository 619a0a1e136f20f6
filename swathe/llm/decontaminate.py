"""Benchmark items inside documents, by MinHash containment and exact shingles.

Documents are partitioned by size: one with n distinct shingles is in the
partition p with 2^(p-1) < n <= 2^p. Its sketch is a one-permutation MinHash
with ``DENSITY`` * 2^p bins: the least hash of every bin that isn't empty. The
number of bins follows the size, so a short item's hashes survive in a
long document's sketch (each with a chance of at least 1 - 1 / (2 * DENSITY)),
which a sketch of fixed size can't give. Items are sketched once for every
partition; equal minima make candidates, and shared shingles are then counted
on the words themselves.

Column expressions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

DENSITY_BITS = 4
PARTITIONS = 40
#: Items of fewer shingles are looked up in whole documents instead of sketches.
FEW = 4
#: Item hashes (16 bytes each) up to this many are sent to every executor; more are joined through a shuffle.
BROADCAST_ROWS = 500_000
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
c = F.col


WORDS = f"regexp_extract_all(lower(coalesce(text, '')), '{WORD}', 0)".replace("\\", "\\\\")


def _bound(made: str, name: str, used: str):
    """``used`` with ``name`` standing for ``made``, evaluated once however often it is used; a projected column may be inlined into lambdas."""
    return f"transform(array({made}), {name} -> {used})[0]"


def _runs(k: int, form: str) -> str:
    return f"CASE WHEN size(w) >= {k} THEN transform(sequence(1, size(w) - {k - 1}), i -> {form.format(f'slice(w, i, {k})')}) ELSE array() END"


def hashes(k: int):
    """Distinct hashes of the text's runs of k words, ascending."""
    return F.expr(_bound(WORDS, "w", f"sort_array(array_distinct(cast({_runs(k, 'xxhash64({})')} AS array<bigint>)))"))


def shingles(k: int):
    return F.expr(_bound(WORDS, "w", f"array_distinct(cast({_runs(k, "array_join({}, ' ')")} AS array<string>))"))


def _least_per_bin(sorted_hashes: str, bits: str) -> str:
    """Of ascending hashes those that open a bin; a bin is the hash's highest bits."""
    return _bound(sorted_hashes, "s", _bound(f"64 - {bits}", "b", "filter(s, (x, i) -> i = 0 OR shiftright(x, b) <> shiftright(s[i - 1], b))"))


def _joined(left: DataFrame, items: DataFrame, on: list[str]) -> DataFrame:
    return left.join(F.broadcast(items) if items.count() <= BROADCAST_ROWS else items, on)


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of a document and a benchmark item of whose distinct shingles it holds at least ``threshold``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``;
    other columns are ignored. Returns doc_id, item_id, ``shared`` and
    ``item_shingles`` (longs) and ``containment``, one row per distinct pair.
    Words are runs of letters, digits and non-ASCII characters in lower case,
    shingles are k of them in a row. Texts of fewer than k words, null and empty texts have
    no shingles and take no part; rows without an id aren't reported. Repeated rows
    count once; of several texts under one id the best match counts.
    """
    texts = docs.select(c("doc_id").alias("doc"), "text").where("doc is not null and text is not null")
    asked = items.select(c("item_id").alias("item"), hashes(k).alias("hashes"), shingles(k).alias("shingles")).where(c("item").isNotNull())
    asked = cut(asked.distinct(), "items").where("size(hashes) > 0")
    full = texts.select("doc", hashes(k).alias("hashes"))

    part = full.withColumn("p", F.ceil(F.log2(F.size("hashes"))).cast("int"))
    sketch = part.select("doc", "p", F.explode(F.expr(_least_per_bin("hashes", f"(p + {DENSITY_BITS})"))).alias("hash"))
    per_part = asked.where(F.size("hashes") >= FEW).select("item", "hashes", F.explode(F.sequence(F.lit(0), F.lit(PARTITIONS - 1))).alias("p"))
    minima = per_part.select("item", "p", F.explode(F.expr(_least_per_bin("hashes", f"(p + {DENSITY_BITS})"))).alias("hash"))
    # One row per item and hash; bit p says that the hash is a minimum in partition p.
    masks = cut(minima.groupBy("item", "hash").agg(F.expr("bit_or(shiftleft(1L, p))").alias("mask")), "minima")
    pairs = _joined(sketch, masks, ["hash"]).where("shiftright(mask, p) & 1 = 1").select("doc", "item")
    few = asked.where(F.size("hashes") < FEW).select("item", F.explode("hashes").alias("hash"))
    if not few.isEmpty():
        pairs = pairs.unionByName(_joined(full.select("doc", F.explode("hashes").alias("hash")), few, ["hash"]).select("doc", "item"))
    pairs = cut(pairs.distinct(), "pairs")

    held = texts.join(pairs.select("doc").distinct(), "doc").select("doc", shingles(k).alias("own"))
    checked = held.join(pairs, "doc").join(asked.select("item", "shingles"), "item")
    shared = F.size(F.array_intersect("own", "shingles")).cast("long")
    counted = checked.select(c("doc").alias("doc_id"), c("item").alias("item_id"), shared.alias("shared"), F.size("shingles").cast("long").alias("item_shingles"))
    best = counted.where(c("shared") >= threshold * c("item_shingles") - 1e-9).groupBy("doc_id", "item_id").agg(F.max(F.struct(c("shared") / c("item_shingles"), "shared", "item_shingles")).alias("best"))
    return best.select("doc_id", "item_id", "best.shared", "best.item_shingles", F.expr("best.shared / best.item_shingles").alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without a doc_id stay."""
    bad = contained_items(docs, items, **options).select(c("doc_id").alias("__bad")).distinct()
    return docs.join(bad, c("doc_id") == c("__bad"), "left_anti")
