"""Toxic passages: maximum-scoring segments of words under log-odds.

Training counts words, and their first four and six bytes, of toxic and clean
documents in hashed buckets, which bounds the model whatever the corpus. A
bucket's log-odds under a Dirichlet prior, less ``SIGMAS`` standard deviations,
is its score; a word takes the largest of its three, and words with none cost a constant. A linear scan finds every maximal
segment, and its score is turned into an E-value for a text of that length
(Karlin and Altschul): lambda solves sum p exp(lambda s) = 1 over the words of
clean documents. The sum of 1 / E over all passages is the document's evidence,
on a log scale, and a monotone fit on all labelled training documents maps it
to a probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .words import U, column_bytes, text_slices, word_hashes

BITS = 18
PREFIXES = (4, 6)
SPACES = 1 + len(PREFIXES)
BUCKETS = SPACES << BITS
PRIOR, CORPUS_PRIOR, SIGMAS, LEAST = 0.5, 500.0, 2.0, 0.5
SIGNIFICANT = 0.01
LOW, STEP, BINS = -7.0, 0.25, 257
c = F.col


@dataclass
class Model:
    scores: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    drift: float = 0.05
    lam: float = 1.0


def _buckets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word in each space, offsets of the texts)."""
    words, at, *short = word_hashes(*column_bytes(part.column("text")), PREFIXES)
    return np.stack([(h >> U(64 - BITS)).astype(np.int64) + (k << BITS) for k, h in enumerate([words, *short])]), at


def _counted(batches):
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for part in text_slices(batch, "text"):
            buckets, at = _buckets(part)
            toxic = np.repeat(part.column("toxic").to_numpy(), np.diff(at))
            for space in buckets:
                total += np.bincount(space + BUCKETS * toxic, minlength=2 * BUCKETS).reshape(2, BUCKETS)
    used = np.flatnonzero(total.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])], ["bucket", "clean", "toxic"])


def training_labels(labels: DataFrame) -> DataFrame:
    """(id, toxic) of the rows that may be learned from, one per document; rows without a label don't count."""
    usable = labels.where(c("doc_id").isNotNull() & c("toxic").isNotNull() & (F.crc32(c("doc_id").cast("string")) % 4 != 2))
    return usable.groupBy(c("doc_id").cast("long").alias("id")).agg(F.max((c("toxic") > 0).cast("long")).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Word scores from all labelled training documents; of equal texts one counts."""
    known = training_labels(labels)
    digests = docs.select(c("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    firsts = digests.join(known, "id").groupBy("digest").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")).select("id", "toxic")
    texts = docs.select(c("doc_id").cast("long").alias("id"), "text").join(firsts, "id").select("text", "toxic")
    counts = texts.mapInArrow(_counted, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = counts.toArrow()  # at most BUCKETS rows
    y = np.zeros((2, BUCKETS))
    y[0, table.column("bucket").to_numpy()] = table.column("clean").to_numpy()
    y[1, table.column("bucket").to_numpy()] = table.column("toxic").to_numpy()
    n = y.sum(axis=1) / SPACES
    if not n.all():
        return Model()
    alpha = PRIOR + CORPUS_PRIOR * y.sum(axis=0) / n.sum()
    mass = alpha.sum() / SPACES
    ratio = np.log((y[1] + alpha) / (n[1] + mass)) - np.log((y[0] + alpha) / (n[0] + mass))
    sure = ratio - SIGMAS * np.sqrt(1 / (y[0] + alpha) + 1 / (y[1] + alpha))
    scores = np.where((sure > LEAST) & (y[1] > 0), sure, 0).astype(np.float32)
    up = scores > 0
    p = (y[0] + PRIOR * up) / n[0] / SPACES
    drift = max(0.05, 2 * float((p[up] * scores[up]).sum()))
    return Model(scores, drift, _lambda(scores[up].astype(float), p[up], drift))


def _lambda(scores: np.ndarray, p: np.ndarray, drift: float) -> float:
    """The positive root of sum p exp(lambda s) = 1, other words scoring -drift."""
    value = lambda x: np.log((p * np.exp(np.minimum(x * scores, 500))).sum() + (1 - p.sum()) * np.exp(-x * drift))
    lo, hi = 1e-6, 8.0
    if not len(scores) or value(hi) <= 0:
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return lo


def segments(at: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), after Ruzzo and Tompa.

    ``at`` are the places of the words with positive scores; every word
    between them costs ``drift``. Linear in the number of such words.
    """
    kept: list[list] = []  # first, last, sum before, sum through
    total, place = 0.0, -1
    for k, s in zip(at.tolist(), scores.tolist(), strict=True):
        total -= drift * (k - place - 1)
        seg = [k, k, total, total + s]
        total, place = total + s, k
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= seg[2]:
                j -= 1
            if j < 0 or kept[j][3] >= seg[3]:
                kept.append(seg)
                break
            seg = [kept[j][0], seg[1], kept[j][2], seg[3]]
            del kept[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in kept]


def _scanned(model: Model):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                buckets, at = _buckets(part)
                scores = model.scores[buckets].max(axis=0)
                up = np.flatnonzero(scores > 0)
                bounds = np.searchsorted(up, at)
                length = np.diff(at)
                evidence, passages = np.full(len(part), -np.inf), [[] for _ in range(len(part))]
                for i in np.flatnonzero(np.diff(bounds)):
                    places = up[bounds[i] : bounds[i + 1]]
                    for a, b, s in segments(places - at[i], scores[places], model.drift):
                        e = np.log(length[i]) - model.lam * s
                        evidence[i] = np.logaddexp(evidence[i], -e)
                        if e < np.log(SIGNIFICANT):
                            passages[i].append({"first_word": a, "last_word": b, "score": float(s), "e_value": float(np.exp(e))})
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(length), pa.array(evidence), pa.array(passages, PASSAGES)], ["id", "n_words", "evidence", "passages"]
                )

    return run


PASSAGES = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(id, n_words, evidence, passages) of every row: log evidence (-infinity: none), and its significant toxic passages by word places from 0."""
    rows = docs.select(c("doc_id").cast("long").alias("id"), "text")
    return rows.mapInArrow(_scanned(model), "id long, n_words long, evidence double, passages array<struct<first_word:bigint,last_word:bigint,score:double,e_value:double>>")


def _bin(evidence):
    place = F.least(F.greatest(F.ceil((evidence - LOW) / STEP), F.lit(1)), F.lit(BINS - 1))
    return F.when(evidence > F.lit(float("-inf")), place).otherwise(0).cast("int")


def calibration(scored: DataFrame, labels: DataFrame) -> list[float]:
    """Probability of label 1 per bin of evidence, not falling, from all labelled training documents (pooled neighbours)."""
    rows = scored.join(training_labels(labels), "id").groupBy(_bin(c("evidence")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    n, hits = np.zeros(BINS), np.zeros(BINS)
    for r in rows.collect():  # at most BINS rows
        n[r["bin"]], hits[r["bin"]] = r["n"], r["hits"]
    base = (hits.sum() + 0.5) / (n.sum() + 1) if n.sum() else 0.05
    pools: list[list[float]] = []
    for i in range(BINS):
        prior = base
        pools.append([hits[i] + prior * 0.5, n[i] + 0.5, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return [h / m for h, m, k in pools for _ in range(int(k))]


def scored_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_words, evidence and the passages.

    Only ``text`` enters a score. Null and empty texts and texts without toxic
    passages get the probability of documents without evidence. Without usable
    labels of both kinds nothing is learned and no passage is found. Repeated
    rows get equal scores; a null doc_id is scored like any other.
    """
    found = cut(passages(docs, fit(docs, labels)), "toxic")
    p = calibration(found, labels)
    value = F.element_at(F.lit(p), _bin(c("evidence")) + 1)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
    held = F.coalesce(F.crc32(c("id").cast("string")) % 4 == 2, F.lit(False))
    return found.select(c("id").alias("doc_id"), held.alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "n_words", "evidence", "passages")


def _clean(model: Model, toxic: list[bool]):
    scan = _scanned(model)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                named = pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), part.column("text")], ["id", "text"])
                evidence = np.concatenate([x.column("evidence").to_numpy() for x in scan([named])])
                place = np.clip(np.ceil((np.maximum(evidence, LOW) - LOW) / STEP), 1, BINS - 1).astype(int)
                keep = ~np.array(toxic)[np.where(np.isneginf(evidence), 0, place)]
                yield part.filter(pa.array(keep))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that ``scored_documents`` predicts toxic; every row is judged by its own text, in place."""
    model = fit(docs, labels)
    p = calibration(passages(docs, model), labels)
    return docs.mapInArrow(_clean(model, [x >= threshold for x in p]), docs.schema)
