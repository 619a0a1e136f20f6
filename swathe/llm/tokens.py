"""Token counts through a cache of digests.

A text's content digest and the digest of the tokenizer file are the key of a
stored count. Only distinct contents without a stored count are encoded, and
their counts are appended, so a corpus that is counted again, or shares
texts with one that was, costs a join.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, scratch_folder
from .words import text_slices

CACHE = "tokenizer string, digest string, n_tokens long"
#: Counts of single words that a Python worker keeps.
KEPT = 1_000_000
c = F.col


class Counter:
    """Token counts exactly as the tokenizers library gives them.

    Where the file has a plain byte-level split and no normalizer, words are
    split by the library's published pattern and each distinct word is encoded
    once; any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        split = kind.get("pre_tokenizer") or {}
        added = kind.get("added_tokens") or []
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True) and not kind.get("normalizer")
        self.pattern = None
        if plain and not any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            import public_tokenizers
            import regex

            self.pattern = regex.compile(public_tokenizers.PATTERN)
            names = sorted((a["content"] for a in added), key=len, reverse=True)
            self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.known: dict[str, int] = {}

    def library(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if self.pattern is None:
            return self.library(texts)
        out, split = [], []
        for text in texts:
            pieces = self.added.split(text) if self.added else [text]
            out.append(len(pieces) - 1)
            split.append([w for p in pieces for w in self.pattern.findall(p)])
        known = self.known
        missing = list({w for words in split for w in words if w not in known})
        if len(known) + len(missing) > KEPT:
            known.clear()
            missing = list({w for words in split for w in words})
        known.update(zip(missing, self.library(missing), strict=True))
        return [n + sum(map(known.__getitem__, words)) for n, words in zip(out, split, strict=True)]


_counters: dict[str, Counter] = {}


def _encoded(path: str):
    def run(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        counter = _counters.setdefault(path, Counter(path)) if path not in _counters else _counters[path]
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                counts = counter.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def _stored(spark, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, path: str, cache: str | None = None, normalise: Column | None = None, limit: int = 1024) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) and the content digest.

    ``path``: the tokenizer file, at the same place on every machine.
    ``cache``: folder of the stored counts, by default in the shared scratch
    folder; it is made when absent. ``normalise`` is the content that is
    digested and encoded, by default the whole text. Null texts are empty and
    have no tokens; null doc_ids and repeated rows are counted like any other.
    """
    spark = docs.sparkSession
    cache = cache or os.path.join(scratch_folder(spark), "token-counts")
    content = F.coalesce(c("text") if normalise is None else normalise, F.lit(""))
    texts = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), content.alias("text"))
    texts = texts.withColumn("digest", F.sha2("text", 256)).withColumn("key", F.coalesce(c("doc_id").cast("string"), F.lit("none")))
    tokenizer = version(path)
    rows = cut(texts.select("doc_id", "n_bytes", "digest", "key"), "digests")
    stored = _stored(spark, cache).where(c("tokenizer") == tokenizer)
    firsts = rows.groupBy("digest").agg(F.min("key").alias("key")).join(stored.select("digest"), "digest", "left_anti")
    missing = texts.join(firsts.withColumnRenamed("digest", "first"), "key").where("digest = first").select("digest", "text")
    fresh = missing.mapInArrow(_encoded(path), "digest string, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = _stored(spark, cache).where(c("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (c("n_tokens") > limit).alias("over_limit"), "digest")
