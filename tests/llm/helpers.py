"""Brute-force counterparts of the operators, in plain Python."""

import re

from pyspark.sql import types as T

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_bytes", T.StringType()), T.StructField("id", T.StringType()), T.StructField("n_chars", T.LongType())])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def docs_frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "en", "x", "y", len(t or "")) for i, t in rows], DOCS)


def classes(rows, threshold=0.8):
    """doc_id -> (class, links) for rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    text = {i: tuple(words(t)) for i, t in rows}
    parent = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    if text[a] != text[b]:
                        links[a] += 1
                        links[b] += 1
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (find(i), links[i]) for i in sets}


def repeated_bytes(rows, length=100):
    """(doc_id, bytes, mark per byte that goes), by a dictionary of all strings."""
    seen = set()
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            key = b[s : s + length]
            if key in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(key)
        yield i, b, gone


def without_repeats(rows, length=100):
    """doc_id -> (bytes kept, removed, spans)."""
    out = {}
    for i, b, gone in repeated_bytes(rows, length):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (kept, sum(gone), spans)
    return out


def whole_characters(rows, length=100):
    """doc_id -> the characters of which no byte goes."""
    out = {}
    for i, b, gone in repeated_bytes(rows, length):
        at, kept = 0, []
        for ch in b.decode():
            size = len(ch.encode())
            kept += [ch] * (not any(gone[at : at + size]))
            at += size
        out[i] = "".join(kept)
    return out
