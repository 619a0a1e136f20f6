"""Collocations, centroid clusters and SimHash components against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from swathe.llm import centroids, collocations, components, simhash

from . import helpers as H

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("n", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    w = ["Ka", "lo", "né", "ra", "so", "mi-x", "ja b", "..", "ok?", "tu;", "zu\u000b", "to\ttwo"]
    rows = [(i, " ".join(rng.choices(w, [9, 8, 7, 6, 3, 3, 2, 1, 1, 1, 1, 1], k=rng.choice([1, 2, 9, 60, 200]))), rng.choice(["en", "en", "fr", None])) for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, " ,.\n", "xx"), (103, "Ka lo " * 700_000, "en"), (None, "Ka lo né", "fr"), rows[3], rows[3]]
    return rows


def phrases(rows, longest=3, least=10, share=50, top=2000):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", H.lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] = f.get((lang, tuple(words[i : i + k])), 0) + 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= share * a for (g, q), b in found.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked, seen = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


@pytest.mark.parametrize(("longest", "top", "chunk"), [(3, 2000, 8 << 20), (4, 7, 300)])
def test_collocations_equal_brute_force(spark, corpus, monkeypatch, longest, top, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "BUCKET", 40)
    rows = corpus if chunk > 1000 else [r for r in corpus if r[0] != 103]
    got = collocations.collocations(frame(spark, rows), longest=longest, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases(rows, longest, top=top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_scores_of_counts_beyond_64_bits(spark):
    a, left, right = 3 * 10**12 + 7, 9 * 10**12 + 1, 4 * 10**12 + 3
    row = spark.createDataFrame([(a, left, right)], "f long, l long, r long")
    score = "((1000000BD * cast(f as decimal(19,0)) * cast(f as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))))"
    assert row.selectExpr(score).first()[0] == 10**6 * a * a // (left * right)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (2, " . ", "en"), (3, "one", "en")])).count() == 0


def clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    centres = [q for _, q in first]
    for step in range(rounds + 1):
        own = [min((sum((x - y) ** 2 for x, y in zip(q, z, strict=True)), g) for g, z in enumerate(centres)) for _, q in kept]
        if step < rounds:
            for g in range(len(centres)):
                if members := [q for (_, q), (_, h) in zip(kept, own, strict=True) if h == g]:
                    centres[g] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    total = Counter()
    for d, g in own:
        total[g] += d
    return [(i, g, d, total[g], sum(total.values()), tuple(centres[g])) for (i, _), (d, g) in zip(kept, own, strict=True)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=64) / 8).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(60)] + [rows[7], rows[9], (None, rows[4][1])]
    rows += [(300, None), (301, []), (302, [0.1] * 63), (303, [0.1] * 63 + [None]), (304, [float("nan")] * 64), (305, [float("inf")] + [0.0] * 63), (306, [0.0] * 64), (307, [-3000.25] * 64)]
    return rows


VECTORS = "vec_id long, embedding array<double>, cluster string, q string"


@pytest.mark.parametrize("entries", [1 << 18, 1500, 0])
def test_clusters_equal_brute_force(spark, vectors, monkeypatch, entries):
    monkeypatch.setattr(centroids, "ENTRIES", entries)
    got = centroids.centroid_clusters(spark.createDataFrame([(*r, "x", "y") for r in vectors], VECTORS))
    key = lambda r: (r[0] is None, r)
    assert sorted(((*r[:5], tuple(r[5])) for r in got.collect()), key=key) == sorted(clusters(vectors), key=key)


def test_clusters_of_few_vectors(spark, vectors):
    assert centroids.centroid_clusters(spark.createDataFrame([], VECTORS)).count() == 0
    rows = vectors[:5]
    got = centroids.centroid_clusters(spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS))
    assert sorted((*r[:5], tuple(r[5])) for r in got.collect()) == sorted(clusters(rows))


def test_odd_dimensions(spark):
    rows = [(i, [i % 7 / 3, i % 5 / 9, i * i % 11 / 7]) for i in range(80)]
    got = centroids.centroid_clusters(spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS), k=4, rounds=2, dims=3)
    assert sorted((*r[:5], tuple(r[5])) for r in got.collect()) == sorted(clusters(rows, 4, 2, 3))


def test_components_out_of_reach_are_refused(spark):
    with pytest.raises(Exception, match="outside"):
        centroids.centroid_clusters(spark.createDataFrame([(1, [1e9] * 64, "", "")], VECTORS)).count()


def fingerprint(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", H.lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i : i + k] for i in range(len(w) - k + 1)] or ([w] if w else []))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values, radius=3):
    """value -> least value that links lead to."""
    u = np.array(sorted(set(values)), np.uint64)
    parent = list(range(len(u)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= radius) + i + 1:
            x, y = sorted((find(i), find(int(j))))
            parent[y] = x
    return {int(x): int(u[find(i)]) for i, x in enumerate(u)}


def test_simhash_equals_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(simhash, "PAGE", 16)
    rng = random.Random(13)
    long = " ".join(rng.choices(["ka", "Lo", "né", "ra\x1fso", "mi."], k=400))
    rows = [*corpus, *((500 + i, long.replace("ka", "xy", i % 3).replace("né", "ñ", i % 2), "en") for i in range(40)), (700, "one", ""), (701, "ONE\n", ""), (702, "a b", ""), (703, " \t\r\x0b\x0c", ""), (704, "x" * 3_000_000, "")]
    got = simhash.simhash_components(frame(spark, rows))
    want = {t: fingerprint(t) for _, t, _ in rows}
    root, least = linked([want[t] for i, t, _ in rows if i is not None]), {}
    for i, t, _ in rows:
        if i is not None:
            least[root[want[t]]] = min(i, least.get(root[want[t]], i))
    answer = [(i, want[t], None if i is None else least[root[want[t]]]) for i, t, _ in rows]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got.collect()), key=key) == sorted(answer, key=key)
    assert len({r[2] for r in answer}) < len({r[1] for r in answer})


def test_simhash_of_nothing(spark):
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    got = simhash.simhash_components(frame(spark, [(3, None, None), (1, "", "en")])).collect()
    assert sorted((r["doc_id"], r["fp"], r["component_id"]) for r in got) == [(1, 0, 1), (3, 0, 1)]


@pytest.mark.parametrize(("radius", "held", "spread"), [(3, 1 << 20, 2000), (3, 50, 12), (1, 200, 12), (2, 1 << 20, 4)])
def test_pages_link_what_is_near(monkeypatch, radius, held, spread):
    """Scattered values, and balls around few centres in which nearly all are linked."""
    monkeypatch.setattr(simhash, "HELD", held)
    rng = np.random.default_rng(radius + held + spread)
    centres = rng.integers(0, 1 << 63, spread, dtype=np.int64).astype(np.uint64)
    v = rng.choice(centres, 1500)
    for _ in range(5):
        v = v ^ (np.uint64(1) << rng.integers(0, 64, len(v)).astype(np.uint64))
    v = np.unique(v)
    whole = linked(v.tolist(), radius)
    parts = []
    width = -(-64 // (radius + 1))
    head = np.uint64((1 << 64) - (1 << (64 - width)))
    for t in range(radius + 1):
        s = np.uint64(t * width)
        r = (v << s) | (v >> (np.uint64(64) - s)) if s else v
        order = np.argsort(simhash.gray_rank(r))
        half = len(order) // 2
        one = [simhash.page_components(r[x], radius, head) for x in (order[:half], order[half:])]
        both = simhash.page_components(r[order], radius, head, half)
        parts += [(order[:half], one[0]), (order[half:], one[1]), (order, both)]
    joined = {}
    for order, label in parts:
        for i, j in enumerate(label):
            joined.setdefault(int(v[order[i]]), []).append(int(v[order[j]]))
    got = {x: x for x in joined}
    changed = True
    while changed:
        changed = False
        for x, ys in joined.items():
            low = min([got[x], *(got[y] for y in ys)])
            for z in (x, *ys):
                changed |= got[z] != low
                got[z] = low
    assert got == whole


def test_links_of_a_star_a_path_and_a_ring(spark):
    star = [(0, i) for i in range(1, 300)]
    path = [(1000 + i, 1001 + i) for i in range(200)]
    ring = [(-5, -6), (-6, -7), (-7, -5), (9, 9)]
    got = components.linked_components(spark.createDataFrame([*star, *path, *ring], "a long, b long"))
    want = {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(201)} | dict.fromkeys((-5, -6, -7), -7)
    assert {r["id"]: r["component"] for r in got.collect()} == want and got.count() == len(want)
    assert components.linked_components(spark.createDataFrame([], "a long, b long")).count() == 0
