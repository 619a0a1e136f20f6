"""Operators on documents against brute force, on small fixtures and whole small tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ..conftest import SMALL
from . import helpers as H

from swathe.llm import near, repeats
from swathe.llm.decontaminate import contained_items, without_items
from swathe.llm.licenses import RULES, license_scan


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "Tu", "né", "ra", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    texts = [prose(rng, rng.choice([3, 6, 30, 200])) for _ in range(60)]
    passage = prose(rng, 70)
    for i in range(12):
        texts.append(prose(rng, 20) + " " + passage + ". " + prose(rng, 15))
    for i in range(25):  # near copies of one text, and exact ones
        w = texts[5 * (i % 2) + 3].split()
        if i % 5:
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " .,;", "one", "one two", "One, two!", "x" * 5000, "ab" * 400, "é" * 300, passage, passage]
    return list(enumerate(texts))


def edge_rows(corpus):
    return [*corpus, (None, corpus[3][1]), (None, None), corpus[4], corpus[4]]


def test_classes_equal_brute_force(spark, corpus):
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in near.jaccard_classes(H.docs_frame(spark, corpus)).collect()}
    assert got == H.classes(corpus)


def test_blocks_of_a_large_class_change_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in near.jaccard_classes(H.docs_frame(spark, corpus)).collect()}
    assert got == H.classes(corpus)


def test_classes_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in near.jaccard_classes(docs).collect()} == H.classes(rows)


def test_classes_of_odd_rows(spark, corpus):
    rows = edge_rows(corpus)
    got = near.jaccard_classes(H.docs_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["class_id"] is None and r["links"] == 0 for r in got if r["doc_id"] is None)
    kept = near.keep_one_per_class(H.docs_frame(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == H.DOCS.names and ids.count(4) == 1 and ids.count(None) == 2
    assert {i for i in ids if i is not None} == {c for c, _ in H.classes(corpus).values()}


def test_recall_bound():
    assert near.recall(0.8, 3) > 0.99998 and near.recall(0.8, 8) < 0.95


def test_empty_tables(spark):
    none = H.docs_frame(spark, [])
    assert near.jaccard_classes(none).count() == 0
    assert repeats.without_repeats(none).count() == 0
    assert license_scan(none).count() == 0
    assert contained_items(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    only = H.docs_frame(spark, [(1, None), (2, "")])
    assert near.keep_one_per_class(only).count() == 2 and repeats.without_repeats(only).count() == 2


def removed(frame):
    return {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in frame.collect()}


def test_repeats_equal_brute_force(spark, corpus):
    assert removed(repeats.without_repeats(H.docs_frame(spark, corpus))) == H.without_repeats(corpus)


def test_crowded_grams_change_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 3)
    assert removed(repeats.without_repeats(H.docs_frame(spark, corpus))) == H.without_repeats(corpus)


def test_repeats_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = repeats.without_repeats(docs.select("doc_id", "text"))
    assert removed(got) == H.without_repeats(rows)
    digest = got.select("doc_id", F.sha2("kept", 256).alias("d")).first()
    assert digest["d"] == hashlib.sha256(H.without_repeats(rows)[digest["doc_id"]][0]).hexdigest()


def test_repeats_of_odd_rows(spark, corpus):
    rows = edge_rows(corpus)
    got = repeats.without_repeats(H.docs_frame(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"lang", "id", "kept"}
    whole = [r for r in got if r["doc_id"] is None]
    assert all(r["n_removed"] == 0 for r in whole)
    want = H.without_repeats(corpus)
    assert all((bytes(r["kept"]), r["n_removed"], r["n_spans"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    texts = repeats.kept_text(H.docs_frame(spark, rows)).collect()
    assert all("�" not in (r["text"] or "") and (r["text"] is None or len(r["text"]) == r["n_chars"]) for r in texts)


def test_text_keeps_its_own_replacement_characters(spark, corpus):
    rng = random.Random(5)
    passage = prose(rng, 40)
    rows = [(1, "a\ufffdb " + passage), (2, "keep\ufffdme \ufffd\ufffd" + passage + "\ufffd end"), (3, "éé" * 80), (4, "xé" + "éé" * 60 + "\ufffd"), (5, "no repeat \ufffd"), *((100 + i, t) for i, t in corpus)]
    got = repeats.kept_text(H.docs_frame(spark, rows))
    assert got.columns == H.DOCS.names
    want = H.whole_characters(rows)
    assert all((r["text"] or "") == want[r["doc_id"]] and r["n_bytes"] == "x" for r in got.collect())
    assert want[2].startswith("keep\ufffdme \ufffd\ufffd") and want[5] == "no repeat \ufffd"


def test_repeats_across_slices_of_a_very_long_text(spark):
    rng = random.Random(6)
    passage = prose(rng, 60)
    filler = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    cut = repeats.SLICE
    rows = [(1, filler(cut - 150) + passage + filler(cut) + passage + filler(300)), (2, filler(70) + passage), (3, filler(2 * cut - 77) + passage[:150] + filler(9) + passage[20:])]
    assert removed(repeats.without_repeats(H.docs_frame(spark, rows))) == H.without_repeats(rows)


def test_zero_bytes_and_all_byte_values(spark):
    rng = random.Random(2)
    every = "".join(map(chr, range(128))) + "".join(chr(rng.randrange(128, 0x700)) for _ in range(900))
    rows = [(1, every), (2, "\0" * 250), (3, "q" + every[200:700] + "\0" * 130), (4, every[100:] + "zz")]
    assert removed(repeats.without_repeats(H.docs_frame(spark, rows))) == H.without_repeats(rows)


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, doc_id string")


def brute_items(docs, items):
    out = set()
    for d, t in docs:
        w = [x.lower() for x in H.words(t)]
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for i, q in items:
            v = [x.lower() for x in H.words(q)]
            ask = {tuple(v[j : j + 5]) for j in range(len(v) - 4)}
            if d is not None and i is not None and ask and len(own & ask) >= 0.8 * len(ask) - 1e-9:
                out.add((d, i, len(own & ask), len(ask)))
    return out


def test_items_equal_brute_force(spark, corpus):
    rng = random.Random(3)
    items = [(i, prose(rng, 30)) for i in range(20)] + [(20, "one two three four five"), (21, "a b"), (22, None), (None, prose(rng, 20)), (23, prose(rng, 6)), (24, prose(rng, 6))]
    docs = list(corpus)
    for n in range(40):
        text = items[n % 20][1].split()
        text[rng.randrange(30)] = "other"
        docs.append((1000 + n, prose(rng, 400 * (n % 3)) + " " + " ".join(text) + " " + prose(rng, 10)))
    docs += [(2000, "zero one two three four five six"), (2001, prose(rng, 900) + " " + items[24][1]), (None, items[0][1]), docs[-1]]
    got = {tuple(r)[:4] for r in contained_items(H.docs_frame(spark, docs), items_frame(spark, items)).collect()}
    want = brute_items(docs, items)
    assert got == want and len(want) > 20
    kept = without_items(H.docs_frame(spark, docs), items_frame(spark, items))
    assert kept.columns == H.DOCS.names
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {w[0] for w in want}


def test_items_of_the_small_table(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {tuple(r)[:4] for r in contained_items(docs, items).collect()}
    want = brute_items([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == want and want


def brute_base(text):
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    w = H.words(text)
    places = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


LICENSE_TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0. mit license MIT\nLicense",
    "Licensed under CC BY-NC 4.0.", "a CC BY b cc--by CC BY", "gnu gnu general, public LICENSE gnu General Public License", "emit license mit licenses mit licensé",
    "SPDX-License-Identifier: GPL-2.0-or-later", "https://opensource.org/licenses/MIT and all rights reserved", "Kit lİcense MIT LICENSE", "mit der cc isc und by", None, "", "...", "MIT LICENSE",
]


def test_license_base_equals_brute_force(spark):
    rows = list(enumerate(LICENSE_TEXTS)) + [(None, "MIT License"), (1, LICENSE_TEXTS[1])]
    got = license_scan(H.docs_frame(spark, rows)).collect()
    want = sorted(((i, *brute_base(t)) for i, t in rows), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_license_labels_and_suppression(spark):
    got = {r["doc_id"]: r for r in license_scan(H.docs_frame(spark, list(enumerate(LICENSE_TEXTS)))).collect()}
    assert got[0]["labels"] == "gpl,gpl-3.0"  # the bare name lies inside the grant with its version
    assert got[2]["labels"] == "cc-by,cc-by-nc-4.0" and got[2]["score"] == 0.95
    assert got[6]["labels"] == "gpl-2.0" and got[7]["labels"] == "mit,proprietary"
    assert got[9]["labels"] == "" and got[9]["score"] == 0
    assert len(RULES) > 300 and len({r["pattern"] for r in RULES}) > 300


def test_licenses_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"]: brute_base(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: tuple(r)[1:6] for r in license_scan(docs).collect()} == want
