"""Toxicity, tokenizers, archives, neighbours, threads and the pipeline."""

import glob
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..conftest import SMALL
from . import helpers as H

import __spark_entry__ as entry
from swathe.llm import nearest, pieces, queries, quotes, tokens, toxicity, warc

SP = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  a  b ", "don't've <|endoftext|> x", "é" * 99, "\n\n\t.", "梦ﬁ\U0001f600\0", "z" * 3000, "<s>▁▁x</s>", "word, word. (word) " * 40]


def odd_rows():
    return [*enumerate(ODD), (None, "no id"), (3, ODD[3])]


def test_segments_are_the_maximal_ones():
    def brute(scores):
        out = []

        def split(lo, hi):
            if lo < hi:
                total, _, i, j = max((round(sum(scores[i:j]), 9), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1))
                if total > 0:
                    split(lo, i)
                    out.append((i, j - 1))
                    split(j, hi)

        split(0, len(scores))
        return out

    rng = random.Random(4)
    for _ in range(60):
        scores = [round(rng.uniform(0.5, 3), 3) if rng.random() < 0.3 else -0.73 for _ in range(25)]
        at = [i for i, s in enumerate(scores) if s > 0]
        got = [(a, b) for a, b, _ in toxicity.segments(np.array(at, int), np.array([scores[i] for i in at]), 0.73)]
        assert got == brute(scores)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    plain = [" ".join(rng.choice("ka lo mi tu ne ra so vi".split()) for _ in range(60)) for _ in range(500)]
    rows, labels = [], []
    for i, t in enumerate(plain):
        bad = i % 5 == 0
        if bad:
            w = t.split()
            for _ in range(5):
                w[rng.randrange(60)] = rng.choice("Idiot scum moron clown".split())
            t = " ".join(w)
        rows.append((i, t))
        labels.append((i, 1, int(bad)))
    return rows, spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, labelled):
    rows, labels = labelled
    got = {r["doc_id"]: r for r in toxicity.scored_documents(H.docs_frame(spark, [*rows, (9000, None), (9001, "")]), labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and i < 500]
    assert len(held) > 80 and sum(got[i]["predicted"] == (i % 5 == 0) for i in held) >= 0.98 * len(held)
    assert got[9000]["predicted"] == got[9001]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    clean = toxicity.without_toxic(H.docs_frame(spark, [*rows, (None, "moron idiot scum clown " * 9), (None, None)]), labels)
    assert clean.columns == H.DOCS.names
    ids = [r["doc_id"] for r in clean.collect()]
    assert {i for i in ids if i is not None} == {i for i, _ in rows if not got[i]["predicted"]} and ids.count(None) == 1


def test_nothing_learned_without_labels(spark, labelled):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.scored_documents(H.docs_frame(spark, labelled[0][:20]), none).collect()
    assert len(got) == 20 and not any(r["predicted"] for r in got)
    assert toxicity.scored_documents(H.docs_frame(spark, []), none).count() == 0


def test_token_counts_and_the_cache(spark, tmp_path):
    rows = odd_rows()
    docs = H.docs_frame(spark, rows)
    cache = str(tmp_path / "counts")
    library = Tokenizer.from_file(BPE)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows)
    for _ in range(2):  # the second time all counts are stored
        got = tokens.token_counts(docs, BPE, cache).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    assert tokens.token_counts(H.docs_frame(spark, []), BPE, cache).count() == 0


def test_pieces_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    rows = odd_rows()
    out = pieces.encoded(H.docs_frame(spark, rows), SP)
    got = out.collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(sp.encode(t or ""))) for i, t in rows)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest() for r in got)
    back = pieces.decoded(out, SP).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, sp.decode(sp.encode(t or ""))) for i, t in rows)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"]: sp.encode(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in pieces.encoded(docs, SP).collect()} == want


def test_streaming_commits_equal_the_whole_search():
    model = pieces.Model(SP)
    rng = random.Random(7)
    for alphabet in ("abcdefgh", "theranding", "ab▁."):
        text = "".join(rng.choice(alphabet) for _ in range(2000))
        assert model.pieces.search(iter(model.sp.normalize(text))) == model.sp.encode(text)


def test_unigram_scores():
    scores = {"a": (1, -1.0), "b": (2, -1.5), "ab": (3, -2.0), "ba": (4, -2.2), "aba": (5, -2.9), "bb": (6, -4.5)}
    p = pieces.Pieces(scores, None, 0, bpe=False)
    rng = random.Random(8)

    def best(t):
        table = [(0.0, ())]
        for i in range(1, len(t) + 1):
            table.append(max((table[j][0] + scores[t[j:i]][1], (*table[j][1], t[j:i])) for j in range(max(0, i - 3), i) if t[j:i] in scores))
        return table[-1][0]

    for _ in range(30):
        t = "".join(rng.choice("ab") for _ in range(60))
        ids = p.search(t)
        back = {i: s for i, s in scores.values()}
        assert abs(sum(back[i] for i in ids) - best(t)) < 1e-9 and p.decode(ids) == t
    assert p.search("azza") == [1, 0, 1]


def brute_pages(rows):
    last = {}
    for i, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    out = Counter()
    for i, h in rows:
        b = (h or "").encode()
        far = len(b) >= 1000 and last[h or ""] >= 0 and i != last[h or ""]
        out[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if far else "response", last[h or ""] if far else None)] += 1
    return out


def test_archives(spark, tmp_path):
    long, other = "<p>é</p>" * 300, "x" * 1000
    rows = [(1, long), (7, long), (5, long), (2, other), (3, other), (4, "short"), (6, "short"), (8, None), (9, ""), (None, long), (7, long), (None, None)]
    pages = spark.createDataFrame([(i, "http://a/\r\nb" if i == 1 else None, h, "x") for i, h in rows], "page_id long, url string, html string, digest string")
    folder = str(tmp_path / "warc")
    listed = warc.write_archives(pages, folder)
    got = warc.read_archives(listed, folder, payloads=True).collect()
    assert Counter(tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got) == brute_pages(rows)
    assert all(bytes(r["payload"]).decode() == dict(rows)[r["page_id"]] for r in got if r["record_type"] == "response" and r["page_id"] in (2, 4, 6, 7))
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in glob.glob(folder + "/*")) == len(rows)
    assert warc.archived(pages.limit(0)).count() == 0


def test_damaged_archives():
    body = b"payload" * 50
    whole = warc.record(1, "u", body, hashlib.sha1(body).digest(), None) + warc.record(2, "u", body, hashlib.sha1(body).digest(), 1)
    assert [r["record_type"] for r in warc.read_records(io.BytesIO(whole))] == ["response", "revisit"]
    wrong = warc.record(1, "u", body, hashlib.sha1(b"other").digest(), None)
    for bad in (whole[:-9], whole + b"junk", wrong):
        with pytest.raises(warc.Damaged):
            list(warc.read_records(io.BytesIO(bad)))


def test_warc_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    cur = con.execute(queries.ORACLE["op7_warc"])
    names = [d[0] for d in cur.description]
    got = queries.QUERIES["op7_warc"](spark, SMALL)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(cur.fetchall())


def brute_nearest(rows, every, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(np.array(v, float)).all() and any(v)}
    out = []
    for q in sorted(i for i in ok if i % every == 0):
        near = sorted(((-round(float(ok[q] @ x / np.linalg.norm(ok[q]) / np.linalg.norm(x)), 9), i) for i, x in ok.items() if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return out


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "WINDOW", 4)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 8)
    rng = random.Random(9)
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(8)]) for i in range(150)]
    rows += [(150 + i, rows[10][1]) for i in range(12)] + [(170, None), (171, [0.0] * 8), (172, [float("nan")] * 8), (173, [None] + [1.0] * 7), (174, [1.0] * 3), (None, [1.0] * 8), rows[20], rows[20], (180, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, query long")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nearest.nearest(frame, 10).collect()]
    want = brute_nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 10, 5)
    assert sorted(x[:3] for x in got) == [x[:3] for x in want]
    assert np.allclose([x[3] for x in sorted(got)], [x[3] for x in want], atol=1e-8)
    assert nearest.nearest(frame.limit(0)).count() == 0 and nearest.nearest(frame.where("vec_id = 20").limit(1), 10).count() == 0


def test_hilbert_keys_are_a_walk(spark):
    n, levels = 3, 3
    cells = spark.range(1 << n * levels).selectExpr("array(cast(id % 8 as int), cast(id div 8 % 8 as int), cast(id div 64 as int)) as x")
    walk = [r["x"] for r in cells.select("x", F.expr(nearest.hilbert_key("x", n, levels)).alias("k")).orderBy("k").collect()]
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(walk, walk[1:], strict=False))


TALK = [
    ("c", 0, "a", "Hello there everyone.\nWhat shall we build today?"),
    ("c", 1, "b", "> What shall we  BUILD today?\n\nA bridge over the river."),
    ("c", 2, "c", "On Monday b wrote:\n> > What shall we build today?\n>\n> A bridge over the river.\nToo expensive."),
    ("c", 3, "d", "> Hello there everyone.\n> What shall we build today?\nA tunnel."),
    ("c", 4, "a", "> Too expensive.\nWhy is that?"),
    ("c", 5, "b", "> never said by anyone\nGo on."),
    ("c", 6, "e", ">> nested only\nFine."),
    ("c", 7, "f", "> A bridge over the river.\n> something added\nI like it."),
    ("d", 3, "x", "> Hello there everyone.\nother talk"), ("d", 1, None, None), ("d", 3, "x", "> Hello there everyone.\nother talk"),
    (None, 1, "n", "no talk"), ("d", None, "n", "> no turn"),
]


def test_threads(spark):
    rows = quotes.threads(spark.createDataFrame([(*t, 1) for t in TALK], "conv_id string, turn long, role string, text string, position int")).collect()
    assert len(rows) == len(TALK)
    c = {r["turn"]: r for r in rows if r["conv_id"] == "c"}
    assert {t: r["reply_to"] for t, r in c.items()} == {0: None, 1: 0, 2: 1, 3: 0, 4: 2, 5: 4, 6: 5, 7: 1}
    assert [t for t, _ in sorted(c.items(), key=lambda x: x[1]["position"])] == [0, 1, 2, 4, 5, 6, 7, 3]
    assert sorted(r["position"] for r in c.values()) == list(range(8))
    assert c[2]["body"] == "Too expensive." and c[2]["quoted"] == 2 and c[2]["linked"] == 2 and c[7]["linked"] == 1
    assert c[1]["formatted"] == "<|b|>\nA bridge over the river."
    d = [r for r in rows if r["conv_id"] == "d" and r["turn"] == 3]
    assert len(d) == 2 and all(r["position"] == 1 and r["reply_to"] == 1 and r["linked"] == 0 for r in d)
    assert all(r["position"] is None for r in rows if r["conv_id"] is None or r["turn"] is None)


def test_deep_threads_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 3)
    rng = random.Random(10)
    talk, parent = [], {}
    for t in range(40):
        quoted = rng.randrange(t) if t and rng.random() < 0.6 else None
        parent[t] = quoted if quoted is not None else (t - 1 if t else None)
        talk.append((1, 2 * t, "u", (f"> this is message number {quoted}\n" if quoted is not None else "") + f"this is message number {t}"))
    kids = {t: sorted(x for x in parent if parent[x] == t) for t in parent}
    order, stack = [], [0]
    while stack:
        t = stack.pop()
        order.append(t)
        stack += kids[t][::-1]
    got = quotes.threads(spark.createDataFrame(talk, "conv_id int, turn int, role string, text string")).collect()
    assert [r["turn"] // 2 for r in sorted(got, key=lambda r: r["position"])] == order
    assert {r["turn"] // 2: r["reply_to"] and r["reply_to"] // 2 for r in got} == {t: p for t, p in parent.items()}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.cut(stage(spark, rows, SMALL), name)
        assert rows.columns == docs.columns and [f.dataType for f in rows.schema] == [f.dataType for f in docs.schema]
    last = corpus_pipeline.STAGES[-1][1](spark, rows, SMALL)
    assert last.count() == rows.count() > 0.5 * docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
    assert "pipeline" in entry.queries()


def test_outermost_level_and_short_lines_link(spark):
    talk = [
        ("a", 0, "u", "The first question of all, at length"), ("a", 1, "v", "A second remark, of another kind"), ("a", 2, "u", ">> The first question of all, at length\nTo that"),
        ("a", 3, "v", ">> The first question of all, at length\n> A second remark, of another kind\nTo the outer one"),
        ("b", 0, "u", "Tea?"), ("b", 1, "v", "Nothing to do with it"), ("b", 2, "u", "> Tea?\n> never said by anyone\nYes"),
        ("c", 0, "u", "Yes"), ("c", 1, "v", "A longer line of text"), ("c", 2, "u", "Something else"), ("c", 3, "v", "> A longer line of text\n> never said by anyone\n> Yes\nSo"),
    ]
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["linked"]) for r in quotes.threads(spark.createDataFrame(talk, "conv_id string, turn long, role string, text string")).collect()}
    assert [got["a", 2], got["a", 3], got["b", 2], got["c", 3]] == [(0, 1), (1, 2), (0, 1), (1, 1)]
