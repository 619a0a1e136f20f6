"""Tracks: nearest distances against all pairs, and islands that share one numbering."""

import numpy as np
import pytest

from swathe.streaming.tracks import TrackBook, smaller_median, track_batch, with_eras


@pytest.mark.parametrize("seed", range(20))
def test_smaller_median_equals_all_pairs(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.normal(0, rng.uniform(0.1, 4), (int(rng.integers(1, 40)), 3)) for _ in range(2))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert smaller_median(a, b, 0.3) == pytest.approx(min(np.median(d.min(axis=1)), np.median(d.min(axis=0))))


def test_islands_give_the_ids_of_one_session(spark):
    rng = np.random.default_rng(3)
    rows = [
        (run, 0, f, f * 0.4, name, *(float(v) for v in np.array([x, 0, 0]) + rng.normal(0, 0.1, 3)))
        for run in (0, 1) for f in range(14) for name, x in (("c", 0.0), ("b", 7.0), ("a", 30.0), ("d", 0.5)) if rng.random() < 0.5 for _ in range(5)
    ]
    v = spark.createDataFrame(rows, "run int, generation int, frame int, t_s double, component string, x double, y double, z double")
    want = []
    for run in (0, 1):
        book = TrackBook()
        for f in range(14):
            now = {n: np.array([r[5:] for r in rows if r[0] == run and r[2] == f and r[4] == n]) for n in sorted({r[4] for r in rows if r[0] == run and r[2] == f})}
            want += [(run, 0, *r) for r in book.observe(f, f * 0.4, now)]
    assert sorted(tuple(r) for r in track_batch(v).collect()) == sorted(want)
    assert len({r[4] for r in want if r[0] == 0}) > 2
    assert track_batch(v.where("run > 5")).collect() == []


def test_eras_end_where_every_track_has_ended(spark):
    rng = np.random.default_rng(5)
    stamps = [0.0, 0.4, 3.4, 6.5, 6.9, 20.0, 19.0, 22.5, 26.0]  # 3.0 s still holds a track, 3.1 s ends it; one stamp falls
    rows = [(0, 0, f, t, n, *(float(v) for v in np.array([x, 0, 0]) + rng.normal(0, 0.05, 3))) for f, t in enumerate(stamps) for n, x in (("a", 0.0), ("b", 9.0)) if (f + len(n) * (x > 0)) % 4 for _ in range(4)]
    v = spark.createDataFrame(rows, "run int, generation int, frame int, t_s double, component string, x double, y double, z double")
    book, want = TrackBook(), []
    for f, t in enumerate(stamps):
        now = {n: np.array([r[5:] for r in rows if r[2] == f and r[4] == n]) for n in sorted({r[4] for r in rows if r[2] == f})}
        if now:
            want += [(0, 0, *r) for r in book.observe(f, t, now)]
            book.forget(t)
    assert sorted(tuple(r) for r in track_batch(v).collect()) == sorted(want)
    whole = v.selectExpr("run", "generation", "0 AS island", "frame", "t_s").distinct()
    eras = {r["frame"]: r["era"] for r in with_eras(whole, 3.0).collect()}
    assert [eras.get(f) for f in range(9)] == [0, 0, 0, 1, 1, 2, 2, 2, 3]
