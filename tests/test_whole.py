"""Registered queries do the whole job: all rounds and all rows."""

import ast
from pathlib import Path
from types import SimpleNamespace

import swathe.catalog
from swathe.catalog import q_detect, registry
from swathe.operators import windows as win


def test_no_registered_query_cuts_rounds_or_replicates():
    found = []
    for file in Path(swathe.catalog.__file__).parent.glob("q_*.py"):
        for node in ast.walk(ast.parse(file.read_text())):
            names = [k.arg for k in node.keywords] if isinstance(node, ast.Call) else [getattr(k, "value", None) for k in node.keys] if isinstance(node, ast.Dict) else []
            found += [(file.name, node.lineno, n) for n in names if n in ("rounds", "replicates")]
    assert not found


def test_march_queries_reach_the_end_of_a_corridor(spark):
    template = spark.createDataFrame([(i, 0.01 * i, 0.0) for i in range(10)], "cell int, v double, w double")
    points = spark.createDataFrame([(0, i, 4.0 + 0.5 * i, 0.03 * (i % 3), 0.0) for i in range(48)], "run int, id long, u double, v double, w double")
    starts = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "run int, u double, v double, w double")
    r = q_detect._reach(SimpleNamespace(template=template), {"base": {}, "strict": {"min_points": 4}}, (points, starts)).where("config = 'base'").first()
    assert r["reach_m"] > 16 and r["reason"] != "RANGE_LIMIT"  # three rounds end at 16 m


def test_likelihood_takes_every_point_within_its_own_gate(spark, monkeypatch):
    template = spark.createDataFrame([(i, 0.01 * i, 0.0) for i in range(10)], "cell int, v double, w double")
    xz = [(-0.15, 0.0), (0.25, 0.0), (0.05, -0.15), (0.05, 0.17)]  # each in a run of its own, within 8 + 10 cm of the template
    points = spark.createDataFrame([(run, run, run, x, z) for run, (x, z) in enumerate(xz)] + [(9, 9, 9, 2.0, 0.0)], "run int, frame int, point_idx long, x double, z double")
    monkeypatch.setattr(registry, "Tables", lambda s, folder: SimpleNamespace(points=points, template=template))
    assert {r["run"] for r in registry.QUERIES["itr_11_visibility_likelihood"](spark, "").collect()} == {0, 1, 2, 3}


def test_coverage_is_selected_for_every_start(spark, small, monkeypatch):
    monkeypatch.setattr(registry, "Tables", lambda s, folder: small)
    got = {r["frame"] for r in registry.QUERIES["det_10_history_select"](spark, "").where("rule = 'COVERAGE'").select("frame").collect()}
    h = win.causal_history(win.chains(small.frames, ["run"]), ["run"]).select("frame", "source")
    seen = {r["frame"] for r in small.points.select("frame").distinct().collect()}
    assert got == {r["frame"] for r in h.collect() if r["source"] in seen} and len(got) > 20
