"""Point-cloud views over the driver's tables.

One text serves Spark and the SQL check; the two places where the dialects
differ are marked ``{...}``. Frames, runs, paths and station groups grow with
the tables: a frame holds 50 order keys, a run 25 frames, a path 161 vertices.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..session import sized

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DIALECT = {
    "spark": {"TSNS": "unix_micros(CAST(ts AS TIMESTAMP)) * 1000", "EMB": "element_at(embedding, {})"},
    "duckdb": {"TSNS": "epoch_us(ts) * 1000", "EMB": "list_extract(embedding, {})"},
}

VIEWS = {
    "points": (
        ["lineitem"],
        """
SELECT CAST(floor(l_orderkey / 1250) AS INT) AS run,
       CAST(floor(l_orderkey / 50) AS INT) AS frame,
       ((l_orderkey % 50) * 8 + l_linenumber) * 10000000000000 + (l_partkey % 10000000) * 1000000
         + CAST(round(l_extendedprice * 100) AS BIGINT) % 1000000 AS point_idx,
       CAST((l_orderkey % 50) * 8 + l_linenumber AS INT) AS slot,
       CAST((l_partkey * 7 + l_orderkey * 3) % 601 AS DOUBLE) / 100 - 3 AS x,
       -(CAST(l_quantity AS DOUBLE) * 2 + CAST(l_partkey % 13 AS DOUBLE) / 8) AS y,
       CAST((l_suppkey * 37 + l_partkey * 11) % 401 AS DOUBLE) / 100 - 1 AS z,
       l_extendedprice AS intensity, CAST(l_linenumber AS INT) AS ring
FROM lineitem""",
    ),
    "frames": (
        ["orders"],
        """
SELECT CAST(floor(f / 25) AS INT) AS run, f AS frame,
       CAST(CASE WHEN f % 25 >= 10 THEN 1 ELSE 0 END AS INT) AS generation,
       CAST(f AS BIGINT) * 100000000 + CAST(floor(f / 25) AS BIGINT) * 2000000000
         + CASE WHEN f % 25 >= 10 THEN 1000000000 ELSE 0 END AS header_time_ns,
       CASE WHEN f % 2 = 1 THEN CAST(0.96 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS r00,
       CASE WHEN f % 2 = 1 THEN CAST(-0.28 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS r01,
       CAST(0 AS DOUBLE) AS r02,
       CASE WHEN f % 2 = 1 THEN CAST(0.28 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS r10,
       CASE WHEN f % 2 = 1 THEN CAST(0.96 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS r11,
       CAST(0 AS DOUBLE) AS r12, CAST(0 AS DOUBLE) AS r20, CAST(0 AS DOUBLE) AS r21, CAST(1 AS DOUBLE) AS r22,
       (f % 7) * CAST(0.25 AS DOUBLE) AS tx, (f % 25) * CAST(-0.5 AS DOUBLE) AS ty, CAST(0 AS DOUBLE) AS tz,
       CASE WHEN f % 37 = 36 THEN 'unavailable' ELSE 'ok' END AS pose_status
FROM (SELECT DISTINCT CAST(floor(o_orderkey / 50) AS INT) AS f FROM orders) q""",
    ),
    "path": (
        ["part"],
        """
SELECT run, k, k * CAST(0.5 AS DOUBLE) AS s,
       CAST(-0.792 AS DOUBLE) + k * k * b AS lx, k * CAST(-0.5 AS DOUBLE) AS ly, k * CAST(0.001 AS DOUBLE) AS lz,
       CAST(0.792 AS DOUBLE) + k * k * b AS rx, k * CAST(-0.5 AS DOUBLE) AS ry, k * CAST(0.001 AS DOUBLE) AS rz,
       CAST(-1.492 AS DOUBLE) + k * k * b AS cx, k * CAST(-0.5 AS DOUBLE) AS cy,
       k * CAST(0.001 AS DOUBLE) + CAST(0.15 AS DOUBLE) AS cz
FROM (SELECT CAST(floor(p_partkey / 161) AS INT) AS run, CAST(p_partkey % 161 AS INT) AS k,
             CAST(0.0001 AS DOUBLE) * (1 + CAST(floor(p_partkey / 161) AS INT) % 3) AS b FROM part) q""",
    ),
    "obs": (
        ["embeddings"],
        """
SELECT CAST(vec_id AS INT) AS obs_id, CAST(vec_id % 50 AS INT) AS source_frame, CAST(vec_id % 3 AS INT) AS generation,
       label AS track_id,
       CAST({EMB1} AS DOUBLE) * 100 + floor(vec_id / 500) * 400 AS wx,
       CAST({EMB2} AS DOUBLE) * 100 AS wy, CAST({EMB3} AS DOUBLE) * 100 AS wz,
       CAST(vec_id % 17 AS INT) + 2 AS voxel_count, CAST(vec_id % 23 AS INT) + 3 AS point_count
FROM embeddings""",
    ),
    "stations": (
        ["orders"],
        """
SELECT CAST(o_orderkey AS BIGINT) AS row_id, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS method,
       CAST(floor(j / 750) AS INT) AS run, CAST(floor((j % 750) / 30) AS INT) AS frame, CAST(j % 30 AS INT) AS station,
       CAST((j % 30) * 50 + j % 50 AS DOUBLE) / 10 AS range_m,
       CAST(CAST(floor(o_totalprice) AS BIGINT) % 601 AS DOUBLE) / 1000 AS error_m,
       CAST(o_custkey % 9 + 1 AS DOUBLE) / 50 AS sigma_m, o_orderstatus <> 'P' AS evaluable
FROM (SELECT *, CAST(floor(o_orderkey / 2) AS BIGINT) AS j FROM orders) q""",
    ),
    "template": (
        ["supplier"],
        """
SELECT CAST(s_suppkey AS INT) AS cell, CAST(s_suppkey % 10 AS DOUBLE) * 0.012 AS v, CAST(s_suppkey % 7 AS DOUBLE) * 0.008 AS w
FROM supplier""",
    ),
    "messages": (
        ["events"],
        """
SELECT event_id AS message_id, event_type AS topic, user_id AS source, {TSNS} AS ts_ns, value, props
FROM events""",
    ),
}


def view_sql(name: str, engine: str) -> str:
    words = DIALECT[engine]
    text = VIEWS[name][1]
    for i in (1, 2, 3):
        text = text.replace("{EMB%d}" % i, words["EMB"].format(i))
    return text.replace("{TSNS}", words["TSNS"]).strip()


class Tables:
    """Driver tables as attributes, and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return sized(self._read(name))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        needs, _ = VIEWS[name]
        text = view_sql(name, "spark")
        for t in needs:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
        return sized(self.spark.sql(text, **{t: self._read(t) for t in needs}))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)
