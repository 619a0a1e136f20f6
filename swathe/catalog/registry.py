"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import TABLES, Tables, VIEWS, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _finish(df: DataFrame, rounded: list[str], longs: list[str]) -> DataFrame:
    def one(c: str):
        if c in rounded:
            return (F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c)
        if c in longs:
            return F.col(c).cast("long").alias(c)
        return F.col(c)

    return df.select([one(c) for c in df.columns])


def query(name: str, views: str = "", sql: str | None = None, rnd: str = "", ints: str = ""):
    """Register a query under ``name``.

    ``views`` names the fixture views the SQL reads. Columns in ``rnd`` are
    rounded to 6 decimals and columns in ``ints`` cast to 64-bit on both sides.
    """
    rounded, longs = rnd.split(), ints.split()

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, folder: _finish(fn(Tables(spark, folder)), rounded, longs)
        if sql is not None:
            ORACLE[name] = _oracle(views.split(), sql.strip(), rounded, longs)
        return fn

    return wrap


def _oracle(views: list[str], body: str, rounded: list[str], longs: list[str]) -> str:
    ctes = [f"{v} AS (\n{view_sql(v, 'duckdb')}\n)" for v in views]
    if body.upper().startswith("WITH RECURSIVE "):
        ctes.append(body[len("WITH RECURSIVE "):])
        inner = "WITH RECURSIVE " + ",\n".join(ctes)
    elif body.upper().startswith("WITH "):
        ctes.append(body[len("WITH "):])
        inner = "WITH " + ",\n".join(ctes)
    elif ctes:
        inner = "WITH " + ",\n".join(ctes) + "\n" + body
    else:
        inner = body
    parts = [f"round(CAST({c} AS DOUBLE), 6) + 0 AS {c}" for c in rounded]
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in longs]
    if not parts:
        return inner
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{inner}\n) AS checked"
