"""Run a registered query in Spark and its SQL in DuckDB and compare the two results cell by cell."""

from __future__ import annotations

import glob
import math
import os

from pyspark.sql import SparkSession


def duckdb_tables(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return float(value)
    return value


def _rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in records]
    return [names[i] for i in order], sorted(rows, key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r))


# Names of the same type on both sides.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def crossing(df) -> str | None:
    """The join operator of a plan that pairs rows without a key, if there is one."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next((op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan), None)


def compare(spark: SparkSession, con, sf_dir: str, query, sql: str) -> str | None:
    """None when names, rows and values agree, else what differs first."""
    df = query(spark, sf_dir)
    if crossing(df):
        return f"the plan has a {crossing(df)}"
    names, got = _rows([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    other, want = _rows(result.fetchall(), [d[0] for d in result.description])
    if names != other:
        return f"columns {names} against {other}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    odd = [f"{n} {t} against {kinds[n]}" for n, t in df.dtypes if TYPES.get(t) != kinds[n]]
    if odd:
        return "types: " + ", ".join(odd)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if [(type(x), repr(x)) for x in a] != [(type(x), repr(x)) for x in b]:
            return f"row {a} against {b}"
    return None
