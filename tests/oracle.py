"""Compare a Spark result with a DuckDB result over the same parquet tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


_SPARK_TYPES = {"bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool"}
_DUCK_TYPES = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool"}


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def compare(df, connection, sql: str) -> list[str]:
    """What differs: column names, types, rows. Empty if nothing does."""
    problems = []
    relation = connection.sql(sql)
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return [f"columns {names} against {sorted(relation.columns)}"]
    spark_types = {n: _SPARK_TYPES.get(t, t) for n, t in df.dtypes}
    duck_types = {n: _DUCK_TYPES.get(str(t), str(t)) for n, t in zip(relation.columns, relation.types)}
    for name in names:
        if spark_types[name] != duck_types[name]:
            problems.append(f"{name}: {spark_types[name]} against {duck_types[name]}")
    ours = Counter(tuple(_cell(row[n]) for n in names) for row in df.collect())
    order = [relation.columns.index(n) for n in names]
    theirs = Counter(tuple(_cell(row[i]) for i in order) for row in relation.fetchall())
    if ours != theirs:
        problems.append(
            f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours {list((ours - theirs).items())[:3]}, "
            f"only theirs {list((theirs - ours).items())[:3]}"
        )
    return problems
