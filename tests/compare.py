"""Compare a Spark result with a DuckDB result: names, rows and values, order aside."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return v if v is None else str(v)


def normalised(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
         "BOOLEAN": "boolean", "DATE": "date"}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs; empty when the two results are the same."""
    out = []
    rel = con.sql(sql)
    spark_types = {c.lower(): t for c, t in df.dtypes}
    duck_types = {c.lower(): KINDS.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    if set(spark_types) != set(duck_types):
        return [f"columns {sorted(spark_types)} != {sorted(duck_types)}"]
    out += [f"type of {c}: {t} != {duck_types[c]}" for c, t in spark_types.items() if t != duck_types[c]]
    ours = normalised([c.lower() for c in df.columns], [tuple(r) for r in df.collect()])
    theirs = normalised([c.lower() for c in rel.columns], rel.fetchall())
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} != {len(theirs)}")
    elif ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    return out
