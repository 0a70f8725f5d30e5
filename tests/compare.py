"""Run every query next to its SQL in DuckDB: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


# Spark type -> DuckDB type, as the two must agree on the schema too.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def check(spark, con, name, query, sql, sf_dir):
    """None when result and schema agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    if sorted(rel.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(rel.columns)}"
    want_types = dict(zip(rel.columns, map(str, rel.types)))
    types = [f"{c}: {k} <> {want_types[c]}" for c, k in df.dtypes
             if TYPES.get(k, k) != want_types[c]]
    want = rows_of(rel.columns, rel.fetchall())
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows <> {len(want)}; only here {extra}; only there {missing}"
    return f"types {types}" if types else None


def main() -> int:
    import __spark_entry__ as contract
    from topicloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = build_session(), connect(sf_dir)
    queries, oracles = contract.queries(), contract.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = check(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '}{name} {time.time() - start:.2f}s {problem or ''}",
              flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
