"""Run registered queries and their SQL on the same tables and report differences.

usage: python tests/check_oracle.py [--plain] [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)) if v is None else "", str(v)) for v in row)


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def compare(spark_df, con, sql: str) -> str | None:
    """None if both give the same rows, else what differs."""
    columns = sorted(spark_df.columns)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} / {sorted(names)}"
    at = [names.index(c) for c in columns]
    expected = [tuple(_plain(r[i]) for i in at) for r in cursor.fetchall()]
    actual = [tuple(_plain(r[c]) for c in columns) for r in spark_df.collect()]
    if len(expected) != len(actual):
        return f"rows {len(actual)} / {len(expected)}"
    for a, e in zip(sorted(actual, key=_key), sorted(expected, key=_key)):
        if a != e:
            return f"{columns}\n   spark {a}\n   sql   {e}"
    types = {c: t for c, t in spark_df.dtypes}
    sql_types = {d[0]: str(d[1]) for d in cursor.description}
    family = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(c, types[c], sql_types[c]) for c in columns if family.get(types[c], "?") != sql_types[c]]
    return f"types {odd}" if odd else None


def main():
    import __spark_entry__ as entry
    from conftest import session

    args = sys.argv[1:]
    if args[:1] == ["--plain"]:  # a session without any settings

        def session():
            from pyspark.sql import SparkSession

            return SparkSession.builder.master("local[8]").getOrCreate()

        args.pop(0)
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = session()
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                problem = compare(df, con, sql[name])
                state = "ok" if problem is None else f"DIFFERENT {problem}"
            else:
                state = f"{len(df.collect())} rows, no SQL"
        except Exception as e:  # report and go on
            state = f"FAILED {type(e).__name__} {str(e).strip()[-700:]}"
        bad += not (state == "ok" or state.endswith("no SQL"))
        print(f"{name:32s} {time.time() - start:6.1f}s {state}", flush=True)
    print("all agree" if not bad else f"{bad} problems")


if __name__ == "__main__":
    main()
