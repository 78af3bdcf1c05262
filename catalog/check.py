"""Runs every query next to its SQL and compares the rows: ``python -m catalog.check SF_DIR [NAME ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

import catalog
from coverlens.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value) if isinstance(value, float) else value


def canonical(names, records):
    """Rows in a fixed column and row order, comparable across engines."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in records]
    return [names[i] for i in order], sorted(rows, key=repr)


SPARK_TYPE = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def difference(df, con, sql) -> str | None:
    """None if both sides agree, else what differs."""
    names, rows = canonical(df.columns, df.collect())
    result = con.execute(sql)
    expected_names, expected = canonical([d[0] for d in result.description], result.fetchall())
    if names != expected_names:
        return f"columns {names} instead of {expected_names}"
    types, expected_types = dict(df.dtypes), {d[0]: SPARK_TYPE.get(str(d[1]), str(d[1])) for d in result.description}
    if types != expected_types:
        return f"types {types} instead of {expected_types}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows instead of {len(expected)}"
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main(sf: str, only: list[str]) -> int:
    spark, con, sql = local_session("coverlens-check"), connect(sf), catalog.oracle_sql()
    failed = 0
    for name, query in catalog.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            problem = difference(df, con, sql[name]) if name in sql else None
            note = "same rows" if name in sql else f"{df.count()} rows, no SQL"
        except Exception as error:
            problem = f"{type(error).__name__}: {error}"[:1500]
        failed += problem is not None
        print(f"{name:34s} {time.time() - start:6.2f}s  {problem or note}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
