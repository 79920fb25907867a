"""Side-by-side runs of registered queries in Spark and DuckDB."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _key(row: tuple):
    return tuple((value is None, str(type(value)) if value is None else "", _plain(value)) for value in row)


def _plain(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    return str(value)


def compare(spark, connection, folder: str, build, sql: str) -> list[str]:
    """Differences between the two results; empty when they agree."""
    df = build(spark, folder)
    names = sorted(df.columns)
    mine = [tuple(row[name] for name in names) for row in df.collect()]
    cursor = connection.execute(sql)
    theirs_names = [column[0] for column in cursor.description]
    if sorted(theirs_names) != names:
        return [f"columns {names} against {sorted(theirs_names)}"]
    places = [theirs_names.index(name) for name in names]
    theirs = [tuple(row[place] for place in places) for row in cursor.fetchall()]
    if len(mine) != len(theirs):
        return [f"{len(mine)} rows against {len(theirs)}"]
    problems = []
    for left, right in zip(sorted(mine, key=_key), sorted(theirs, key=_key)):
        for name, a, b in zip(names, left, right):
            same = a == b or (
                isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
            )
            if not same or (isinstance(a, float) != isinstance(b, float) and a is not None):
                problems.append(f"{name}: {a!r} against {b!r} in {left} / {right}")
        if len(problems) > 3:
            break
    return problems


def run_all(spark, folder: str, queries: dict, oracles: dict, only: list[str] | None = None) -> dict[str, list[str]]:
    connection = connect(folder)
    failed = {}
    for name, build in queries.items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            problems = compare(spark, connection, folder, build, oracles[name]) if name in oracles else []
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{name:32s} {time.time() - started:6.2f}s {'ok' if not problems else problems[:2]}", flush=True)
        if problems:
            failed[name] = problems
    return failed
