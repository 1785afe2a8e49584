"""Run every registered query beside its SQL and compare the rows.

``python tests/check_queries.py [folder] [name ...]``
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from tablekeep.queries.common import TABLES  # noqa: E402
from tablekeep.session import local_session  # noqa: E402


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return float(value)
    return value


def sorted_rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, folder: str, name: str) -> tuple[bool, str]:
    """Whether a query and its SQL give the same columns and rows."""
    df = contract.queries()[name](spark, folder)
    ours = df.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return len(ours) > 0, f"{len(ours)} rows, no SQL"
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} / {sorted(names)}"
    left, right = sorted_rows(ours, df.columns), sorted_rows(theirs, names)
    if left != right:
        first = next(((a, b) for a, b in zip(left, right) if a != b), None)
        return False, f"{len(left)} / {len(right)} rows; first difference {str(first)[:600]}"
    return True, f"{len(left)} rows"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(contract.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = duck(folder), []
    for name in wanted:
        start = time.time()
        try:
            same, text = compare(spark, connection, folder, name)
        except Exception as error:  # report and go on
            same, text = False, f"{type(error).__name__}: {str(error)[:800]}"
        if not same:
            bad.append(name)
        print(f"{'ok  ' if same else 'BAD '} {name} {time.time() - start:.2f}s {text}", flush=True)
    print(f"{len(wanted) - len(bad)} of {len(wanted)} agree; {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
