"""Run registered queries in Spark and their SQL in DuckDB and compare rows.

    python -m tests.oracle_check /root/testdata/sf0.01 [query…]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np

import __spark_entry__ as contract


def _plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (np.generic,)):
        value = value.item()
    if isinstance(value, float):
        return None if value != value else value
    return value


def _key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float", "bool")), v if v is not None else 0) for v in row)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(rows, key=_key)


def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def compare(spark, con, folder, name, close=0.0):
    """(ok, message) of one query."""
    df = contract.queries()[name](spark, folder)
    spark_columns, spark_rows = rows_of(df.columns, df.collect())
    cursor = con.execute(contract.oracle_sql()[name])
    duck_columns, duck_rows = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if spark_columns != duck_columns:
        return False, f"columns {spark_columns} / {duck_columns}"
    if len(spark_rows) != len(duck_rows):
        return False, f"rows {len(spark_rows)} / {len(duck_rows)}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return False, f"{a} / {b}"
    return True, f"{len(spark_rows)} rows"


def main():
    from tests.conftest import make_session

    folder, only = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), duck(folder)
    names = only or [n for n in contract.queries() if n in contract.oracle_sql()]
    bad = []
    for name in names:
        start = time.time()
        try:
            ok, message = compare(spark, con, folder, name)
        except Exception as error:  # report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:30s} {time.time() - start:6.2f}s {message[:700]}", flush=True)
        bad += [] if ok else [name]
    print("without SQL:", sorted(set(contract.queries()) - set(contract.oracle_sql())))
    print("failed:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
