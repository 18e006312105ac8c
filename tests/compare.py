"""Run a query in Spark and its SQL in DuckDB over the same tables and compare rows,
column names and types."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{directory}/{t}.parquet'")
    return con


def _kind(t: pa.DataType) -> str:
    return str(t).replace("large_", "")


def difference(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    names = sorted(spark_table.column_names)
    if names != sorted(duck_table.column_names):
        return f"columns {names} <> {sorted(duck_table.column_names)}"
    for n in names:
        a, b = _kind(spark_table.schema.field(n).type), _kind(duck_table.schema.field(n).type)
        if a != b:
            return f"type of {n}: {a} <> {b}"
    left = Counter(zip(*[spark_table.column(n).to_pylist() for n in names]))
    right = Counter(zip(*[duck_table.column(n).to_pylist() for n in names]))
    if left != right:
        only_left, only_right = left - right, right - left
        return (f"rows {spark_table.num_rows} / {duck_table.num_rows}, only spark {sum(only_left.values())}: "
                f"{list(only_left)[:2]}, only sql {sum(only_right.values())}: {list(only_right)[:2]} ({names})")
    return None


def run(spark, directory: str, name: str, plan, sql: str | None, con) -> tuple[str | None, int, float]:
    started = time.time()
    result = plan(spark, directory).toArrow()
    seconds = time.time() - started
    if sql is None:
        return None, result.num_rows, seconds
    return difference(result, con.sql(sql).to_arrow_table()), result.num_rows, seconds


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tradeframe.session import local_session

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, checks, bad = duck(directory), oracle_sql(), 0
    for name, plan in queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            diff, rows, seconds = run(spark, directory, name, plan, checks.get(name), con)
        except Exception as e:  # noqa: BLE001 - reported, counted as failure
            diff, rows, seconds = f"ERROR {type(e).__name__}: {str(e)[:600]}", -1, 0.0
        bad += diff is not None
        mark = "FAIL" if diff else ("ok" if name in checks else "rows")
        print(f"{mark:4} {name:36} rows={rows:<7} {seconds:6.2f}s {diff or ''}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
