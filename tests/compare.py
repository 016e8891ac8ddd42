"""Runs a query in Spark and its SQL in DuckDB and compares names, types and all rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pyarrow as pa
import pyarrow.compute as pc


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(table: pa.Table) -> pa.Table:
    """Columns by name, rows by all columns, and one spelling for equal types."""
    columns = {}
    for name in sorted(table.column_names):
        column = table[name].combine_chunks()
        if pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        columns[name] = column
    plain = pa.table(columns)
    return plain.take(pc.sort_indices(plain, [(n, "ascending") for n in plain.column_names]))


def same(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    """None when both hold the same rows, else what differs."""
    a, b = _plain(spark_table), _plain(duck_table)
    types = [(n, str(t)) for n, t in zip(a.schema.names, a.schema.types)]
    others = [(n, str(t)) for n, t in zip(b.schema.names, b.schema.types)]
    if types != others:
        return f"columns differ: {[t for t in types if t not in others]} / {[t for t in others if t not in types]}"
    if a.num_rows != b.num_rows:
        return f"{a.num_rows} rows / {b.num_rows} rows"
    if not a.equals(b):
        wrong = [n for n in a.column_names if not a[n].equals(b[n])]
        rows = [i for i in range(a.num_rows) if a.slice(i, 1).to_pylist() != b.slice(i, 1).to_pylist()][:2]
        return f"values differ in {wrong}: " + "; ".join(f"{a.slice(i, 1).to_pylist()} / {b.slice(i, 1).to_pylist()}" for i in rows)
    return None
