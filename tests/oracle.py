"""Compare a catalogue query with its SQL on DuckDB, strictly by name, type and value."""

from __future__ import annotations

import duckdb
import pandas as pd
import pyarrow as pa

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t):
        return "string"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{_kind(t.value_type)}>"
    return str(t)


def _rows(table: pa.Table) -> pd.DataFrame:
    df = table.select(sorted(table.column_names)).to_pandas()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: tuple(v) if hasattr(v, "tolist") else v)
    keys = df.map(lambda v: "" if v is None or v != v else repr(v + 0.0 if isinstance(v, float) else v))
    order = keys.sort_values(list(keys.columns)).index
    return keys.loc[order].reset_index(drop=True)


def compare(spark_table: pa.Table, oracle_table: pa.Table) -> list[str]:
    """Problems found; empty when equal."""
    a, b = sorted(spark_table.column_names), sorted(oracle_table.column_names)
    if a != b:
        return [f"columns {a} != {b}"]
    problems = []
    for c in a:
        x, y = _kind(spark_table.schema.field(c).type), _kind(oracle_table.schema.field(c).type)
        if x != y:
            problems.append(f"type of {c}: spark {x}, oracle {y}")
    if spark_table.num_rows != oracle_table.num_rows:
        return problems + [f"rows {spark_table.num_rows} != {oracle_table.num_rows}"]
    left, right = _rows(spark_table), _rows(oracle_table)
    if not left.equals(right):
        wrong = (left != right).any(axis=1)
        at = wrong.idxmax()
        problems.append(f"{int(wrong.sum())} rows differ, first: {left.loc[at].to_dict()} != {right.loc[at].to_dict()}")
    return problems
