"""Runs registered queries and their SQL side by side: python tools/compare.py [sf_dir] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    text = frame.map(lambda v: str(list(v)) if isinstance(v, np.ndarray) else str(v))
    return text.sort_values(list(text.columns), ignore_index=True)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None when equal, else what differs first."""
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    if kinds(mine) != kinds(theirs):
        return f"types {mine.dtypes.to_dict()} != {theirs.dtypes.to_dict()}"
    a, b = canonical(mine), canonical(theirs)
    if not a.equals(b):
        rows = (a != b).any(axis=1)
        return f"values differ in {rows.sum()} rows\n{a[rows].head(3).to_string()}\n{b[rows].head(3).to_string()}"
    return None


def main() -> int:
    from tidegauge.session import build_session
    from workload.registered import ORACLE, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = connect(sf_dir), []
    for name in names:
        started = time.time()
        try:
            mine = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - started
            if name in ORACLE:
                problem = difference(mine, connection.execute(ORACLE[name]).df())
                state = "ok" if problem is None else problem
            else:
                state = f"rows only ({len(mine)})"
        except Exception as error:  # noqa: BLE001 - the tool reports every failure and goes on
            took, state = time.time() - started, f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        if not state.startswith(("ok", "rows only")):
            failed.append(name)
        print(f"{name:32s} {took:6.2f}s {state}", flush=True)
    print(f"{len(names)} queries, {len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
