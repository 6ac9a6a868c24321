"""Compare every registered query with its SQL: python tests/oracle_check.py SF_DIR [names]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def normalized(frame: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return None
        if isinstance(value, pd.Timestamp):
            return value.isoformat()
        if isinstance(value, float):
            return float(value)
        return value

    columns = sorted(frame.columns)
    cells = frame[columns].astype(object).itertuples(index=False)
    return sorted((tuple(cell(v) for v in row) for row in cells), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def difference(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} != {sorted(expected.columns)}"
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    kinds = {
        c: (actual[c].dtype.kind, expected[c].dtype.kind)
        for c in actual.columns
        if {actual[c].dtype.kind, expected[c].dtype.kind} in ({"i", "f"}, {"i", "O"}, {"M", "O"})
    }
    if kinds and len(actual):
        return f"types {kinds}"
    for i, (a, b) in enumerate(zip(normalized(actual), normalized(expected))):
        if a != b:
            return f"row {i}:\n  {a}\n  {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from dockpulse import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "oracle-check",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        started = time.time()
        try:
            actual = queries[name](spark, sf_dir).toPandas()
            spent = time.time() - started
            problem = difference(actual, con.execute(sql[name]).df()) if name in sql else None
        except Exception as error:  # report and go on with the next query
            problem, spent, actual = f"{type(error).__name__}: {str(error)[:1500]}", 0.0, []
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {len(actual)} rows {spent:.2f}s {problem or ''}", flush=True)
    print(f"{bad} differ")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
