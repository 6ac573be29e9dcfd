"""Run queries against their SQL twins on the same files.

``python tests/compare.py <folder> [names...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

# Spark type -> DuckDB type of a column that may appear in a result.
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
}


def session(threads: int = 4) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{threads}]")
        .appName("basketrank-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _sorted_rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    out = []
    for row in frame[columns].itertuples(index=False, name=None):
        out.append(tuple("null" if pd.isna(v) else repr(v) for v in row))
    return sorted(out)


def differences(result: DataFrame, con, text: str) -> list[str]:
    """What differs between a Spark result and a twin; empty when nothing does."""
    relation = con.sql(text)
    want_types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    got_types = {n: TYPES.get(t, t) for n, t in result.dtypes}
    found = []
    if got_types != want_types:
        odd = {
            n: (got_types.get(n), want_types.get(n))
            for n in got_types.keys() | want_types.keys()
            if got_types.get(n) != want_types.get(n)
        }
        found.append(f"types (spark, twin): {odd}")
    got, want = result.toPandas(), con.execute(text).df()
    if len(got) != len(want):
        found.append(f"rows: {len(got)} and {len(want)}")
    if sorted(got.columns) == sorted(want.columns):
        # One dtype per column on both sides before values become text.
        for c in got.columns:
            if got[c].dtype != want[c].dtype:
                kind = "float64" if "f" in (got[c].dtype.kind, want[c].dtype.kind) else "object"
                if "datetime" in str(got[c].dtype) or "datetime" in str(want[c].dtype):
                    kind = "datetime64[us]"
                got[c], want[c] = got[c].astype(kind), want[c].astype(kind)
        a, b = _sorted_rows(got), _sorted_rows(want)
        if a != b:
            wrong = [(x, y) for x, y in zip(a, b) if x != y]
            found.append(f"{len(wrong)} values, first {wrong[:1]}")
    return found


def main(folder: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    spark, con = session(8), database(folder)
    failed = 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracle_sql():
                found = differences(query(spark, folder), con, oracle_sql()[name])
                state = "same" if not found else "DIFFERENT " + "; ".join(found)
            else:
                state = f"rows only: {query(spark, folder).count()}"
        except Exception as error:
            state = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        failed += state.startswith(("DIFF", "ERR"))
        print(f"{name:28s} {time.time() - start:6.1f}s {state}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
