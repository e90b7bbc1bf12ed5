"""Run queries in Spark and their SQL in DuckDB and compare every value.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0 if value else 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def normalised(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(df, sql: str, con) -> str:
    """Empty when equal, else what differs."""
    rows = [tuple(r) for r in df.collect()]
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    expected = answer.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(rows) != len(expected):
        return f"rows {len(rows)} != {len(expected)}"
    mine, theirs = normalised(df.columns, rows), normalised(columns, expected)
    if mine != theirs:
        wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return f"{len(wrong)} of {len(mine)} rows differ, {sorted(df.columns)}: {wrong[0]}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    types = {d[0]: str(d[1]) for d in answer.description}
    odd = {c: (kinds[c], types[c]) for c in columns if not _same_kind(kinds[c], types[c])}
    return f"types {odd}" if odd else ""


def _same_kind(spark_type: str, duck_type: str) -> bool:
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    return same.get(spark_type, duck_type) == duck_type


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = duck(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracles:
                verdict = compare(df, oracles[name], con) or "equal"
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as error:  # keep going, report at the end
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        good = verdict == "equal" or verdict.startswith("rows only")
        failed += not good
        print(f"{'ok ' if good else 'BAD'} {name:30} {time.time() - start:6.1f}s {verdict}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
