"""Compare every query with its SQL: `python tests/check_oracle.py FOLDER [NAME ...]`."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


KINDS = {
    "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
    "int": "INTEGER", "timestamp": "TIMESTAMP",
}


def plain(row: tuple) -> tuple:
    return tuple(
        (v is not None, "nan" if isinstance(v, float) and math.isnan(v) else str(v)) for v in row
    )


def difference(spark_frame, connection, sql: str) -> str | None:
    """What differs, or None."""
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    kinds = {d[0]: str(d[1]) for d in relation.description}
    theirs = relation.fetchall()
    if sorted(names) != sorted(spark_frame.columns):
        return f"columns {sorted(names)} != {sorted(spark_frame.columns)}"
    for name, kind in spark_frame.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    ours = sorted(plain(tuple(r)) for r in spark_frame.select(*names).collect())
    theirs = sorted(plain(r) for r in theirs)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"first difference:\n  {a}\n  {b}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracle, bad = database(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = query(spark, folder)
            found = difference(frame, connection, oracle[name]) if name in oracle else None
            count = "" if name in oracle else " (no SQL)"
        except Exception as error:
            found, count = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += found is not None
        print(f"{name:25s}{'ok' if found is None else 'BAD ' + found}{count} {time.time() - start:.1f}s",
              flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
