"""Run queries next to their oracle SQL and compare names, kinds and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from workload.registry import TABLES  # noqa: E402


def canonical(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def kind(value) -> str:
    return type(value).__name__


def oracle_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def as_set(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def difference(spark_df, folder: str, sql: str) -> str | None:
    """None when both sides give the same rows."""
    rows = [tuple(r) for r in spark_df.collect()]
    names, expected = oracle_rows(folder, sql)
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = as_set(spark_df.columns, rows), as_set(names, expected)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ of {len(a)}; first: {wrong[0][0]} != {wrong[0][1]}"
    kinds_a = [{kind(r[i]) for r in a} - {"NoneType"} for i in range(len(names))]
    kinds_b = [{kind(r[i]) for r in b} - {"NoneType"} for i in range(len(names))]
    return None if kinds_a == kinds_b else f"kinds {kinds_a} != {kinds_b}"


def main() -> None:
    from pyspark.sql import SparkSession

    from workload import QUERIES, Tables

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, q in QUERIES.items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            df = q.run(Tables(spark, folder))
            found = difference(df, folder, q.sql) if q.sql else None
            note = "" if q.sql else f" (no oracle, {df.count()} rows)"
        except Exception as e:  # noqa: BLE001
            found, note = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s{note}",
              flush=True)
        if found:
            print("    " + found, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
