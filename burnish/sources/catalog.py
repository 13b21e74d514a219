"""Named tables: register, replace, drop, persist, list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.operators.quality import table_quality
from burnish.sources.delimited import table_name


def register(df: DataFrame, name: str) -> str:
    """Add or replace a table of the session; returns its safe name."""
    safe = table_name(name)
    df.createOrReplaceTempView(safe)
    return safe


def drop(spark: SparkSession, name: str) -> None:
    """Forget a table, session-wide and stored."""
    safe = table_name(name)
    spark.catalog.dropTempView(safe)
    spark.sql(f"DROP TABLE IF EXISTS `{safe}`")


def save(df: DataFrame, name: str) -> str:
    """Store a table durably under its safe name."""
    safe = table_name(name)
    df.write.mode("overwrite").saveAsTable(safe)
    return safe


def save_cleaned(df: DataFrame, source: str) -> str:
    return register(df, f"{source}_cleaned")


def save_anomalies(df: DataFrame, source: str) -> str:
    return register(df, f"{source}_anomaly_flags")


def names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def list_tables(spark: SparkSession, only: list[str] | None = None) -> DataFrame:
    """``(table, rows, cols, nulls, completeness, duplicates)`` of every named table."""
    rows = [
        table_quality(spark.table(n)).select(F.lit(n).alias("table"), "*")
        for n in (only or names(spark))
    ]
    if not rows:
        raise ValueError("no tables")
    return reduce(DataFrame.unionByName, rows)
