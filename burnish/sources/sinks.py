"""Write tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.operators.column_stats import column_stats
from burnish.operators.compare import compare_columns, compare_shape
from burnish.operators.typing import data_columns


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[cell(c) for c in data_columns(df)])


def write_csv(df: DataFrame, path: str) -> None:
    """Header, every cell quoted, quotes doubled, NULL as the empty text."""
    _plain(df).write.mode("overwrite").options(
        header=True, quoteAll=True, quote='"', escape='"', nullValue="", emptyValue=""
    ).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object per line; NULL keys are kept."""
    _plain(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def profile_report(df: DataFrame) -> DataFrame:
    """One row per column: kind, filled cells, nulls, distinct values, numeric summary."""
    stats = column_stats(df, fold_case=False)
    return stats.select(
        "column",
        "type",
        "non_null",
        "null_pct",
        "unique",
        "min",
        "max",
        F.round("mean", 4).alias("mean"),
        "median",
        F.round("std", 4).alias("std"),
        "outliers",
    )


def write_profile_report(df: DataFrame, path: str) -> None:
    write_csv(profile_report(df).coalesce(1), path)


def compare_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(item, value)``: the shapes of two tables and the columns that only one has."""
    shape = compare_shape(a, b)
    shapes = shape.selectExpr(
        "stack(2, 'A', concat(rows_a, ' rows x ', cols_a, ' cols'), "
        "'B', concat(rows_b, ' rows x ', cols_b, ' cols')) AS (item, value)"
    )
    sides = compare_columns(a, b)
    only = sides.filter(F.col("side") != "shared").select(F.col("side").alias("item"),
                                                          F.col("column").alias("value"))
    return shapes.union(only)


def write_compare_report(a: DataFrame, b: DataFrame, path: str) -> None:
    write_csv(compare_report(a, b).coalesce(1), path)
