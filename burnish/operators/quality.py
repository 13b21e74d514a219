"""Table-level quality: shape, nulls, completeness, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.nulls import NARROW_TOKENS
from burnish.operators.frequency import duplicate_rows
from burnish.operators.typing import data_columns, present
from burnish.plans.fused import small_table

QUALITY_SCHEMA = "rows bigint, cols bigint, nulls bigint, completeness bigint, duplicates bigint"


def null_cells(df: DataFrame) -> DataFrame:
    """``(rows, cols, nulls, completeness)``; completeness is a whole percentage."""
    columns = data_columns(df)
    per_row = sum(
        (F.when(present(df, c, NARROW_TOKENS).isNull(), 1).otherwise(0) for c in columns),
        F.lit(0),
    )
    out = df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias("nulls"),
    )
    cells = F.greatest(F.col("rows") * len(columns), F.lit(1))
    return out.select(
        "rows",
        F.lit(len(columns)).cast("bigint").alias("cols"),
        "nulls",
        F.floor((1 - F.col("nulls") / cells) * 100 + 0.5).cast("bigint").alias("completeness"),
    )


def table_quality(df: DataFrame) -> DataFrame:
    """One row: ``rows, cols, nulls, completeness, duplicates``."""
    shape = null_cells(df).first()
    duplicates = duplicate_rows(df).first()["duplicates"]
    return small_table(df.sparkSession, [(*shape, duplicates)], QUALITY_SCHEMA)


def profile_summary(profile: DataFrame) -> DataFrame:
    """Mean completeness and the number of numeric and text columns of a profile."""
    return profile.agg(
        F.round(F.avg("completeness"), 1).alias("avg_completeness"),
        F.count_if(F.col("type") == "numeric").alias("numeric_columns"),
        F.count_if(F.col("type") == "text").alias("text_columns"),
    )
