"""Ad-hoc SQL over the registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burnish.sources.catalog import register, save

PREVIEW_ROWS = 50


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """Any query; the result feeds every other operator."""
    return spark.sql(text)


def quick_preview(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).limit(PREVIEW_ROWS)


def save_result(result: DataFrame, name: str, durable: bool = False) -> str:
    """Name a query result: a view of the session, or a stored table."""
    return save(result, name) if durable else register(result, name)
