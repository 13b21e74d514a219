"""Queries over the given tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class Tables:
    """The given tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A query that names tables in braces, such as ``FROM {events}``."""
        used = {n: self(n) for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


@dataclass(frozen=True)
class Query:
    ids: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def plain(text: str) -> str:
    """The same query for an engine where the tables are views."""
    for n in TABLES:
        text = text.replace("{" + n + "}", n)
    return text


def query(name: str, ids: str, sql: str | None = None):

    def add(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(ids, run, plain(sql) if sql else None)
        return run

    return add


def same_sql(name: str, ids: str, sql: str) -> None:
    """A query whose text is the same on both sides."""
    query(name, ids, sql)(lambda t: t.sql(sql))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round floating columns: the order of summation differs between engines."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else F.col(f.name)
            for f in df.schema
        ]
    )
