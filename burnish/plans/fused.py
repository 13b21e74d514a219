"""Many columns in one job.

Statistics that are the same for every column run on the long form
(``column, value``): one scan, partial aggregation in every task, and one short
generated method however many columns there are. Aggregates that differ from
column to column run as one wide row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from burnish.functions.names import cell

# The generated method of a wide aggregate is compiled to machine code only while
# it is short; wider requests take another scan.
AGG_WIDTH = 60
# Inputs up to this estimate are copied into memory for several passes.
SMALL_BYTES = 256 << 20


def aggregate_row(df: DataFrame, exprs: Mapping[str, Column]) -> dict:
    """Global aggregates by name, one scan for each ``AGG_WIDTH`` of them."""
    names = list(exprs)
    out: dict = {}
    for at in range(0, len(names), AGG_WIDTH):
        part = names[at : at + AGG_WIDTH]
        row = df.agg(*[exprs[n].alias(f"_{i}") for i, n in enumerate(part)]).first()
        out.update({n: row[i] for i, n in enumerate(part)})
    return out


def melt(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """``(column, value)`` with one row per cell; all values of one type."""
    wide = df.select(*[v.alias(c) for c, v in values.items()])
    return wide.unpivot([], [cell(c) for c in values], "column", "value")


def column_aggregates(
    df: DataFrame,
    values: Mapping[str, Column],
    aggregates: Callable[[Column], Mapping[str, Column]],
) -> dict[str, dict]:
    """The same aggregates for every column, in one scan; counts are 0 on an empty table."""
    if not values:
        return {}
    wanted = aggregates(F.col("value"))
    rows = (
        melt(df, values)
        .groupBy("column")
        .agg(*[e.alias(f"_{i}") for i, e in enumerate(wanted.values())])
        .collect()
    )
    found = {r[0]: dict(zip(wanted, r[1:])) for r in rows}
    empty = {k: (0 if k == "n" else None) for k in wanted}
    return {c: found.get(c, dict(empty)) for c in values}


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few driver-side rows as a local relation: no job is needed to read or broadcast it."""
    struct = T.StructType.fromDDL(schema)
    fields = [pa.field(f.name, to_arrow_type(f.dataType), f.nullable) for f in struct]
    columns = [[r[i] for r in rows] for i in range(len(fields))]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=pa.schema(fields)), struct)


def estimated_bytes(df: DataFrame) -> float:
    """The optimizer's size estimate; infinite where there is none. Runs nothing."""
    try:
        return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except (AttributeError, PySparkException):
        return float("inf")


@contextmanager
def working_copy(df: DataFrame) -> Iterator[DataFrame]:
    """For operators of several passes over one input.

    A small input is spread over all cores and cached until the end; a larger one is
    scanned again by every pass, which costs less than copying it.
    """
    if estimated_bytes(df) > SMALL_BYTES:
        yield df
        return
    copy = df.repartition(df.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        yield copy
    finally:
        copy.unpersist()
