"""Ordered work spread over ranges instead of one global window.

Rows are range-partitioned by the full sort key and the range number is written
down (checkpoint), so that every later pass sees the same ranges. A key with
very many rows spans several ranges; what its earlier ranges contribute is
carried over on a table of at most two rows per range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.plans.materialize import materialize

RANGE, TIE = "__range", "__tie"
ROWS_PER_RANGE = 1_000_000
# More rows make larger ranges, not more of them.
MOST_RANGES = 20_000


def into_ranges(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Range-partition by ``keys`` and record each row's range in ``__range``."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(cores, min(MOST_RANGES, math.ceil(df.count() / ROWS_PER_RANGE)))
    ranged = df.repartitionByRange(n, *keys).withColumn(RANGE, F.spark_partition_id())
    return materialize(ranged)


def fill_ordered(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    backward: bool = False,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Replace NULLs by the nearest earlier (``backward``: later) non-null value."""
    columns = [c for c in columns if c not in order_by and c not in partition_by]
    if not columns:
        return df
    ties = df.withColumn(TIE, F.monotonically_increasing_id())
    sort_key = [cell(c) for c in (*partition_by, *order_by)] + [F.col(TIE)]
    rows = into_ranges(ties, sort_key)

    group = [cell(c) for c in partition_by]
    position = F.struct(*[cell(c) for c in order_by], F.col(TIE))
    # The value that a later (backward: earlier) range takes over from this one.
    pick = F.min_by if backward else F.max_by
    near = {
        c: pick(cell(c), F.when(cell(c).isNotNull(), position)).alias(f"__c{i}")
        for i, c in enumerate(columns)
    }
    keyed = rows.withColumn("__key", F.struct(F.lit(0).alias("_"), *group))
    # Only the first and the last key of a range can continue in another range.
    edges = keyed.groupBy(RANGE).agg(
        F.min("__key").alias("__first"), F.max("__key").alias("__last")
    )
    at_edge = (F.col("__key") == F.col("__first")) | (F.col("__key") == F.col("__last"))
    spanning = (
        keyed.join(edges, RANGE)
        .filter(at_edge)
        .groupBy(RANGE, "__key")
        .agg(*near.values())
    )
    towards = F.desc(RANGE) if backward else F.asc(RANGE)
    before = (
        Window.partitionBy("__key").orderBy(towards).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = spanning.select(
        RANGE,
        "__key",
        *[F.last(f"__c{i}", ignorenulls=True).over(before).alias(f"__p{i}")
          for i in range(len(columns))],
    )
    # A running frame in the direction of the fill: one up to the end of the group would be
    # evaluated anew for every row.
    place = [*[cell(c) for c in order_by], F.col(TIE)]
    walk = [c.desc() if backward else c.asc() for c in place]
    local = (
        Window.partitionBy(RANGE, "__key").orderBy(*walk)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = keyed.join(carried, [RANGE, "__key"], "left")
    filled = {
        c: F.coalesce(F.last(cell(c), ignorenulls=True).over(local), F.col(f"__p{i}"))
        for i, c in enumerate(columns)
    }
    return joined.select(
        *[filled[c].alias(c) if c in filled else cell(c) for c in df.columns]
    )


def value_at_rank(
    frequencies: DataFrame, key: str, value: str, count: str, rank: Column
) -> DataFrame:
    """``(key, value)``: the value at a 1-based rank within each key.

    ``frequencies`` holds one row per ``(key, value)``; ``rank`` may use ``__total``, the
    key's number of values.
    """
    rows = into_ranges(frequencies, [F.col(key), F.col(value)])
    parts = rows.groupBy(RANGE, key).agg(F.sum(count).alias("__n"))
    earlier = (
        Window.partitionBy(key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = parts.select(
        RANGE,
        key,
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"),
        F.sum("__n").over(Window.partitionBy(key)).alias("__total"),
    ).withColumn("__rank", rank)
    local = (
        Window.partitionBy(RANGE, key).orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    running = rows.withColumn("__upto", F.sum(count).over(local))
    upto = F.col("__offset") + F.col("__upto")
    return (
        running.join(offsets, [RANGE, key])
        .filter((F.col("__rank") <= upto) & (F.col("__rank") > upto - F.col(count)))
        .select(key, value)
    )
