"""Relational shapes whose direct SQL form would gather rows in one place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.names import cell

def over_groups(
    df: DataFrame, aggregates: Mapping[str, Column], partition_by: Sequence[str] = ()
) -> DataFrame:
    """``aggregate OVER (PARTITION BY ...)`` added as columns, NULL keys forming a group.

    A window brings all rows of a group (of the table, without keys) into one task. Here
    the aggregate is combined in every task before the shuffle and joined back, and
    adaptive execution broadcasts the groups or splits a hot key as their size asks.
    """
    sums = [a.alias(n) for n, a in aggregates.items()]
    if not partition_by:
        totals = df.agg(*sums)
        row = totals.first()
        types = {f.name: f.dataType for f in totals.schema}
        return df.withColumns({n: F.lit(row[n]).cast(types[n]) for n in aggregates})
    keys = [cell(c).alias(f"__k{i}") for i, c in enumerate(partition_by)]
    groups = df.groupBy(*keys).agg(*sums)
    same = [cell(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(partition_by)]
    return df.join(groups, reduce(and_, same), "left").drop(
        *[f"__k{i}" for i in range(len(partition_by))]
    )


def keep_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``column IN (values)``; ``values`` has one column."""
    wanted = values.toDF("__v").distinct()
    return df.join(wanted, cell(column) == F.col("__v"), "left_semi")


def keep_not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``column NOT IN (values)``: nothing when a value is NULL, all rows when there are none.

    The direct form broadcasts the values whatever their number; this one is an ordinary
    anti-join, with the NULL rules settled by counts.
    """
    unwanted = values.toDF("__v")
    rows, nulls = unwanted.agg(F.count("*"), F.count_if(F.col("__v").isNull())).first()
    if not rows:
        return df
    if nulls:
        return df.limit(0)
    kept = df.filter(cell(column).isNotNull())
    return kept.join(unwanted.distinct(), cell(column) == F.col("__v"), "left_anti")
