"""Duplicate rows: keep the first, the last or none of a group.

First and last come out of a rank whose limit is pushed below the shuffle, ``drop_all`` out of a
grouped aggregate: a group that holds a third of the table costs one row per task either way.
Of a large table only the rows that may repeat are shuffled whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.operators.frequency import row_keys
from burnish.operators.typing import ROW_ORDER, data_columns
from burnish.plans import fused
from burnish.plans.repeats import split_repeats


def drop_duplicate_rows(
    df: DataFrame,
    keep: str = "keep_first",
    subset: Sequence[str] | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One row per distinct ``subset`` (all columns without one); NULL equals NULL.

    ``keep`` is ``keep_first``, ``keep_last``, ``drop_all`` (no row of a group of two or
    more) or ``none``. First and last refer to ``order_by``.
    """
    if keep == "none":
        return df
    keys = list(subset or data_columns(df))
    if fused.estimated_bytes(df) <= fused.SMALL_BYTES:
        return _dropped(df, keep, subset, keys, order_by)
    once, others = split_repeats(df, row_keys(df, keys))
    return once.union(_dropped(others, keep, subset, keys, order_by))


def _dropped(
    df: DataFrame, keep: str, subset: Sequence[str] | None, keys: list[str],
    order_by: Sequence[str],
) -> DataFrame:
    if not subset and keep != "drop_all" and ROW_ORDER not in df.columns:
        # Equal rows are interchangeable.
        return df.distinct()
    position = list(order_by) or ([ROW_ORDER] if ROW_ORDER in df.columns else [])
    found = row_keys(df, keys)
    if keep == "drop_all":
        row = F.struct(*[cell(c) for c in df.columns])
        groups = df.groupBy(*found).agg(F.first(row).alias("__row"), F.count("*").alias("__n"))
        return groups.filter(F.col("__n") == 1).select("__row.*")
    last = keep == "keep_last"
    order = [cell(c).desc() if last else cell(c).asc() for c in position] or [F.col("__k0")]
    ranks = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy(*order)
    ranked = df.select("*", *found).withColumn("__rank", F.row_number().over(ranks))
    return ranked.filter(F.col("__rank") == 1).select(*[cell(c) for c in df.columns])
