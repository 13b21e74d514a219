"""Series behind a chart: grouped, raw and scatter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.operators.typing import data_columns, number, numeric_by_sample
from burnish.plans.fused import small_table
from burnish.plans.ordered import value_at_rank

DEFAULT_GROUPS = 50
AUTODETECT_ROWS = 20


def _label(x: str) -> Column:
    return F.coalesce(cell(x).cast("string"), F.lit(""))


def _aggregate(agg: str) -> Column:
    y = F.col("y")
    or_zero = {"avg": F.round(F.avg(y), 4), "min": F.min(y), "max": F.max(y)}
    if agg == "sum":
        return F.round(F.coalesce(F.sum(y), F.lit(0.0)), 4)
    if agg == "count":
        return F.count(y)
    if agg in or_zero:
        return F.coalesce(or_zero[agg], F.lit(0.0))
    raise ValueError(f"unknown aggregate {agg!r}")


def group_medians(points: DataFrame) -> DataFrame:
    """``(label, value)`` of ``(label, y)``: the upper-middle element of each group."""
    frequencies = (
        points.filter(F.col("y").isNotNull()).groupBy("label", "y").agg(F.count("*").alias("n"))
    )
    middle = F.floor(F.col("__total") / 2) + 1
    return value_at_rank(frequencies, "label", "y", "n", middle).withColumnRenamed("y", "value")


def chart_series(
    df: DataFrame,
    x: str,
    y: str,
    agg: str = "sum",
    sort: str = "none",
    max_groups: int = DEFAULT_GROUPS,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """``(label, value)`` of the first ``max_groups`` groups.

    ``sort`` is ``asc`` or ``desc`` by the group's sum, whatever ``agg`` is; ``none`` keeps
    the order in which groups appear in ``order_by`` (by label without one).
    """
    by_place = sort == "none" and order_by
    place = [cell(c) for c in order_by]
    points = df.select(
        _label(x).alias("label"),
        number(df, y, prefix=True).alias("y"),
        *([(place[0] if len(place) == 1 else F.struct(*place)).alias("at")] if by_place else []),
    )
    median = agg == "median"
    # Rounded, so that equal sums are not ordered by the noise of summation.
    keys = {
        "asc": F.round(F.coalesce(F.sum("y"), F.lit(0.0)), 4),
        "none": F.min("at") if by_place else None,
    }
    key = keys["asc" if sort in ("asc", "desc") else sort]
    groups = points.groupBy("label").agg(
        F.lit(0).alias("present"),
        *([] if key is None else [key.alias("key")]),
        *([] if median else [_aggregate(agg).alias("value")]),
    )
    order = [] if key is None else [F.desc("key") if sort == "desc" else F.asc("key")]
    shown = groups.orderBy(*order, "label").limit(max_groups)
    if not median:
        return shown.select("label", "value")
    # At most max_groups labels, here and on the broadcast sides.
    picked = [(r["label"],) for r in shown.select("label").collect()]
    labels = small_table(df.sparkSession, picked, "label string")
    medians = group_medians(points.join(F.broadcast(labels), "label", "left_semi"))
    return labels.join(F.broadcast(medians), "label", "left").select(
        "label", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def raw_series(
    df: DataFrame, x: str, y: str, max_rows: int = DEFAULT_GROUPS, order_by: Sequence[str] = ()
) -> DataFrame:
    """``(label, value)`` of the first rows; what is not a number counts as 0."""
    head = df.orderBy(*[cell(c) for c in order_by]).limit(max_rows)
    return head.select(
        _label(x).alias("label"),
        F.coalesce(number(df, y, prefix=True), F.lit(0.0)).alias("value"),
    )


def scatter_series(
    df: DataFrame, x: str, y: str, max_rows: int = DEFAULT_GROUPS, order_by: Sequence[str] = ()
) -> DataFrame:
    """``(x, y)`` of the first rows; what is not a number counts as 0."""
    head = df.orderBy(*[cell(c) for c in order_by]).limit(max_rows)
    return head.select(
        *[
            F.coalesce(number(df, c, prefix=True), F.lit(0.0)).alias(name)
            for c, name in ((x, "x"), (y, "y"))
        ]
    )


def detect_axes(
    df: DataFrame, order_by: Sequence[str] = (), hint: str | None = None
) -> tuple[str | None, str | None]:
    """X is the first column that is not the first numeric one; Y is ``hint`` or that one."""
    numeric = numeric_by_sample(df, AUTODETECT_ROWS, order_by, need_values=False)
    columns = data_columns(df)
    y = next((c for c in columns if numeric[c]), None)
    return next((c for c in columns if c != y), None), hint or y


def running_share(df: DataFrame, key: str, share: str, out: str) -> DataFrame:
    """Running total over a table of a few rows, such as one row per component."""
    order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(share).over(order))
