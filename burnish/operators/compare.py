"""Two tables side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.functions.nulls import NARROW_TOKENS
from burnish.operators.grid import preview
from burnish.operators.typing import data_columns, number, present
from burnish.plans.fused import column_aggregates, small_table


def compare_shape(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: row and column counts of both and their differences, shared and own columns."""
    in_a, in_b = data_columns(a), data_columns(b)
    rows_a, rows_b, cols_a, cols_b = a.count(), b.count(), len(in_a), len(in_b)
    shared = sum(c in in_b for c in in_a)
    row = (rows_a, rows_b, rows_a - rows_b, cols_a, cols_b, cols_a - cols_b, shared,
           cols_a - shared, cols_b - shared)
    names = ("rows_a rows_b row_delta cols_a cols_b col_delta shared_columns only_a only_b").split()
    return small_table(a.sparkSession, [row], ", ".join(f"{n} bigint" for n in names))


def compare_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(column, side)``: where each column occurs: ``shared``, ``only_a`` or ``only_b``."""
    in_a, in_b = data_columns(a), data_columns(b)
    sides = [(c, "shared" if c in in_b else "only_a") for c in in_a]
    sides += [(c, "only_b") for c in in_b if c not in in_a]
    return small_table(a.sparkSession, sides, "column string, side string")


def _null_and_mean(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    rows = df.count()
    shown = {c: present(df, c, NARROW_TOKENS) for c in columns}
    filled = column_aggregates(
        df, {c: v.isNotNull() for c, v in shown.items()}, lambda v: {"n": F.count_if(v)}
    )
    means = column_aggregates(
        df,
        {c: F.when(v.isNotNull(), number(df, c, prefix=True)) for c, v in shown.items()},
        lambda x: {"mean": F.avg(x)},
    )
    out = {}
    for c in columns:
        nulls = rows - filled[c]["n"]
        mean = means[c]["mean"]
        out[c] = (
            int(nulls / rows * 100 + 0.5) if rows else None,
            None if mean is None else round(mean, 4),
        )
    return out


def compare_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Null percentage and mean of every shared column in both tables, and the mean's change."""
    shared = [c for c in data_columns(a) if c in data_columns(b)]
    of_a, of_b = _null_and_mean(a, shared), _null_and_mean(b, shared)
    rows = []
    for c in shared:
        (null_a, mean_a), (null_b, mean_b) = of_a[c], of_b[c]
        known = mean_a is not None and mean_b is not None
        delta = round(mean_a - mean_b, 4) if known else None
        rows.append((c, null_a, null_b, mean_a, mean_b, delta))
    return small_table(
        a.sparkSession,
        rows,
        "column string, null_pct_a bigint, null_pct_b bigint, mean_a double, mean_b double, "
        "mean_delta double",
    )


def compare_first_rows(
    a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str], rows: int = 10
) -> DataFrame:
    """``(row, a, b)``: the first rows of both tables side by side, each as a struct.

    A side is null where its table has fewer rows.
    """

    def numbered(df: DataFrame, order: Sequence[str], side: str) -> DataFrame:
        # at most ``rows`` rows are left to number
        head = preview(df, rows, order)
        place = F.row_number().over(Window.orderBy(*[cell(c) for c in order]))
        return head.select(
            place.alias("row"), F.struct(*[cell(c) for c in data_columns(head)]).alias(side)
        )

    return numbered(a, order_a, "a").join(numbered(b, order_b, "b"), "row", "full")
