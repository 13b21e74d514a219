"""Quick column statistics in the grid's convention.

Narrow null tokens, prefix-parsed numbers, population deviation, quartiles taken at
``floor(n * q)`` without interpolation, case-insensitive distinct count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.functions.nulls import NARROW_TOKENS
from burnish.operators.frequency import cell_counts, distinct_counts, keep_top, ranked_values
from burnish.operators.histogram import Bins, histogram
from burnish.operators.outliers import count_outside
from burnish.operators.typing import PROFILE_SHARE, data_columns, is_text, number, present
from burnish.plans.fused import column_aggregates, small_table, working_copy
from burnish.plans.quantiles import exact_quantiles

STATS_SCHEMA = """
    column string, type string, total bigint, non_null bigint, nulls bigint, null_pct bigint,
    unique bigint, min double, max double, mean double, median double, std double,
    q1 double, q3 double, outliers bigint, sum double, skew double, mode string
"""
PREFIX = 20
TOP = 8


def _percent(part: int, whole: int) -> int | None:
    return int(part / whole * 100 + 0.5) if whole else None


def _filled(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    return {c: present(df, c, NARROW_TOKENS) for c in columns}


def _numbers(df: DataFrame, filled: dict[str, Column]) -> dict[str, Column]:
    return {c: F.when(v.isNotNull(), number(df, c, prefix=True)) for c, v in filled.items()}


def _moments(x: Column) -> dict[str, Column]:
    return {
        "n": F.count(x),
        "min": F.min(x),
        "max": F.max(x),
        "mean": F.avg(x),
        "std": F.stddev_pop(x),
        "sum": F.sum(x),
        "skew": F.skewness(x),
    }


def column_stats(
    df: DataFrame, columns: Sequence[str] | None = None, fold_case: bool = True
) -> DataFrame:
    """One row per column; ``fold_case=False`` counts distinct values as written."""
    columns = list(columns or data_columns(df))
    with working_copy(df.select(*[cell(c) for c in columns])) as copy:
        return _column_stats(copy, columns, fold_case)


def _column_stats(df: DataFrame, columns: list[str], fold_case: bool) -> DataFrame:
    filled = _filled(df, columns)
    numbers = _numbers(df, filled)
    total = df.count()
    fills = column_aggregates(
        df, {c: v.isNotNull() for c, v in filled.items()}, lambda v: {"n": F.count_if(v)}
    )
    moments = column_aggregates(df, numbers, _moments)
    numeric = {
        c: numbers[c]
        for c, m in moments.items()
        if m["n"] and m["n"] >= PROFILE_SHARE * fills[c]["n"]
    }
    counts = {c: m["n"] for c, m in moments.items()}
    quartiles = exact_quantiles(df, numeric, (0.25, 0.5, 0.75), counts, interpolate=False)
    limits = {
        c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, _, q3) in quartiles.items()
    }
    outliers = count_outside(df, numeric, limits)
    unique, mode = dict.fromkeys(columns, 0), dict.fromkeys(columns)
    for c, rank, value, n in ranked_values(df, filled, 1, distinct=True):
        if rank:
            mode[c] = str(value)
        else:
            unique[c] = n
    texts = {c: v for c, v in filled.items() if is_text(df.schema[c].dataType)}
    if fold_case and texts:
        unique |= distinct_counts(df, texts, fold_case)
    rows = []
    for c in columns:
        m, nulls = moments[c], total - fills[c]["n"]
        row = [c, "numeric" if c in numeric else "text", total, total - nulls, nulls,
               _percent(nulls, total), unique[c]]
        if c in numeric:
            q1, median, q3 = quartiles[c]
            skew = m["skew"] if m["n"] >= 3 else 0.0
            row += [m["min"], m["max"], m["mean"], median, m["std"], q1, q3, outliers[c],
                    m["sum"], skew]
        else:
            row += [None] * 10
        rows.append((*row, mode[c]))
    return small_table(df.sparkSession, rows, STATS_SCHEMA)


def grid_histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, bin, lo, hi, n)`` with ten bins per column."""
    numbers = _numbers(df, _filled(df, columns))
    ends = column_aggregates(df, numbers, lambda x: {"lo": F.min(x), "hi": F.max(x)})
    bins = {c: Bins.for_grid(e["lo"], e["hi"]) for c, e in ends.items() if e["lo"] is not None}
    return histogram(df, {c: numbers[c] for c in bins}, bins)


def top_prefixes(df: DataFrame, columns: Sequence[str], k: int = TOP) -> DataFrame:
    """``(column, rank, value, n, pct)`` of the most frequent 20-character prefixes."""
    filled = _filled(df, columns)
    heads = {c: F.substring(v.cast("string"), 1, PREFIX) for c, v in filled.items()}
    counts = cell_counts(df, heads)
    totals = counts.groupBy("column").agg(F.sum("n").alias("filled"))
    pct = F.floor(F.col("n") / F.col("filled") * 100 + 0.5).cast("bigint")
    # One row per column on the broadcast side.
    return (
        keep_top(counts, k)
        .join(F.broadcast(totals), "column")
        .select("column", "rank", "value", "n", pct.alias("pct"))
    )
