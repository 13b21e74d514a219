"""Simple imputers: one value per column, dropped rows, nearest filled row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.names import cell
from burnish.operators.frequency import modes
from burnish.operators.typing import ROW_ORDER, is_numeric, number
from burnish.plans.fused import column_aggregates
from burnish.plans.ordered import fill_ordered
from burnish.plans.quantiles import exact_quantiles


def fill_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace NULL (and NaN) by a literal per column; a None leaves the column alone.

    A column of whole numbers keeps its type if the literal fits it.
    """
    new = {}
    for c, v in values.items():
        if v is None:
            continue
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.IntegralType) and float(v).is_integer() and abs(v) < 1 << 31:
            new[c] = F.coalesce(cell(c), F.lit(int(v)).cast(dtype))
        else:
            new[c] = F.coalesce(number(df, c) if is_numeric(dtype) else cell(c), F.lit(v))
    return df.withColumns(new) if new else df


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = {c: number(df, c) for c in columns}
    stats = column_aggregates(df, values, lambda x: {"mean": F.avg(x)})
    return fill_values(df, {c: s["mean"] for c, s in stats.items()})


def medians_of_gaps(
    df: DataFrame, columns: Sequence[str]
) -> tuple[dict[str, float], int]:
    """Medians of the columns that have both values and gaps, and the number of rows."""
    values = {c: number(df, c) for c in columns}
    found = column_aggregates(df, values, lambda x: {"n": F.count(x), "rows": F.count("*")})
    counts = {c: f["n"] for c, f in found.items()}
    rows = max((f["rows"] or 0 for f in found.values()), default=0)
    gappy = {c: x for c, x in values.items() if 0 < counts[c] < rows}
    return {c: m for c, (m,) in exact_quantiles(df, gappy, (0.5,), counts).items()}, rows


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_values(df, medians_of_gaps(df, columns)[0])


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value, the smallest on ties; a text column without values becomes ``''``."""
    numeric = {c for c in columns if is_numeric(df.schema[c].dataType)}
    found = modes(df, {c: number(df, c) if c in numeric else cell(c) for c in columns})
    return fill_values(
        df, {c: "" if v is None and c not in numeric else v for c, v in found.items()}
    )


def impute_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0 for numbers, the empty text for text."""
    return fill_values(
        df, {c: 0.0 if is_numeric(df.schema[c].dataType) else "" for c in columns}
    )


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(cell(c).isNotNull())
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            df = df.where(~F.isnan(cell(c)))
    return df


def impute_fill(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str] = (),
    backward: bool = False,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Nearest earlier (or later) filled value in row order."""
    position = list(order_by) or ([ROW_ORDER] if ROW_ORDER in df.columns else [])
    if not position:
        raise ValueError("forward and backward fill need order_by")
    return fill_ordered(df, columns, position, backward, partition_by)
