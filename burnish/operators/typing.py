"""Column kinds and the typed view of a raw table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.names import cell
from burnish.functions.nulls import NARROW_TOKENS, WIDE_TOKENS, null_if_token
from burnish.functions.numbers import finite, num_prefix, num_whole
from burnish.plans.fused import aggregate_row, column_aggregates

# Row position of a loaded file; never part of the data.
ROW_ORDER = "_row_order"

# Share of non-null cells that must parse.
LOAD_SHARE = 0.8
PROFILE_SHARE = 0.7


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ORDER]


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name != ROW_ORDER]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def number(df: DataFrame, name: str, prefix: bool = False) -> Column:
    """The column as double: typed numbers as they are, text through a parser."""
    dtype = df.schema[name].dataType
    c = cell(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite(c.cast("double"))
    if is_numeric(dtype):
        return c.cast("double")
    text = c.cast("string")
    return num_prefix(text) if prefix else num_whole(text)


def present(df: DataFrame, name: str, tokens: Sequence[str] = WIDE_TOKENS) -> Column:
    """The cell with null tokens and NaN as NULL; typed values stay typed."""
    dtype = df.schema[name].dataType
    if is_text(dtype):
        return null_if_token(cell(name), tuple(tokens))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite(cell(name))
    return cell(name)


def normalise_nulls(df: DataFrame, tokens: Sequence[str] = WIDE_TOKENS) -> DataFrame:
    """Null tokens of every text column become NULL."""
    return df.select(
        *[cell(c) if c == ROW_ORDER else present(df, c, tokens).alias(c) for c in df.columns]
    )


@dataclass(frozen=True)
class Parsed:
    """How many cells of a text column are filled, and how many are numbers."""

    filled: int
    numbers: int

    def share_at_least(self, share: float) -> bool:
        return self.numbers >= share * self.filled


def count_parsed(df: DataFrame, columns: Sequence[str]) -> dict[str, Parsed]:
    """One job for all text columns, after null tokens are taken out."""
    found = column_aggregates(
        df,
        {c: present(df, c) for c in columns},
        lambda v: {"n": F.count(v), "numbers": F.count(num_whole(v))},
    )
    return {c: Parsed(f["n"], f["numbers"] or 0) for c, f in found.items()}


def infer_types(df: DataFrame, share: float = LOAD_SHARE) -> DataFrame:
    """Typed view: null tokens to NULL, text that mostly parses to double.

    Typed inputs keep their types. An all-null text column counts as numeric.
    """
    parsed = count_parsed(df, text_columns(df))
    out = []
    for c in df.columns:
        if c == ROW_ORDER:
            out.append(cell(c))
            continue
        v = present(df, c)
        if c in parsed and parsed[c].share_at_least(share):
            v = num_whole(v)
        out.append(v.alias(c))
    return df.select(*out)


def numeric_by_sample(
    df: DataFrame, rows: int, order_by: Sequence[str] = (), need_values: bool = True
) -> dict[str, bool]:
    """Whether every filled cell of the first ``rows`` rows starts with a number.

    The grid looks at 30 rows and wants a filled cell; the chart looks at 20 and does not.
    """
    head = df.orderBy(*order_by).limit(rows) if order_by else df.limit(rows)
    exprs = {}
    for c in data_columns(df):
        v = present(df, c, NARROW_TOKENS)
        exprs[f"f{c}"] = F.count(v)
        exprs[f"n{c}"] = F.count(F.when(v.isNotNull(), number(df, c, prefix=True)))
    row = aggregate_row(head, exprs)
    return {
        c: row[f"f{c}"] == row[f"n{c}"] and (row[f"f{c}"] > 0 or not need_values)
        for c in data_columns(df)
    }
