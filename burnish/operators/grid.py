"""Column filters, search, sort and projection of a table view."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.names import cell
from burnish.functions.nulls import NARROW_TOKENS, null_token
from burnish.functions.numbers import natural_key, num_prefix
from burnish.operators.typing import data_columns, is_numeric, is_text, number


_LEADING_NUMBER = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def _literal(text: str) -> float | None:
    found = _LEADING_NUMBER.match(text)
    return float(found.group()) if found else None


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.lower(cell(name).cast("string")), F.lit(""))


def _is_null(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if is_text(dtype):
        return null_token(cell(name), NARROW_TOKENS)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return cell(name).isNull() | F.isnan(cell(name))
    return cell(name).isNull()


def _compare(df: DataFrame, name: str, op: str, text: str) -> Column:
    bound = _literal(text)
    if bound is None:
        return F.lit(False)
    # A typed column compares as it is, so that the filter reaches the scan.
    x = cell(name) if is_numeric(df.schema[name].dataType) else number(df, name, prefix=True)
    test = {">=": x >= bound, "<=": x <= bound, ">": x > bound, "<": x < bound}[op]
    if op[0] == ">" and isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        test = test & ~F.isnan(x)  # NaN is no number here, though it sorts above all of them
    return F.coalesce(test, F.lit(False)) if is_text(df.schema[name].dataType) else test


def _equals(df: DataFrame, name: str, text: str) -> Column:
    dtype = df.schema[name].dataType
    if is_numeric(dtype) and _LEADING_NUMBER.fullmatch(text):
        return cell(name) == float(text)
    return _text(df, name) == text


def column_filter(df: DataFrame, name: str, expression: str) -> Column:
    """One filter of the mini-language: ``null !null >= <= > < != =`` or bare text.

    ``!=`` means "does not contain" and bare text "contains"; both ignore case.
    """
    e = expression.lower().strip()
    if e in ("null", "empty"):
        return _is_null(df, name)
    if e in ("!null", "!empty"):
        return ~_is_null(df, name)
    for op in (">=", "<=", ">", "<"):
        if e.startswith(op):
            return _compare(df, name, op, e[len(op):])
    if e.startswith("!="):
        return ~F.contains(_text(df, name), F.lit(e[2:]))
    if e.startswith("="):
        return _equals(df, name, e[1:])
    return F.contains(_text(df, name), F.lit(e))


def grid_filter(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Rows that pass every column filter; unknown columns and empty filters do not count."""
    tests = [column_filter(df, c, e) for c, e in filters.items() if e and c in df.columns]
    return df.filter(reduce(and_, tests)) if tests else df


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows with a cell that contains ``text``, case-insensitive."""
    if not text:
        return df
    tests = [F.contains(_text(df, c), F.lit(text.lower())) for c in data_columns(df)]
    return df.filter(reduce(or_, tests))


def grid_sort(
    df: DataFrame, column: str, ascending: bool = True, order_by: Sequence[str] = ()
) -> DataFrame:
    """Numbers in numeric order, then text in natural order; ``order_by`` breaks ties."""
    if is_numeric(df.schema[column].dataType):
        keys = [cell(column)]
    else:
        text = F.coalesce(cell(column).cast("string"), F.lit(""))
        keys = [num_prefix(text), natural_key(text)]
    if ascending:
        order = [k.asc_nulls_last() for k in keys]
    else:
        order = [k.desc_nulls_first() for k in keys]
    return df.orderBy(*order, *[cell(c).asc() for c in order_by])


def visible(df: DataFrame, hidden: Sequence[str] = ()) -> DataFrame:
    """All columns but the hidden ones, in table order."""
    return df.select(*[cell(c) for c in data_columns(df) if c not in hidden])


def preview(df: DataFrame, rows: int, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows in the given order."""
    return (df.orderBy(*[cell(c) for c in order_by]) if order_by else df).limit(rows)


def grid_view(
    df: DataFrame,
    filters: Mapping[str, str] | None = None,
    text: str = "",
    sort: str | None = None,
    ascending: bool = True,
    hidden: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Filter, search, sort, project: what a table view shows and exports."""
    out = search(grid_filter(df, filters or {}), text)
    if sort:
        out = grid_sort(out, sort, ascending, order_by)
    return visible(out, hidden)
