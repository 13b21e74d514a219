"""Text columns that hold numbers or booleans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.functions.nulls import trim_unicode
from burnish.functions.numbers import num_whole
from burnish.operators.typing import text_columns
from burnish.plans.fused import column_aggregates

# Decoration that numbers may carry.
_DECORATION = r"(?U)[$,€£¥%\s]"

# Words that stand for 1 and for 0.
TRUE_WORDS = ("yes", "true", "y", "on")
FALSE_WORDS = ("no", "false", "n", "off")

MAJORITY = 0.5


def decorated_number(c: Column) -> Column:
    """``'$1,200'`` as 1200.0; NULL when what remains is not a number."""
    return num_whole(F.regexp_replace(c, _DECORATION, ""))


def boolean_number(c: Column) -> Column:
    """1 or 0 for a boolean word, else NULL."""
    word = F.lower(trim_unicode(c))
    return F.when(word.isin(*TRUE_WORDS), 1.0).when(word.isin(*FALSE_WORDS), 0.0)


def coerce_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    numbers: bool = True,
    booleans: bool = True,
) -> tuple[DataFrame, int]:
    """Turn text columns into doubles; returns the table and the number of coerced cells.

    A column becomes numeric when more than half of its filled cells parse, and boolean
    when every filled cell is a boolean word. One job decides for all columns.
    """
    columns = list(text_columns(df) if columns is None else columns)
    found = column_aggregates(
        df,
        {c: cell(c) for c in columns},
        lambda v: {
            "n": F.count(v),
            "numbers": F.count(decorated_number(v)),
            "booleans": F.count(boolean_number(v)),
        },
    )
    new, coerced = {}, 0
    for c in columns:
        f = found[c]
        if numbers and (f["numbers"] or 0) > int(f["n"] * MAJORITY):
            new[c] = decorated_number(cell(c))
            coerced += f["numbers"]
        elif booleans and f["n"] and f["booleans"] == f["n"]:
            new[c] = boolean_number(cell(c))
            coerced += f["booleans"]
    return (df.withColumns(new) if new else df), coerced
