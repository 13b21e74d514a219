"""String clean-up of text columns and the count of changed cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.functions.nulls import trim_unicode
from burnish.functions.text import TRANSFORMS, collapse_spaces, fix_mojibake
from burnish.operators.typing import text_columns


def repaired(
    c: Column,
    trim: bool = True,
    collapse: bool = True,
    encoding: bool = True,
    transform: str = "none",
) -> Column:
    """The clean-up steps in their fixed order."""
    if trim or transform == "trim":
        c = trim_unicode(c)
    if collapse:
        c = collapse_spaces(c)
    if encoding:
        c = fix_mojibake(c)
    return TRANSFORMS[transform](c) if transform in TRANSFORMS else c


def clean_strings(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    trim: bool = True,
    collapse: bool = True,
    encoding: bool = True,
    transform: str = "none",
    per_column: Mapping[str, str] | None = None,
) -> DataFrame:
    """Clean text columns; ``per_column`` transforms override the global one."""
    columns = list(text_columns(df) if columns is None else columns)
    own = {c: t for c, t in (per_column or {}).items() if t != "none"}
    return df.withColumns(
        {
            c: repaired(cell(c), trim, collapse, encoding, own.get(c, transform))
            for c in columns
        }
    )


def changed_cells(before: Mapping[str, Column], after: Mapping[str, Column]) -> Column:
    """Aggregate: how many cells differ; NULL and the empty text are equal."""
    def differs(c: str) -> Column:
        blank = F.lit("")
        changed = F.coalesce(before[c], blank) != F.coalesce(after[c], blank)
        return changed.cast("bigint")

    return F.coalesce(F.sum(sum((differs(c) for c in after), F.lit(0))), F.lit(0)).cast("bigint")
