"""Text to number: the lenient prefix parser, the strict parser, and sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_PREFIX = rf"^\s*({_NUMBER})"
_WHOLE = rf"^\s*{_NUMBER}\s*$"


def num_prefix(c: Column) -> Column:
    """Longest numeric prefix of a text cell as double, else NULL (``'12abc'`` -> 12)."""
    return F.regexp_extract(c, _PREFIX, 1).try_cast("double")


def num_whole(c: Column) -> Column:
    """The cell as double when the whole cell is a number, else NULL.

    The pattern guards the cast, which would also take ``'1d'`` and ``'NaN'``.
    """
    return F.when(c.rlike(_WHOLE), F.trim(c).try_cast("double"))


def finite(c: Column) -> Column:
    """NaN to NULL, so that statistics skip it."""
    return F.when(~F.isnan(c), c)


def natural_key(c: Column) -> Column:
    """Text sort key in which ``a2`` precedes ``a10``: digit runs sort by length, then digits."""
    chunks = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(
        chunks,
        lambda x: F.when(
            x.rlike(r"^\d"),
            F.concat(
                F.lpad(F.length(F.regexp_replace(x, "^0+", "")).cast("string"), 10, "0"),
                F.regexp_replace(x, "^0+", ""),
            ),
        ).otherwise(x),
    )
    return F.array_join(padded, "")
