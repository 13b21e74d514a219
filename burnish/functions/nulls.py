"""Null tokens and Unicode-aware trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean "no value", compared after trim + lowercase.
NARROW_TOKENS = ("", "null", "none", "nan", "na", "n/a", "nil", "#n/a", "undefined")
WIDE_TOKENS = NARROW_TOKENS + ("#null", "missing", "unknown", "-", "--")

# The characters that count as space at the ends of a cell.
SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_unicode(c: Column) -> Column:
    """Strip every Unicode space on both ends; one-argument ``trim`` strips U+0020 only."""
    return F.btrim(c, F.lit(SPACES))


def null_token(c: Column, tokens: tuple[str, ...] = WIDE_TOKENS) -> Column:
    """True for SQL NULL and for a spelled-out null token; never NULL itself."""
    return c.isNull() | F.lower(trim_unicode(c)).isin(*tokens)


def null_if_token(c: Column, tokens: tuple[str, ...] = WIDE_TOKENS) -> Column:
    """The cell, or NULL where it is a null token."""
    return F.when(~null_token(c, tokens), c)
