"""String repair expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mis-decoded sequence -> repaired text, applied in this order.
# The first pattern ends in an ASCII quote; the real em-dash form follows it.
MOJIBAKE = (
    ('â€"', "—"),
    ("â€”", "—"),
    ("â€™", "'"),
    ("â€˜", "'"),
    ("â€œ", '"'),
    ("Ã©", "é"),
    ("Ã¨", "è"),
)


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def fix_mojibake(c: Column) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), MOJIBAKE, c)


def title_case(c: Column) -> Column:
    """Capital after every non-letter, as in ``O'Neil`` and ``3Rd``."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def strip_special(c: Column) -> Column:
    """Drop all but (Unicode) word characters, spaces and ``. , ! ? @ # -``."""
    return F.regexp_replace(c, r"(?U)[^\w\s.,!?@#\-]", "")


TRANSFORMS = {
    "lower": F.lower,
    "upper": F.upper,
    "title": title_case,
    "strip_special": strip_special,
}
