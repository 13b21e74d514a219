"""Column references that survive any column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(name: str) -> Column:
    """The column called exactly ``name``, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
