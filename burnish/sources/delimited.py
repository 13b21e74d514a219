"""Delimited files to tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.functions.nulls import trim_unicode
from burnish.operators.typing import ROW_ORDER, infer_types


def table_name(name: str) -> str:
    """A safe table name: no extension, word characters only, no leading digit."""
    stem = PurePosixPath(name).name
    stem = re.sub(r"\.[^.]+$", "", stem)
    safe = re.sub(r"[^A-Za-z0-9_]", "_", stem)
    return f"t{safe}" if safe[:1].isdigit() else safe


def separator(path: str) -> str:
    return "\t" if path.endswith(".tsv") else ","


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, with_order: bool = False
) -> DataFrame:
    """All cells as trimmed text; short rows padded with ``''``, blank rows dropped.

    ``with_order`` adds ``_row_order``, the row's position in the input.
    """
    raw = (
        spark.read.options(
            header=True,
            sep=sep or separator(path),
            quote='"',
            escape='"',
            ignoreLeadingWhiteSpace=True,
            ignoreTrailingWhiteSpace=True,
            mode="PERMISSIVE",
        )
        .csv(path)
    )
    if not raw.columns:
        raise ValueError(f"{path!r} appears empty")
    cells = [F.coalesce(trim_unicode(cell(c)), F.lit("")).alias(c.strip()) for c in raw.columns]
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).alias(ROW_ORDER)
    table = raw.select(*cells, *([order] if with_order else []))
    names = [c.strip() for c in raw.columns]
    return table.filter(reduce(or_, [cell(c) != "" for c in names]))


def load_files(
    spark: SparkSession, paths: Sequence[str], typed: bool = False
) -> dict[str, DataFrame]:
    """Each file becomes a temporary view named after it; ``typed`` infers column types."""
    out = {}
    for path in paths:
        df = read_delimited(spark, path)
        out[table_name(path)] = infer_types(df) if typed else df
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def read_sniffed(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Types sniffed by the reader (whole numbers, doubles, booleans, dates, timestamps)."""
    return spark.read.options(
        header=True, sep=sep or separator(path), quote='"', escape='"', inferSchema=True,
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="",
    ).csv(path)
