"""Rows that may repeat, told by a bitmap of the digests that occur twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the bitmap, 64 bits each (16 million bits): the rows of the broadcast table at most.
WORDS = 1 << 18


def split_repeats(df: DataFrame, keys: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys surely occur once, and all others.

    Counting moves eight bytes a row, combined in every task. The bitmap has a bit for every digest
    that occurs twice, so a row without its bit need not be shuffled; one with its bit may still be
    alone (with a million repeated keys one in 16 of the single rows). ``df`` is read three times.
    """
    digests = df.select(F.xxhash64(*keys).alias("h"))
    twice = digests.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    words = (
        twice.selectExpr(f"h & {WORDS - 1} AS __word", _bit("h") + " AS bit")
        .groupBy("__word")
        .agg(F.bit_or("bit").alias("__bits"))
    )
    marked = df.withColumn("__h", F.xxhash64(*keys)).withColumn("__word", F.expr(f"__h & {WORDS - 1}"))
    marked = marked.join(F.broadcast(words), "__word", "left")
    may_repeat = F.expr(f"coalesce(__bits & {_bit('__h')}, 0L) <> 0L")
    own = ["__h", "__word", "__bits"]
    return marked.filter(~may_repeat).drop(*own), marked.filter(may_repeat).drop(*own)


def _bit(digest: str) -> str:
    shift = WORDS.bit_length() - 1
    return f"shiftleft(1L, CAST(shiftrightunsigned({digest}, {shift}) & 63 AS INT))"
