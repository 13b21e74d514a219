"""What the corpus operators share: written tables, ranks and running totals without one big task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burnish.plans.materialize import shared_folder
from burnish.plans.shipping import ship

#: White space of the word counts, as a regular expression class body.
BLANKS = r"\x20\x09-\x0D"
#: Texts that a Python task works on side by side: about so many bytes, and at most so many rows.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 4096
#: Bytes of an Arrow batch between Spark and Python, where the session sets none.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Send the package to the tasks and bound the batches of text they get."""
    ship(spark)
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def slices(texts: pa.Array, by_length: bool = False) -> Iterator[np.ndarray]:
    """Row numbers of all texts in parts of bounded size, in order or texts of like length together.

    A text longer than ``SLICE_BYTES`` is a part with the ones before it that fit. What Arrow
    holds unused goes back to the system at the end, so idle workers stay small.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    order = np.argsort(sizes, kind="stable") if by_length else np.arange(len(sizes))
    part = np.cumsum(sizes[order].astype(np.int64)) // SLICE_BYTES
    rows = np.arange(len(order)) // SLICE_ROWS
    cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(rows) != 0)) + 1
    yield from (p for p in np.split(order, cuts) if len(p))
    pa.default_memory_pool().release_unused()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Runs of anything but white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def hash_key(*parts: Column) -> Column:
    """60 bits of MD5 over the parts as text: uniform, and the same in any engine."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def running_before(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column],
                   value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows that come earlier in the group.

    ``bucket`` must rise with ``order`` inside a group. A task holds one bucket; only the totals
    of the buckets, one row each, are summed across.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    across = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.coalesce(F.sum("__sum").over(across), F.lit(0)).alias("__base"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return (
        df.join(totals, same, "left")
        .withColumn(out, F.col("__base") + F.col("__inside"))
        .drop("__inside", "__base", *[f"__{k}" for k in keys])
    )


def ranked(df: DataFrame, order: Sequence[Column], out: str, name: str) -> DataFrame:
    """Number the rows from 0 in ``order``: ranges are ranked apart and shifted by their counts."""
    spark = df.sparkSession
    ranges = written(
        df.repartitionByRange(shuffle_partitions(spark), *order)
        .withColumn("__range", F.spark_partition_id())
        .withColumn("__one", F.lit(1).cast("long")),
        name,
    )
    return running_before(
        ranges.withColumn("__all", F.lit(0)), ["__all"], "__range", order, "__one", out
    ).drop("__range", "__one", "__all")
