"""Exact order statistics of whole columns without sorting or collecting them.

Radix selection: a double becomes a whole number of 64 bits in the same order. A scan counts the
values by their first 16 bits in every task; running sums over the counts tell which prefix holds
each wanted rank, and the next scan counts the following 16 bits of the values with such a prefix
only. As soon as few values are left in the open prefixes, their remaining bits are counted at once.
So four scans are enough for any data, and most take two. A scan shuffles one row per task, column
and prefix; a hot value is one of them. Only the wanted ranks come back to the driver.

Infinite values are numbers like others; NaN is larger than all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.plans.fused import column_aggregates, small_table
from burnish.plans.shipping import ship

#: Values in open prefixes whose remaining bits are counted in one scan.
FEW_VALUES = 1 << 22
#: Bits that a scan adds to the open prefixes.
STEP = 16
_BITS = 64
#: Partial counts that a task keeps before it adds them up.
_PENDING = 64


def _keys(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; the two zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(np.iinfo(np.int64).max))


def _value(key: int) -> float:
    bits = np.int64(key)
    return float((bits ^ ((bits >> 63) & np.int64(np.iinfo(np.int64).max))).view(np.float64))


def _shifted(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits."""
    return keys >> np.int64(_BITS - bits) if bits else np.zeros_like(keys)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    bins, at = np.unique(np.concatenate([b for b, _ in parts]), return_inverse=True)
    sums = np.zeros(len(bins), dtype=np.int64)
    np.add.at(sums, at, np.concatenate([n for _, n in parts]))
    return bins, sums


def _scan(wide: DataFrame, open_: dict[int, list[int]], done: int, upto: int) -> DataFrame:
    """``(column, parent, bin, n)``: values by their first ``upto`` bits inside open prefixes."""
    wanted = {i: np.array(sorted(p), dtype=np.int64) for i, p in open_.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {i: [] for i in wanted}
        for batch in batches:
            for i, prefixes in wanted.items():
                keys = _keys(batch.column(i).drop_null().to_numpy())
                if done:
                    keys = keys[np.isin(_shifted(keys, done), prefixes)]
                if len(keys):
                    parts[i].append(np.unique(_shifted(keys, upto), return_counts=True))
                if len(parts[i]) == _PENDING:
                    parts[i] = [_added(parts[i])]
        for i, found in parts.items():
            if found:
                bins, n = _added(found)
                parent = bins >> np.int64(upto - done) if done else np.zeros_like(bins)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bins), i, dtype=np.int32)), pa.array(parent),
                     pa.array(bins), pa.array(n)],
                    ["column", "parent", "bin", "n"],
                )

    rows = wide.mapInArrow(count, "column int, parent bigint, bin bigint, n bigint")
    return rows.groupBy("column", "parent", "bin").agg(F.sum("n").alias("n"))


def order_statistics(
    df: DataFrame,
    columns: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    counts: Mapping[str, int],
) -> dict[str, dict[int, float]]:
    """Value at each 0-based rank of each column; ``counts`` are the non-null counts."""
    names = [c for c in columns if ranks.get(c)]
    out: dict[str, dict[int, float]] = {c: {} for c in names}
    if not names:
        return out
    spark = df.sparkSession
    ship(spark)
    wide = df.select(*[columns[c].cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    # a wanted rank: column, rank, open prefix, rank inside it, values inside it
    wanted = [(i, r, 0, r, counts[c]) for i, c in enumerate(names) for r in sorted(set(ranks[c]))]
    done = 0
    while wanted:
        inside = {(i, parent): n for i, _, parent, _, n in wanted}
        upto = _BITS if sum(inside.values()) <= FEW_VALUES else done + STEP
        open_: dict[int, list[int]] = {}
        for i, parent in inside:
            open_.setdefault(i, []).append(parent)
        running = Window.partitionBy("column", "parent").orderBy("bin")
        bins = _scan(wide, open_, done, upto).withColumn(
            "upto", F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, 0))
        )
        asked = small_table(
            spark, [w[:4] for w in wanted], "column int, rank bigint, parent bigint, inner bigint"
        )
        hit = (F.col("inner") >= F.col("upto") - F.col("n")) & (F.col("inner") < F.col("upto"))
        found = bins.join(F.broadcast(asked), ["column", "parent"]).where(hit).select(
            "column", "rank", "bin", F.col("inner") - (F.col("upto") - F.col("n")), "n"
        )
        wanted, done = [tuple(r) for r in found.collect()], upto
        if done == _BITS:
            for i, rank, key, _, _ in wanted:
                out[names[i]][rank] = _value(key)
            break
    return out


def _between(lo: float, hi: float, weight: float) -> float | None:
    """Linear interpolation; NULL half way between the two infinities."""
    if not weight or lo == hi:
        return lo
    if math.isinf(lo) or math.isinf(hi):
        return None if math.isinf(lo) and math.isinf(hi) else lo if math.isinf(lo) else hi
    return lo + (hi - lo) * weight


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probabilities: Sequence[float],
    counts: Mapping[str, int] | None = None,
    interpolate: bool = True,
) -> dict[str, list[float | None]]:
    """Quantiles per column; NULL entries for a column without values.

    ``interpolate=True`` is the linear rule at position ``(n - 1) * p``; ``False`` takes
    the element at index ``floor(n * p)``.
    """
    if counts is None:
        found = column_aggregates(df, columns, lambda x: {"n": F.count(x)})
        counts = {c: found[c]["n"] for c in columns}

    def spots(n: int) -> list[tuple[int, int, float]]:
        out = []
        for p in probabilities:
            if interpolate:
                at = (n - 1) * p
                lo = math.floor(at)
                out.append((lo, min(lo + 1, n - 1), at - lo))
            else:
                i = min(math.floor(n * p), n - 1)
                out.append((i, i, 0.0))
        return out

    ranks = {
        c: [r for lo, hi, _ in spots(counts[c]) for r in (lo, hi)] for c in columns if counts[c]
    }
    values = order_statistics(df, columns, ranks, counts)
    result: dict[str, list[float | None]] = {}
    for c in columns:
        if not counts[c]:
            result[c] = [None] * len(probabilities)
            continue
        at = values[c]
        result[c] = [_between(at[lo], at[hi], w) for lo, hi, w in spots(counts[c])]
    return result
