"""Equal-width histograms of many columns in one grouped job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.plans.fused import melt, small_table


@dataclass(frozen=True)
class Bins:
    """Equal-width bins on [lo, hi]; the last bin is closed on the right.

    ``exact_edges`` settles values that rounding puts on the wrong side of an edge.
    """

    lo: float
    hi: float
    count: int
    exact_edges: bool = True

    @classmethod
    def for_profile(cls, lo: float, hi: float, n: int) -> Bins:
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        return cls(lo, hi, min(20, n))

    @classmethod
    def for_grid(cls, lo: float, hi: float) -> Bins:
        return cls(lo, hi if hi > lo else lo + 1.0, 10, exact_edges=False)

    @property
    def width(self) -> float:
        return (self.hi - self.lo) / self.count

    def edges(self) -> list[float]:
        return [self.lo + i * self.width for i in range(self.count)] + [self.hi]


def _bin_of(x: Column) -> Column:
    """Bin number from the parameters that the row carries."""
    lo, hi, k = F.col("lo"), F.col("hi"), F.col("bins")
    i = F.least(k - 1, F.floor((x - lo) / (hi - lo) * k).cast("int"))
    edge_after = lo + (i + 1) * F.col("width")
    moved = (
        F.when(x < lo + i * F.col("width"), i - 1)
        .when((i < k - 1) & (x >= edge_after), i + 1)
        .otherwise(i)
    )
    return F.when(F.col("exact_edges"), moved).otherwise(i)


def bin_counts(
    df: DataFrame,
    values: dict[str, Column],
    bins: dict[str, Bins],
    flags: dict[str, tuple[Column, dict[str, tuple]]] | None = None,
) -> DataFrame:
    """``(column, bin, n, <flag counts>)`` of the non-empty bins.

    A flag is a condition on ``value`` and on parameters ``p0, p1, ...`` of the column,
    counted in the same pass. The broadcast side has one row per column.
    """
    flags = flags or {}
    params, types = [], ["column string", "lo double", "hi double", "bins int", "width double",
                         "exact_edges boolean"]
    widths = {f: len(next(iter(ps.values()))) for f, (_, ps) in flags.items()}
    for f, n in widths.items():
        types += [f"{f}_p{i} double" for i in range(n)]
    for c, b in bins.items():
        extra = [v for _, ps in flags.values() for v in ps[c]]
        params.append((c, b.lo, b.hi, b.count, b.width, b.exact_edges, *extra))
    table = small_table(df.sparkSession, params, ", ".join(types))
    return (
        melt(df, {c: values[c] for c in bins})
        .filter(F.col("value").isNotNull())
        .join(F.broadcast(table), "column")
        .groupBy("column", _bin_of(F.col("value")).alias("bin"))
        .agg(F.count("*").alias("n"), *[F.count_if(e).alias(f) for f, (e, _) in flags.items()])
    )


def histogram(df: DataFrame, values: dict[str, Column], bins: dict[str, Bins]) -> DataFrame:
    """``(column, bin, lo, hi, n)`` with the empty bins."""
    spark = df.sparkSession
    frame = [
        (c, i, e[i], e[i + 1]) for c, b in bins.items() for e in [b.edges()] for i in range(b.count)
    ]
    slots = small_table(spark, frame, "column string, bin int, lo double, hi double")
    if not bins:
        return slots.withColumn("n", F.lit(0).cast("bigint"))
    counted = bin_counts(df, values, bins).select("column", "bin", "n")
    return slots.join(F.broadcast(counted), ["column", "bin"], "left").select(
        "column", "bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )
