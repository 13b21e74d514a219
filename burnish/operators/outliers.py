"""Outlier fences and what to do with the values outside."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.operators.typing import number, numeric_columns
from burnish.plans.fused import column_aggregates, melt, small_table
from burnish.plans.quantiles import exact_quantiles

METHODS = ("iqr", "zscore", "modified_z")
FEWEST = 4
FLAG = "_outlier_flag"


@dataclass(frozen=True)
class Fence:
    lo: float
    hi: float
    mean: float
    median: float | None

    def outside(self, x: Column) -> Column:
        return F.coalesce((x < self.lo) | (x > self.hi), F.lit(False))


@dataclass
class Handled:
    df: DataFrame
    counts: dict[str, int] = field(default_factory=dict)
    #: Filled cells and fences of the columns, and whether any row or value was taken out since.
    filled: dict[str, int] = field(default_factory=dict)
    fences: dict[str, Fence] = field(default_factory=dict)
    capped: set[str] = field(default_factory=set)
    emptied: bool = False

    @property
    def total(self) -> int:
        return sum(self.counts.values())


def fences(
    df: DataFrame, columns: Sequence[str], method: str, medians: bool = False
) -> dict[str, Fence]:
    """Fences of every column with at least four values; literals for a map-only pass."""
    return _fences_and_counts(df, columns, method, medians)[0]


def _fences_and_counts(
    df: DataFrame, columns: Sequence[str], method: str, medians: bool
) -> tuple[dict[str, Fence], dict[str, int]]:
    """Fences, and the filled cells of all columns."""
    values = {c: number(df, c) for c in columns}
    stats = column_aggregates(
        df, values, lambda x: {"n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x)}
    )
    values = {c: x for c, x in values.items() if stats[c]["n"] >= FEWEST}
    counts = {c: stats[c]["n"] for c in values}
    middle = dict.fromkeys(values)
    edges = {}
    if method == "iqr":
        for c, (q1, q2, q3) in exact_quantiles(df, values, (0.25, 0.5, 0.75), counts).items():
            edges[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
            middle[c] = q2
    elif method in ("zscore", "modified_z"):
        if medians or method == "modified_z":
            middle = {c: q[0] for c, q in exact_quantiles(df, values, (0.5,), counts).items()}
        if method == "zscore":
            for c in values:
                m, sd = stats[c]["mean"], stats[c]["std"]
                edges[c] = (m - 3 * sd, m + 3 * sd)
        else:
            away = {c: F.abs(x - F.lit(middle[c])) for c, x in values.items()}
            for c, (mad,) in exact_quantiles(df, away, (0.5,), counts).items():
                edges[c] = (middle[c] - 3.5 * mad, middle[c] + 3.5 * mad)
    else:
        raise ValueError(f"unknown method {method!r}")
    found = {c: Fence(*edges[c], stats[c]["mean"], middle[c]) for c in values}
    return found, {c: stats[c]["n"] or 0 for c in columns}


def count_outside(
    df: DataFrame, values: Mapping[str, Column], limits: Mapping[str, tuple[float, float]]
) -> dict[str, int]:
    """How many values of each column lie outside its limits, in one scan."""
    if not limits:
        return {}
    rows = [(c, float(lo), float(hi)) for c, (lo, hi) in limits.items()]
    table = small_table(df.sparkSession, rows, "column string, lo double, hi double")
    value = F.col("value")
    found = (
        melt(df, {c: values[c] for c in limits})
        .join(F.broadcast(table), "column")
        .groupBy("column")
        .agg(F.count_if((value < F.col("lo")) | (value > F.col("hi"))).alias("n"))
        .collect()
    )
    return dict.fromkeys(limits, 0) | {r["column"]: r["n"] for r in found}


def treated(x: Column, out: Column, action: str, fence: Fence) -> Column:
    """The value after a non-removing action; NULL stays NULL."""
    if action == "cap":
        capped = F.least(F.greatest(x, F.lit(fence.lo)), F.lit(fence.hi))
        return F.when(out, capped).otherwise(x)
    if action == "replace_mean":
        return F.when(out, F.lit(fence.mean)).otherwise(x)
    if action == "replace_median":
        return F.when(out, F.lit(fence.median)).otherwise(x)
    if action == "nan":
        return F.when(~out, x)
    return x


def _batches(columns: Sequence[str], actions: Mapping[str, str]) -> list[list[str]]:
    """Runs that can share their statistics: only a removal changes the rows of later columns."""
    out: list[list[str]] = [[]]
    for c in columns:
        out[-1].append(c)
        if actions[c] == "remove":
            out.append([])
    return [b for b in out if b]


def handle_outliers(
    df: DataFrame,
    method: str = "iqr",
    action: str = "cap",
    columns: Sequence[str] | None = None,
    per_column: Mapping[str, str] | None = None,
) -> Handled:
    """Apply an action to the values outside the fences, column after column.

    Removing is sequential: the fences of a later column see fewer rows. ``flag`` adds
    ``_outlier_flag``.
    """
    own = {c: a for c, a in (per_column or {}).items() if a and a != "global"}
    columns = list(numeric_columns(df) if columns is None else columns)
    actions = {c: own.get(c, action) for c in columns}
    columns = [c for c in columns if actions[c] != "keep"]
    result = Handled(df)
    flagged: list[Column] = []
    for batch in _batches(columns, actions):
        want = any(actions[c] == "replace_median" for c in batch)
        found, filled = _fences_and_counts(result.df, batch, method, want)
        result.filled |= filled
        result.fences |= found
        values = {c: number(result.df, c) for c in found}
        out = {c: f.outside(values[c]) for c, f in found.items()}
        limits = {c: (f.lo, f.hi) for c, f in found.items()}
        result.counts |= count_outside(result.df, values, limits)
        new = {}
        for c, f in found.items():
            if actions[c] == "flag":
                flagged.append(out[c])
            elif actions[c] != "remove" and result.counts[c]:  # else the column keeps its type
                new[c] = treated(values[c], out[c], actions[c], f)
                if actions[c] == "cap" and method == "iqr":
                    result.capped.add(c)
                result.emptied |= actions[c] == "nan"
        kept = result.df
        last = batch[-1]
        if actions[last] == "remove" and last in out:
            kept = kept.filter(~out[last])
            result.emptied = True
        result.df = kept.withColumns(new) if new else kept
    if action == "flag" or flagged:
        any_out = reduce(or_, flagged) if flagged else F.lit(False)
        result.df = result.df.withColumn(FLAG, any_out.cast("int"))
    return result
