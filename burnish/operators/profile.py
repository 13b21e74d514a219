"""Column profile: one row per column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.names import cell
from burnish.operators.frequency import cell_counts, distinct_counts, ranked_values
from burnish.operators.histogram import Bins, bin_counts
from burnish.operators.typing import (
    LOAD_SHARE,
    PROFILE_SHARE,
    count_parsed,
    data_columns,
    is_numeric,
    number,
    present,
    text_columns,
)
from burnish.plans.fused import column_aggregates, small_table, working_copy
from burnish.plans.quantiles import exact_quantiles

PROFILE_SCHEMA = """
    column string, type string, total bigint, non_null bigint, null_count bigint,
    null_pct double, unique bigint, completeness double,
    min double, max double, mean double, median double, std double, variance double,
    q1 double, q3 double, iqr double, skewness double, kurtosis double,
    outliers_iqr bigint, outliers_z bigint, sum double, zeros bigint, negatives bigint,
    p5 double, p95 double,
    histogram struct<counts: array<bigint>, edges: array<double>>,
    top_values array<struct<value: string, count: bigint>>, mode string, avg_length double
"""

TOP = 10
_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def sample_skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness from the population one; NULL below three values."""
    n = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one; NULL below four values."""
    n = n.cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n >= 4, scale * ((n + 1) * g2 + 6))


def _round(x: float | None, digits: int) -> float | None:
    return None if x is None else round(x, digits)


def _moments(x: Column) -> dict[str, Column]:
    return {
        "n": F.count(x),
        "min": F.min(x),
        "max": F.max(x),
        "mean": F.avg(x),
        "std": F.stddev_samp(x),
        "variance": F.var_samp(x),
        "std_pop": F.stddev_pop(x),
        "skewness": sample_skewness(F.count(x), F.skewness(x)),
        "kurtosis": sample_kurtosis(F.count(x), F.kurtosis(x)),
        "sum": F.sum(x),
        "zeros": F.count_if(x == 0),
        "negatives": F.count_if(x < 0),
    }


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Profile of every column (or of ``columns``).

    The same few jobs whatever the number of columns: the kinds of text columns, moments,
    quantiles, histograms with outliers, distinct counts, top values.
    """
    columns = list(columns or data_columns(df))
    with working_copy(df.select(*[cell(c) for c in columns])) as copy:
        return _profile(copy, columns)


def _profile(df: DataFrame, columns: list[str]) -> DataFrame:
    parsed = count_parsed(df, text_columns(df))
    numeric: dict[str, Column] = {}
    shown: dict[str, Column] = {}
    loaded: set[str] = set()
    for c in columns:
        shown[c] = present(df, c)
        if c in parsed:
            if parsed[c].share_at_least(LOAD_SHARE):
                shown[c] = number(df, c)
                loaded.add(c)
            # A column without values stays text.
            if parsed[c].numbers >= max(1, PROFILE_SHARE * parsed[c].filled):
                numeric[c] = number(df, c)
        elif is_numeric(df.schema[c].dataType):
            numeric[c] = number(df, c)

    total = df.count()
    moments = column_aggregates(df, numeric, _moments)
    moments = {c: m for c, m in moments.items() if m["n"]}
    numeric = {c: numeric[c] for c in moments}
    texts = [c for c in columns if c not in numeric]
    # Columns between the two shares are summed up as numbers but count their cells as text.
    as_text = [c for c in columns if c in texts or (c in parsed and c not in loaded)]
    lengths = column_aggregates(
        df,
        {c: shown[c].cast("string") for c in as_text},
        lambda v: {"n": F.count(v), "avg_length": F.avg(F.length(v))},
    )
    counts = {c: m["n"] for c, m in moments.items()}
    quantiles = exact_quantiles(df, numeric, _QUANTILES, counts)

    bins, fences, spreads = {}, {}, {}
    for c, m in moments.items():
        _, q1, _, q3, _ = quantiles[c]
        bins[c] = Bins.for_profile(m["min"], m["max"], m["n"])
        fences[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        # Without spread, or below four values, nothing is far out.
        usable = m["n"] >= 4 and m["std_pop"]
        spreads[c] = (m["mean"], m["std_pop"]) if usable else (0.0, math.inf)
    shape = {c: {"counts": [0] * b.count, "iqr": 0, "z": 0} for c, b in bins.items()}
    if bins:
        x = F.col("value")
        flags = {
            "iqr": ((x < F.col("iqr_p0")) | (x > F.col("iqr_p1")), fences),
            "z": (F.abs((x - F.col("z_p0")) / F.col("z_p1")) > 3, spreads),
        }
        for r in bin_counts(df, numeric, bins, flags).collect():
            s = shape[r["column"]]
            s["counts"][r["bin"]] = r["n"]
            s["iqr"] += r["iqr"]
            s["z"] += r["z"]

    unique = distinct_counts(df, {c: shown[c] for c in numeric}) | dict.fromkeys(texts, 0)
    tops: dict[str, list] = {c: [] for c in texts}
    if texts:
        shown_text = {c: shown[c].cast("string") for c in texts}
        for c, rank, value, n in ranked_values(df, shown_text, TOP, distinct=True):
            if rank:
                tops[c].append({"value": value, "count": n})
            else:
                unique[c] = n

    rows = []
    for c in columns:
        filled = (lengths if c in lengths else moments)[c]["n"]
        row = {
            "column": c,
            "type": "numeric" if c in numeric else "text",
            "total": total,
            "non_null": filled,
            "null_count": total - filled,
            "null_pct": round((total - filled) / total * 100, 2) if total else 0.0,
            "unique": unique[c],
            "completeness": round(filled / total * 100, 2) if total else 100.0,
        }
        if c in numeric:
            p5, q1, median, q3, p95 = quantiles[c]
            m = moments[c]
            row |= {k: m[k] for k in ("min", "max", "zeros", "negatives")}
            row |= {k: _round(m[k], 6) for k in ("mean", "std", "variance")}
            row |= {k: _round(m[k], 4) for k in ("skewness", "kurtosis", "sum")}
            row |= {"p5": p5, "q1": q1, "median": median, "q3": q3, "p95": p95}
            row["iqr"] = round(q3 - q1, 6)
            row["outliers_iqr"] = shape[c]["iqr"]
            row["outliers_z"] = shape[c]["z"]
            edges = [round(e, 4) for e in bins[c].edges()]
            row["histogram"] = {"counts": shape[c]["counts"], "edges": edges}
        else:
            row["top_values"] = tops[c]
            row["mode"] = tops[c][0]["value"] if tops[c] else ""
            row["avg_length"] = _round(lengths[c]["avg_length"], 1) or 0.0
        rows.append(row)
    names = T.StructType.fromDDL(PROFILE_SCHEMA).names
    return small_table(df.sparkSession, [tuple(map(r.get, names)) for r in rows], PROFILE_SCHEMA)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)`` of one column."""
    return cell_counts(df, {column: present(df, column).cast("string")}).select("value", "n")
