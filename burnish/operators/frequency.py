"""Frequency tables: distinct counts, top values, modes, duplicate rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.names import cell
from burnish.operators.typing import data_columns, is_text, present
from burnish.plans.fused import SMALL_BYTES, estimated_bytes, melt, small_table

# Longer texts are grouped by their first characters and a SHA-256 digest, so
# that a shuffle carries at most about 130 characters per distinct text.
SHORT = 64
# A column's summary tracks this many texts (about half a megabyte), merged over this many groups
# of tasks first; of the most frequent ones so many are counted for each one asked for.
TRACKED, DEALS, CANDIDATES = 4096, 256, 16


def short_key(c: Column) -> Column:
    """A short stand-in, equal exactly when the texts are equal."""
    digest = F.concat(F.substring(c, 1, SHORT), F.lit("\u0001"), F.sha2(c.cast("binary"), 256))
    return F.when(F.length(c) <= SHORT, c).when(c.isNotNull(), digest)


def row_keys(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Grouping keys for whole rows; NULL equals NULL."""
    return [
        (short_key(cell(c)) if is_text(df.schema[c].dataType) else cell(c)).alias(f"__k{i}")
        for i, c in enumerate(columns)
    ]


def cell_counts(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """``(column, value, n)`` for several columns of one type; partial counts first."""
    return (
        melt(df, values)
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def keep_top(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per column; equal counts by smaller value.

    The rank filter is pushed below the shuffle: a task sends at most ``k`` rows per column.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_counts(df: DataFrame, keys: Mapping[str, Column], k: int) -> DataFrame:
    """Exact counts of texts, of all that may be among the ``k`` most frequent of a column.

    Spark's frequent-items sketch proposes texts, a second scan counts them; no other text leaves
    its task. A column whose sketch cannot rule the other texts out is counted in full.
    """
    found = _proposed(df, keys, min(k * CANDIDATES, TRACKED))
    candidates = [(c, text) for c, (_, _, texts) in found.items() for text in texts]
    schema = "column string, value string"
    wanted = F.broadcast(small_table(df.sparkSession, candidates, schema))
    chosen = melt(df, keys).join(wanted, ["column", "value"], "left_semi")
    counted: dict[str, list[tuple[str, str, int]]] = {c: [] for c in keys}
    for row in chosen.groupBy("column", "value").agg(F.count("*")).collect():
        counted[row[0]].append(tuple(row))
    whole, rows = [], []
    for c, (n, unseen, _) in found.items():
        counts = sorted((row[2] for row in counted[c]), reverse=True)
        unseen = min(unseen, n - sum(counts))
        if unseen and (len(counts) < k or counts[k - 1] <= unseen):
            whole.append(c)
        else:
            rows += counted[c]
    exact = small_table(df.sparkSession, rows, schema + ", n bigint")
    return exact.unionByName(cell_counts(df, {c: keys[c] for c in whole})) if whole else exact


def _proposed(
    df: DataFrame, keys: Mapping[str, Column], most: int
) -> dict[str, tuple[int, float, list[str]]]:
    """Per column the filled cells, the most that a text not proposed may count, and the texts.

    The sketch's counts are off by at most 3.5 cells in ``TRACKED``; it leaves out texts that it does not
    track and tracked ones below twice that error.
    """
    rows = (
        melt(df, keys)
        .filter(F.col("value").isNotNull())
        .withColumn("deal", F.spark_partition_id() % DEALS)
        .groupBy("column", "deal")
        .agg(F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("state"), F.count("*").alias("n"))
        .groupBy("column")
        .agg(F.expr(f"approx_top_k_combine(state, {TRACKED})").alias("state"), F.sum("n").alias("n"))
        .select("column", "n", F.expr(f"approx_top_k_estimate(state, {most})"))
        .collect()
    )
    out = {}
    for column, n, items in rows:
        least = min(r["count"] for r in items) if len(items) == most else 0
        out[column] = n, max(7.0 * n / TRACKED, least), [r["item"] for r in items]
    return out


def _by_type(df: DataFrame, values: Mapping[str, Column]) -> list[dict[str, Column]]:
    """Split into groups of one type each, so that a group can share one long form."""
    schema = df.select(*[v.alias(c) for c, v in values.items()]).schema
    groups: dict[str, dict[str, Column]] = {}
    for c, v in values.items():
        dtype = schema[c].dataType
        if isinstance(dtype, T.IntegralType):
            groups.setdefault("bigint", {})[c] = v.cast("bigint")
        elif isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
            groups.setdefault("double", {})[c] = v.cast("double")
        else:
            groups.setdefault(dtype.simpleString(), {})[c] = v
    return list(groups.values())


def _is_text_group(df: DataFrame, group: Mapping[str, Column]) -> bool:
    return is_text(df.select(next(iter(group.values())).alias("v")).schema["v"].dataType)


def _smallest_texts(
    df: DataFrame,
    group: Mapping[str, Column],
    counts: DataFrame,
    wanted: Mapping[tuple[str, int, str], int],
) -> dict[tuple[str, int, str], list[str]]:
    """The smallest long texts, in order, of each ``(column, n, first characters)`` wanted.

    Texts that share their count and their first characters are ranked by the whole text. At most
    ``k`` classes per column are asked for; a text is combined in every task before the shuffle.
    """
    classes = F.broadcast(
        small_table(
            df.sparkSession,
            [(*key, most) for key, most in wanted.items()],
            "column string, n bigint, head string, most int",
        )
    )
    long = F.length("value") > SHORT
    head = F.substring("value", 1, SHORT).alias("head")
    tied = (
        counts.filter(long)
        .select("column", F.col("value").alias("key"), "n", head)
        .join(classes, ["column", "n", "head"])
    )
    texts = (
        melt(df, group)
        .filter(long)
        .select("column", "value", head)
        .join(F.broadcast(classes.select("column", "head").distinct()), ["column", "head"], "left_semi")
        .groupBy("column", short_key(F.col("value")).alias("key"))
        .agg(F.min("value").alias("text"))
    )
    order = Window.partitionBy("column", "n", "head").orderBy("text")
    found = (
        texts.join(tied, ["column", "key"])
        .withColumn("place", F.row_number().over(order))
        .filter((F.col("place") <= max(wanted.values())) & (F.col("place") <= F.col("most")))
        .select("column", "n", "head", "place", "text")
        .collect()
    )
    out: dict[tuple[str, int, str], list[str]] = {}
    for column, n, start, _, text in sorted(tuple(r) for r in found):
        out.setdefault((column, n, start), []).append(text)
    return out


def ranked_values(
    df: DataFrame, values: Mapping[str, Column], k: int, distinct: bool = False
) -> list[tuple[str, int, object, int]]:
    """``(column, rank, value, n)`` of the ``k`` most frequent values of each column.

    ``distinct=True`` adds rank 0, whose ``n`` is the number of distinct values, from the same
    shuffle. At most ``k + 1`` rows per column reach the driver; of texts of large tables, whose
    counts come from ``top_counts`` unless all must be counted, ``CANDIDATES`` times as many.
    """
    out: list[tuple[str, int, object, int]] = []
    for group in _by_type(df, values):
        text = _is_text_group(df, group)
        keys = {c: short_key(v) for c, v in group.items()} if text else group
        large = text and not distinct and estimated_bytes(df) > SMALL_BYTES
        counts = top_counts(df, keys, k) if large else cell_counts(df, keys)
        rows = keep_top(counts, k).select("column", "rank", "value", "n")
        if distinct:
            none = F.lit(None).cast(rows.schema["value"].dataType)
            found = counts.groupBy("column").agg(F.count("*").alias("n"))
            rows = rows.union(found.select("column", F.lit(0), none, "n"))
        top = [tuple(r) for r in rows.collect()]
        cut = [
            (c, n, v[:SHORT]) if text and v is not None and len(v) > SHORT else None
            for c, _, v, n in top
        ]
        if any(cut):
            wanted = Counter(key for key in cut if key)
            whole = {k: iter(v) for k, v in _smallest_texts(df, group, counts, wanted).items()}
            by_rank = sorted(zip(top, cut), key=lambda r: r[0][:2])
            top = [(c, r, next(whole[key]) if key else v, n) for (c, r, v, n), key in by_rank]
        out += top
    return sorted(out, key=lambda r: (r[0], r[1]))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """``(column, rank, value, n)``: the ``k`` most frequent values, as whole text."""
    shown = {c: present(df, c).cast("string") for c in columns}
    rows = ranked_values(df, shown, k)
    return small_table(df.sparkSession, rows, "column string, rank int, value string, n bigint")


def distinct_counts(
    df: DataFrame, values: Mapping[str, Column], fold_case: bool = False
) -> dict[str, int]:
    """``{column: number of distinct non-null values}``, exact; one job per type."""
    found = dict.fromkeys(values, 0)
    for group in _by_type(df, values):
        if _is_text_group(df, group):
            group = {c: short_key(F.lower(v) if fold_case else v) for c, v in group.items()}
        found |= _count_distinct(df, group)
    return found


def _count_distinct(df: DataFrame, group: Mapping[str, Column]) -> dict[str, int]:
    rows = cell_counts(df, group).groupBy("column").agg(F.count("*").alias("u")).collect()
    return {r["column"]: r["u"] for r in rows}


def modes(df: DataFrame, values: Mapping[str, Column]) -> dict[str, object]:
    """Most frequent non-null value per column, the smallest on ties; None without values."""
    top = {c: v for c, _, v, _ in ranked_values(df, values, 1)}
    return {c: top.get(c) for c in values}


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(rows, distinct_rows, duplicates)``; NULL equals NULL."""
    keys = row_keys(df, columns or data_columns(df))
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )
