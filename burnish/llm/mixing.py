"""Mix sources to target weights: hash-random order, distributed prefix sums, a cut per source.

Every document gets a hash-random key. Inside a source the documents are ordered by
``(key, doc_id, size)`` and cut where the running total reaches the source's budget; a budget
beyond the source's size is met by whole epochs first. The cut is one row per source, so the
plan is applied to the documents by a join on the source and the texts are never shuffled.

Defined results: a null or empty text has size 0 and takes no words; a null ``source`` is a
source of its own, last in order; rows that repeat ``(doc_id, size)`` at the cut share what is
left of the budget evenly, rounded down; an empty table gives an empty result; columns of other
names are ignored by the plan and kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import (
    hash_key,
    ranked,
    running_before,
    shuffle_partitions,
    word_count,
    written,
)

_KEY_RANGE = float(1 << 60)


def sized(df: DataFrame, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, key`` of every document."""
    return df.select(
        F.col("doc_id"),
        F.col("source"),
        word_count(F.col("text")).alias("size"),
        hash_key(F.lit(seed), F.col("doc_id")).alias("key"),
    )


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
             most: int = 2) -> DataFrame:
    """One row per source: its size, target, whole epochs and where the last epoch is cut.

    ``docs`` is what ``sized`` gives, written down. Sources take the weights in code point
    order, in turn. The targets add up to ``share`` of all words; one that would pass ``most``
    times its source's size stops there and the others share the rest by weight.
    """
    spark = docs.sparkSession
    totals = docs.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")
    )
    totals = ranked(
        totals, [F.col("source").isNull(), F.col("source")], "place", "mix-sources"
    )
    weight = F.element_at(
        F.array(*[F.lit(int(w)).cast("long") for w in weights]),
        (F.col("place") % len(weights) + 1).cast("int"),
    )
    totals = written(totals.withColumn("weight", weight).drop("place"), "mix-weights")
    level = _level(totals, share, most)
    cap = F.col("source_size") * most
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    rows = totals.agg(F.sum("docs")).first()[0] or 0
    per_bucket = max(1.0, rows / (8 * shuffle_partitions(spark)))
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    sources = (
        totals.withColumn("target", target)
        .withColumn("epochs", whole)
        .withColumn(
            "rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long")
        )
        .withColumn("buckets", F.ceil(F.col("docs") / F.lit(per_bucket)))
        .drop("docs", "weight")
    )
    sources = written(sources, "mix-targets")
    same = docs.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    small = sources.select(F.col("source").alias("__source"), "rest", "buckets")
    placed = (
        same.join(small, F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("bucket", F.floor(F.col("key") / F.lit(_KEY_RANGE) * F.col("buckets")))
        .withColumn("words", F.col("size") * F.col("copies"))
    )
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    before = running_before(placed, ["source"], "bucket", order, "words", "before")
    cut = before.where(
        (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    ).select(
        F.col("source").alias("__source"),
        F.col("key").alias("cut_key"),
        F.col("doc_id").alias("cut_doc"),
        F.col("size").alias("cut_size"),
        F.floor((F.col("rest") - F.col("before")) / F.col("copies")).alias("cut_words"),
    )
    plan = sources.join(cut, F.col("source").eqNullSafe(F.col("__source")), "left")
    return written(
        plan.drop("__source", "buckets", "rest").withColumnRenamed("source", "__source"),
        "mix-plan",
    )


def _level(totals: DataFrame, share: float, most: int) -> float:
    """Words per unit of weight at which the capped targets add up to the share.

    The usual resharing: sources above their cap are set to it, the others share what is left.
    A round reads one row per source; the number of capped sources only grows.
    """
    size, weight = F.col("source_size"), F.col("weight")
    words, weights = totals.agg(F.sum("source_size"), F.sum("weight")).first()
    if not words or not weights:
        return 0.0
    level, capped = words * share / weights, 0
    while True:
        over = size * most <= weight * F.lit(level)
        n, held, free = totals.agg(
            F.count(F.when(over, 1)),
            F.coalesce(F.sum(F.when(over, size * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, weight)), F.lit(0)),
        ).first()
        if n == capped or not free:
            return level
        level, capped = (words * share - held) / free, n


def apply_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``source_size, target, taken, copies`` to rows that have ``source, doc_id, size, key``.

    ``copies`` is the number of epochs that reach the document, ``taken`` its words over them.
    """
    at = F.struct("key", "doc_id", "size")
    cut = F.struct(F.col("cut_key"), F.col("cut_doc"), F.col("cut_size"))
    inside = F.col("cut_key").isNotNull() & (at < cut)
    on_cut = F.col("cut_key").isNotNull() & at.eqNullSafe(cut)
    last = F.when(inside, F.col("size")).when(on_cut, F.col("cut_words")).otherwise(F.lit(0))
    return (
        docs.join(plan, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("taken", (F.col("epochs") * F.col("size") + last).cast("long"))
        .withColumn(
            "copies",
            F.col("epochs")
            + F.when(inside | (on_cut & (F.col("cut_words") > 0)), 1).otherwise(0),
        )
        .drop("__source", "epochs", "cut_key", "cut_doc", "cut_size", "cut_words")
    )


def mix(df: DataFrame, **options) -> DataFrame:
    """The documents the mix reaches, with ``size, source_size, target, taken, copies`` added.

    Columns of ``df`` with one of these names are replaced. A document is reached when at least
    one epoch comes to it before the cut.
    """
    added = ("size", "source_size", "target", "taken", "copies")
    names = [c for c in df.columns if c not in added]
    plan = plan_mix(written(sized(df), "mix-sizes"), **options)
    docs = df.drop(*added).withColumn("__key", F.col("key") if "key" in names else F.lit(0))
    docs = docs.withColumn("size", word_count(F.col("text"))).withColumn(
        "key", hash_key(F.lit("mix"), F.col("doc_id"))
    )
    mixed = apply_plan(docs, plan).where(F.col("copies") > 0)
    kept = [F.col("__key").alias("key") if c == "key" else F.col(f"`{c}`") for c in names]
    return mixed.select(*kept, *added)
