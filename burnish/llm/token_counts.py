"""Token counts: one exact histogram of encoded lengths answers every context limit.

Each text is encoded whole by a given byte-pair vocabulary (``encoding``); documents are aggregated
by length. Suffix sums over the histogram give, for every length taken as a context limit, how many documents
and tokens reach it, what a cut at the limit leaves, and the quantile it stands for; ``at_limits``
derives the same for any other limit.

The vocabulary file (a base64 token and its rank per line) is read by the driver and broadcast;
it has a fixed size. The histogram has at most one row per different length, and its suffix sums
are taken in ranges of lengths.

Defined results: null and empty texts have 0 tokens and count as documents; special tokens in a
text are ordinary text; repeated rows all count; an empty table gives no rows. Long runs of white
space are encoded as the pieces they are, without a search (``encoding``), so any length is safe.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.common import running_before, written
from burnish.llm.encoding import VOCABULARY, encoder_of, shared_vocabulary

#: Lengths that are summed together before the sums across.
RANGE = 256


def encoder(spark: SparkSession, path: str = VOCABULARY):
    """A function of a text column: its number of tokens."""
    vocabulary = shared_vocabulary(spark, path)

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        own = encoder_of(vocabulary)
        return pa.array([len(own.ids(t.as_py() or "")) for t in texts], pa.int64())

    return lambda text: count(text)


def token_counts(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``n_tokens`` of every row beside its columns; one of that name is replaced."""
    length: Column = encoder(df.sparkSession, path)(F.col(f"`{text}`"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != "n_tokens"]
    return df.select(*kept, length.alias("n_tokens"))


def length_histogram(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """A row per encoded length ``n_tokens``, which also stands for a context limit.

    ``n_docs`` documents have this length, ``docs_ge`` at least it, with ``tokens_ge`` tokens;
    ``tokens_kept`` is the total after every document is cut to the limit, ``docs_cut`` of them
    lose something; ``quantile`` is the share of documents of at most this length.
    """
    length = encoder(df.sparkSession, path)(F.col(f"`{text}`"))
    lengths = df.select(length.alias("n_tokens")).groupBy("n_tokens")
    hist = written(lengths.agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    docs, tokens = hist.agg(F.sum("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens"))).first()
    hist = hist.select(
        "*",
        (F.col("n_docs") * F.col("n_tokens")).alias("tokens"),
        (-F.floor(F.col("n_tokens") / RANGE)).alias("range"),
        F.lit(0).alias("all"),
    )
    down = [F.col("n_tokens").desc()]
    hist = running_before(hist, ["all"], "range", down, "n_docs", "docs_cut")
    hist = running_before(hist, ["all"], "range", down, "tokens", "tokens_gt")
    docs_ge = F.col("docs_cut") + F.col("n_docs")
    tokens_ge = F.col("tokens_gt") + F.col("tokens")
    return hist.select(
        "n_tokens",
        "n_docs",
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        "docs_cut",
        (F.lit(tokens or 0) - tokens_ge + F.col("n_tokens") * docs_ge).alias("tokens_kept"),
        ((F.lit(docs or 0) - F.col("docs_cut")) / F.lit(float(docs or 1))).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: Iterable[int]) -> DataFrame:
    """The rows of ``length_histogram`` for any context limits, in the same columns.

    A limit that is no document's length is derived from the next larger one; ``n_docs`` is 0
    there. ``quantile`` is null if there are no documents. Limits are a stated, small list.
    """
    asked = sorted({int(x) for x in limits})
    if asked and asked[0] < 0:
        raise ValueError("a context limit is 0 at least")
    docs, tokens = histogram.agg(F.max("docs_ge"), F.max("tokens_ge")).first()
    rows = histogram.sparkSession.createDataFrame([(x,) for x in asked], "asked long")
    next_row = F.min(F.struct("n_tokens", "n_docs", "docs_ge", "tokens_ge", "docs_cut"))
    larger = histogram.join(F.broadcast(rows), F.col("n_tokens") >= F.col("asked"))
    found = rows.join(larger.groupBy("asked").agg(next_row.alias("next")), "asked", "left")
    hit = F.col("next.n_tokens").eqNullSafe(F.col("asked"))
    docs_ge = F.coalesce("next.docs_ge", F.lit(0))
    tokens_ge = F.coalesce("next.tokens_ge", F.lit(0))
    docs_cut = F.when(hit, F.col("next.docs_cut")).otherwise(docs_ge)
    share = (F.lit(docs or 0) - docs_cut) / F.lit(float(docs or 1))
    return found.select(
        F.col("asked").alias("n_tokens"),
        F.when(hit, F.col("next.n_docs")).otherwise(F.lit(0)).cast("long").alias("n_docs"),
        docs_ge.cast("long").alias("docs_ge"),
        tokens_ge.cast("long").alias("tokens_ge"),
        docs_cut.cast("long").alias("docs_cut"),
        (F.lit(tokens or 0) - tokens_ge + F.col("asked") * docs_ge).cast("long")
        .alias("tokens_kept"),
        F.when(F.lit(bool(docs)), share).alias("quantile"),
    )
