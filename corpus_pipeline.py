"""From raw documents to a training mix: five stages, each one operator of ``burnish.llm``.

Every stage gets ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and
read again as the next stage's documents. All but the last return the columns of ``documents``.

1. toxicity: documents that score 0.5 or more go.
2. near_duplicates: of every class of equal or nearly equal texts one document stays.
3. decontamination: documents that hold a benchmark item go.
4. personal_data: spans are replaced by their kind; ``n_chars`` follows the new text.
5. mixing: documents that the mix reaches stay, with ``size, source_size, target, taken, copies``.

Defined results: an empty table passes through as an empty table; null texts are never toxic by
their words, near duplicates or contaminated, and stay null; other rules are the operators' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm import decontaminate, mixing, ngram_join, pii, toxicity
from burnish.llm.common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn(
        "n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: A random field and MinHash are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
