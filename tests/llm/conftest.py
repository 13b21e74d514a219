import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASHES = (
    "size", "key", "taken", "target", "copies", "score", "spans", "toxic_spans", "matches",
    "n_tokens", "digest", "root", "a", "labels", "n_words", "host", "template", "payload",
)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"wort{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, "the same few words stand here", "en", "a", 5),
        (1, "the same few words stand here", "en", "a", 5),
        (2, "The same  few words\nstand here", "en", "a", 5),
        (None, "the same few words stand here", None, None, None),
        (None, None, None, None, None),
        (3, None, "de", "b", 0),
        (4, "", "de", "b", 0),
        (5, " \t\n", "de", "", 3),
        (6, long, "en", "b", len(long)),
        (7, long + " tail", "en", "a", len(long)),
        (8, "a@b.co +1 (555) 123-4567 4111 1111 1111 1111 10.0.0.1 1 2", "en", "c", 1),
        (9, "x" * 100_000, "en", "c", 100_000),
        (10, "1." * 20_000, "en", "c", 1),
    ]
    df = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("false")
