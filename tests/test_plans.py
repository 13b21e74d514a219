"""Exact order statistics, ordered fills and grouped ranks against small brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from burnish.operators import frequency
from burnish.operators.chart import group_medians
from burnish.operators.dedup import drop_duplicate_rows
from burnish.operators.frequency import cell_counts, keep_top, top_values
from burnish.operators.impute import impute_fill
from burnish.plans import fused, ordered, quantiles, repeats
from burnish.plans.quantiles import exact_quantiles

PROBABILITIES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def numbers(rng, n):
    hot = rng.normal(size=n).round(2)
    hot[: n // 3] = 0.25
    return pd.DataFrame(
        {
            "normal": rng.normal(size=n),
            "skewed": rng.exponential(50, size=n).round(1),
            "few": rng.integers(0, 4, size=n).astype(float),
            "constant": np.full(n, 7.0),
            "hot": rng.permutation(hot),
        }
    )


@pytest.fixture
def scans(monkeypatch):
    """The bits that each scan has counted."""
    seen, scan = [], quantiles._scan

    def counted(wide, open_, done, upto):
        seen.append(upto)
        return scan(wide, open_, done, upto)

    monkeypatch.setattr(quantiles, "_scan", counted)
    return seen


@pytest.mark.parametrize("few,most", [(1 << 22, [64]), (9_000, [16, 64]), (0, [16, 32, 48, 64])])
@pytest.mark.parametrize("interpolate", [True, False])
def test_exact_quantiles(spark, monkeypatch, scans, few, most, interpolate):
    """All bits at once, two scans, and sixteen bits a time give the same numbers."""
    monkeypatch.setattr(quantiles, "FEW_VALUES", few)
    monkeypatch.setattr(quantiles, "_PENDING", 2)
    pdf = numbers(np.random.default_rng(3), 9_001)
    df = spark.createDataFrame(pdf).repartition(5)
    found = exact_quantiles(
        df, {c: F.col(c) for c in pdf.columns}, PROBABILITIES, interpolate=interpolate
    )
    for c in pdf.columns:
        if interpolate:
            expected = [np.quantile(pdf[c], p) for p in PROBABILITIES]
        else:
            ordered_ = np.sort(pdf[c].to_numpy())
            expected = [ordered_[min(int(len(pdf) * p), len(pdf) - 1)] for p in PROBABILITIES]
        assert found[c] == pytest.approx(expected, abs=1e-12)
    assert scans[-1] == 64 and len(scans) <= 4 and (few == 9_000 or scans == most)


@pytest.mark.parametrize("few", [1 << 22, 2_000, 0])
def test_quantiles_of_infinite_values(spark, monkeypatch, scans, few):
    """Infinite values and the largest doubles, next to a column without any."""
    monkeypatch.setattr(quantiles, "FEW_VALUES", few)
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=6_000)
    mixed[:2_000], mixed[2_000:3_500] = np.inf, -np.inf
    mixed[3_500:3_520] = np.finfo(float).max
    pdf = pd.DataFrame({"mixed": rng.permutation(mixed), "plain": rng.normal(size=6_000)})
    df = spark.createDataFrame(pdf).repartition(4)
    columns = {c: F.col(c) for c in pdf.columns}
    found = exact_quantiles(df, columns, PROBABILITIES, interpolate=False)
    for c in pdf.columns:
        sorted_ = np.sort(pdf[c].to_numpy())
        assert found[c] == [sorted_[min(int(6_000 * p), 5_999)] for p in PROBABILITIES]
    assert len(scans) <= 4
    ends = spark.createDataFrame([(-np.inf,), (np.inf,)], "x double")
    assert exact_quantiles(ends, {"x": F.col("x")}, (0.0, 0.5, 1.0)) == {"x": [-np.inf, None, np.inf]}


def test_long_texts_with_one_opening_rank_by_the_whole_text(spark):
    texts = ["o" * 70 + c for c in "dbca"] * 2 + ["o" * 70 + "z"] * 3 + ["short"] * 2
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = [(r["value"][-1], r["n"]) for r in top_values(df, ["x"], 4).orderBy("rank").collect()]
    assert got == [("z", 3), ("a", 2), ("b", 2), ("c", 2)]


def test_first_of_a_group_is_limited_below_the_shuffle(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    kept = drop_duplicate_rows(df, "keep_last", ["k"], ["id"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan
    assert sorted(r["id"] for r in kept.collect()) == list(range(93, 100))


@pytest.mark.parametrize("keep", ["keep_first", "keep_last", "drop_all"])
@pytest.mark.parametrize("words", [1 << 18, 1])
def test_only_rows_that_may_repeat_are_shuffled(spark, monkeypatch, keep, words):
    """A full bitmap and one of a single word give the rows of the plan for small tables."""
    df = spark.range(3_000).selectExpr(
        "id", "if(id % 50 = 0, id % 100, id) AS k", "if(id % 7 = 0, NULL, 'a') AS t",
        "if(id % 3 = 0, 0.0D, -0.0D) AS z", "repeat('long ', 40) AS wide",
    )
    keys = ["k", "t", "z", "wide"]
    expected = sorted(drop_duplicate_rows(df, keep, keys, ["id"]).collect())
    assert len(expected) < 3_000
    monkeypatch.setattr(fused, "SMALL_BYTES", -1)
    monkeypatch.setattr(repeats, "WORDS", words)
    assert sorted(drop_duplicate_rows(df, keep, keys, ["id"]).collect()) == expected
    once, others = repeats.split_repeats(df, [F.col(c) for c in keys])
    assert once.count() + others.count() == 3_000
    if words > 1:
        assert others.count() < 80
    whole = df.drop("id").union(df.drop("id"))
    assert drop_duplicate_rows(whole).count() == df.drop("id").distinct().count()


def test_quantiles_of_signs_and_tiny_numbers(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW_VALUES", 0)
    values = [-0.0, 0.0, 5e-324, -5e-324, 1.0, -1.0, 1e308, -1e308, 2.0**-1040]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ranks = list(range(len(values)))
    found = quantiles.order_statistics(df, {"x": F.col("x")}, {"x": ranks}, {"x": len(values)})
    assert [found["x"][r] for r in ranks] == sorted(values)


def test_quantiles_of_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    found = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, (0.5,))
    assert found == {"a": [2.0], "b": [None]}


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("grouped", [False, True])
def test_fill_across_ranges(spark, monkeypatch, backward, grouped):
    """Gaps longer than a range take their value from a range further away."""
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 50)
    n = 1_000
    rows = [
        (i, "hot" if i < 700 else f"g{i // 90}", float(i) if i % 171 == 20 else None)
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "i int, g string, v double").repartition(7)
    filled = impute_fill(df, ["v"], ["i"], backward, ["g"] if grouped else [])
    got = filled.toPandas().sort_values("i")["v"].to_numpy()
    pdf = pd.DataFrame(rows, columns=["i", "g", "v"])
    series = pdf.groupby("g")["v"] if grouped else pdf["v"]
    want = (series.bfill() if backward else series.ffill()).to_numpy()
    assert np.array_equal(got, want, equal_nan=True)


def test_group_medians_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 100)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(
        {"label": np.where(rng.random(4_000) < 0.4, "hot", rng.integers(0, 30, 4_000).astype(str)),
         "y": rng.integers(0, 900, 4_000).astype(float)}
    )
    got = {r["label"]: r["value"] for r in group_medians(spark.createDataFrame(pdf)).collect()}
    want = pdf.groupby("label")["y"].apply(lambda s: sorted(s)[len(s) // 2]).to_dict()
    assert got == want


def test_top_values_limit_before_the_shuffle(spark):
    df = spark.range(1_000).select((F.col("id") % 50).alias("v"))
    plan = keep_top(cell_counts(df, {"v": F.col("v")}), 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("kind", ["hot", "even", "few", "unique", "none"])
def test_top_values_of_large_tables(spark, monkeypatch, kind):
    """The summary's candidates give the plain result; it says itself when it cannot tell."""
    texts = {
        "hot": "CASE WHEN id % 2 = 0 THEN concat('t', id % 24 DIV 2) "
               "WHEN id % 5 = 1 THEN repeat('long', 40 + id % 2) ELSE concat('u', id) END",
        "even": "concat('e', id % 7000)", "few": "concat('f', id % 9)", "unique": "concat('u', id)",
        "none": "CAST(NULL AS STRING)",
    }
    df = spark.range(0, 42_000, 1, 12).selectExpr(f"{texts[kind]} AS x", "concat('y', id % 3) AS y")
    plain = [tuple(r) for r in top_values(df, ["x", "y"], 13).collect()]
    counted = []
    counts = frequency.cell_counts
    monkeypatch.setattr(
        frequency, "cell_counts", lambda df, values: counted.extend(values) or counts(df, values))
    monkeypatch.setattr(frequency, "SMALL_BYTES", 0)
    assert [tuple(r) for r in top_values(df, ["x", "y"], 13).collect()] == plain
    assert counted == (["x"] if kind in ("even", "unique") else [])
