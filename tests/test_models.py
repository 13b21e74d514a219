"""Model-based operators: brute force, planted structure, determinism."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from burnish.operators import iterative, nearest
from burnish.operators.isolation import anomaly_scores
from burnish.operators.iterative import bayesian_ridge, impute_mice, impute_random_forest
from burnish.operators.multivariate import (
    correlations,
    leading_eigenvectors,
    principal_components,
)
from burnish.operators.nearest import impute_knn, neighbours
from burnish.plans import products
from workload import QUERIES, Tables


def with_nulls(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c != "id" else c for c in df.columns])


def gappy(n, seed, share=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    x[: n // 3] = 0.5
    x[rng.random((n, 3)) < share] = np.nan
    return x


def brute_force_knn(x, k):
    out, width, known = x.copy(), x.shape[1], ~np.isnan(x)
    for i in range(len(x)):
        for j in np.flatnonzero(~known[i]):
            shared = known & known[i]
            n = shared.sum(axis=1)
            d2 = np.where(
                n > 0, (np.where(shared, x - x[i], 0) ** 2).sum(axis=1) * width / np.maximum(n, 1),
                np.nan,
            )
            able = np.flatnonzero(known[:, j] & ~np.isnan(d2))
            if not len(able):
                out[i, j] = np.nanmean(x[:, j])
                continue
            able = able[np.lexsort((x[able, j], d2[able]))[:k]]
            d = np.sqrt(d2[able])
            w = np.where(d == 0, 1.0, 0.0) if (d == 0).any() else 1 / d
            out[i, j] = (w * x[able, j]).sum() / w.sum()
    return out


@pytest.mark.parametrize(
    "cell_rows,chunk,most_cells", [(2_000, 20_000, 20_000), (30, 25, 20_000), (30, 20_000, 3)]
)
def test_knn_is_exact(spark, monkeypatch, cell_rows, chunk, most_cells):
    """Many cells, split cells and mixed cells all find the true neighbours."""
    monkeypatch.setattr(nearest, "_CHUNK", chunk)
    monkeypatch.setattr(nearest, "MOST_CELLS", most_cells)
    x = gappy(900, 0)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(len(x)))
    got = impute_knn(with_nulls(spark, pdf), ["a", "b", "c"], 5, cell_rows).toPandas()
    got = got.sort_values("id")[list("abc")].to_numpy()
    assert np.allclose(got, brute_force_knn(x, 5), atol=1e-12)


def test_knn_defaults():
    assert [neighbours(n) for n in (0, 12, 39, 40, 100, 10_000)] == [1, 1, 1, 2, 5, 5]


def related(n=1_500, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=n)
    full = np.column_stack(
        [base, 2 * base + rng.normal(size=n) * 0.1, 5 - base + rng.normal(size=n) * 0.1]
    )
    holes = rng.random(full.shape) < 0.1
    return full, np.where(holes, np.nan, full), holes


@pytest.mark.parametrize("impute", [impute_mice, impute_random_forest])
def test_chained_imputers(spark, impute):
    full, gaps, holes = related()
    pdf = pd.DataFrame(gaps, columns=list("abc")).assign(id=np.arange(len(gaps)))
    options = {} if impute is impute_mice else {"rounds": 2, "trees": 10}
    got = impute(with_nulls(spark, pdf), ["a", "b", "c"], **options).toPandas().sort_values("id")
    got = got[list("abc")].to_numpy()
    assert not np.isnan(got).any()
    assert np.array_equal(got[~holes], gaps[~holes])
    plain_error = np.abs(np.nanmean(gaps, axis=0) - full)[holes].mean()
    assert np.abs(got - full)[holes].mean() < 0.25 * plain_error


def test_forests_learn_from_the_table_of_bins(spark, tmp_path, monkeypatch):
    """No fit reads the raw rows; infinite, equal and few values have bins."""
    rng = np.random.default_rng(3)
    n = 300
    pdf = pd.DataFrame({
        "kind": rng.integers(0, 3, n).astype(float), "same": 7.0, "id": np.arange(n),
        "far": np.where(rng.random(n) < 0.4, np.inf, 1.0),
    })
    pdf["y"] = np.where(rng.random(n) < 0.2, np.nan, pdf.kind * 10 + (pdf.far > 1))
    with_nulls(spark, pdf).write.parquet(str(tmp_path / "raw"))
    plans = []
    fit = iterative.RandomForestRegressor.fit
    monkeypatch.setattr(
        iterative.RandomForestRegressor, "fit",
        lambda self, df: plans.append(df.inputFiles()) or fit(self, df))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    got = impute_random_forest(raw, ["kind", "same", "far", "y"], rounds=2, trees=5)
    got = got.toPandas().sort_values("id")
    assert plans and not any("/raw/" in f for files in plans for f in files)
    assert np.array_equal(got["same"], pdf["same"]) and np.array_equal(got["far"], pdf["far"])
    assert np.allclose(got["y"], pdf.kind * 10 + (pdf.far > 1), atol=0.2)


@pytest.mark.parametrize("width,rounds", [(3, 10), (7, 1)])
def test_chained_ridge_by_pattern_and_by_rounds_agree(spark, monkeypatch, width, rounds):
    """Few and many columns, rows without gaps and without any value."""
    rng = np.random.default_rng(width)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, width)) + rng.normal(size=(400, width)) / 5
    x[rng.random(x.shape) < 0.15] = np.nan
    x[7] = np.nan
    names = [f"c{i}" for i in range(width)]
    df = with_nulls(spark, pd.DataFrame(x, columns=names).assign(id=np.arange(len(x))))
    scans = []
    largest = iterative._largest
    monkeypatch.setattr(iterative, "_largest", lambda *a: scans.append(1) or largest(*a))
    by_pattern = impute_mice(df, names, rounds).toPandas().sort_values("id")
    assert len(scans) <= 3
    monkeypatch.setattr(iterative, "MOST_SUMS", 0)
    by_rounds = impute_mice(df, names, rounds).toPandas().sort_values("id")
    assert not by_rounds.isna().any().any()
    assert np.allclose(by_pattern[names], by_rounds[names], rtol=1e-9, atol=1e-9)


def test_chained_imputers_leave_empty_columns(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, None), (2.0, None, None), (3.0, 6.0, None)], "a double, b double, c double"
    )
    got = impute_mice(df, ["a", "b", "c"]).orderBy("a").collect()
    assert all(r["c"] is None and r["b"] is not None for r in got)


def test_bayesian_ridge_recovers_a_plane():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=500) * 0.01
    rows = np.column_stack([np.ones(500), y, x])
    coef, intercept = bayesian_ridge(rows.T @ rows, 1)
    assert coef == pytest.approx([2, -1], abs=0.01) and intercept == pytest.approx(3, abs=0.01)


def test_isolation_forest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3_000, 2))
    x[:15] += 9
    df = spark.createDataFrame(
        pd.DataFrame(x, columns=["x", "y"]).assign(id=np.arange(len(x)))
    )
    first = anomaly_scores(df, 0.01, ["x", "y"], ["id"]).toPandas().sort_values("id")
    again = anomaly_scores(df.repartition(3), 0.01, ["x", "y"], ["id"]).toPandas().sort_values("id")
    assert first["_is_anomaly"].sum() == 30 and first["_is_anomaly"][first["id"] < 15].all()
    assert first["_anomaly_score"].between(-1, 0).all()
    assert first["_anomaly_score"].tolist() == again["_anomaly_score"].tolist()


def test_correlations_and_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    found = {(r[0], r[1]): r[2] for r in correlations(df).collect()}
    expected = np.corrcoef(x.T)
    assert found["a", "c"] == pytest.approx(expected[0, 2], abs=1e-4)
    out = principal_components(df, 3)
    values = np.linalg.eigvalsh(expected)[::-1]
    explained = [r["explained"] for r in out.explained.orderBy("component").collect()]
    assert explained == pytest.approx(values / values.sum())
    scores = out.scores.select("pc1", "pc2").toPandas().to_numpy()
    assert scores.var(axis=0) == pytest.approx(values[:2])


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert {r["correlation"] for r in correlations(df).collect()} == {None, 1.0}


@pytest.mark.parametrize("few", [2, 10])
def test_pair_sums_by_aggregate_and_by_matrices(spark, monkeypatch, few):
    from burnish.plans import products

    monkeypatch.setattr(products, "FEW_COLUMNS", few)
    x = gappy(400, 8) + 1e6
    x = np.column_stack([x, np.full(len(x), 3.3)])
    df = with_nulls(spark, pd.DataFrame(x, columns=list("abcd"))).repartition(6)
    found = {(r[0], r[1]): r[2] for r in correlations(df).collect()}
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = np.corrcoef(x[both, i], x[both, j])[0, 1]
            assert found[a, b] == pytest.approx(want, abs=6e-5)
    assert found["a", "d"] is None and found["d", "d"] is None
    full = df.dropna()
    rows = np.column_stack([np.ones(full.count()), *full.toPandas()[list("abc")].to_numpy().T])
    sums = products.gram(full, [F.col(c) for c in "abc"])
    assert np.allclose(sums, rows.T @ rows)


def test_tiles_and_blocks_of_wide_tables(spark, monkeypatch):
    """64 columns in tiles of 20 give what one matrix gives; equal columns, gaps, a constant."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 6)) @ rng.normal(size=(6, 64)) * 3 + rng.normal(size=(700, 64)) + 100
    x[:, 5], x[:, 41] = 7.0, x[:, 3]
    pdf = pd.DataFrame(x, columns=[f"c{i:02}" for i in range(64)])
    pdf = pdf.mask(rng.random(x.shape) < 0.03).assign(id=np.arange(len(x)))
    names = list(pdf.columns[:64])
    df = with_nulls(spark, pdf).repartition(5)

    def results():
        found = principal_components(df, 3, names)
        rows = correlations(df, names).collect()
        assert len(rows) == 64 * 64
        return (
            {(r[0], r[1]): r[2] for r in rows},
            found.explained.toPandas().sort_values("component").to_numpy(),
            found.loadings.toPandas().sort_values(["component", "feature"])["loading"].to_numpy(),
            found.scores.toPandas().sort_values("id")[["pc1", "pc2", "pc3"]].to_numpy(),
        )

    plain = results()
    monkeypatch.setattr(products, "TILE", 20)
    monkeypatch.setattr(products, "TILES", 4)
    tiled = results()
    assert plain[0].keys() == tiled[0].keys() and tiled[0]["c05", "c01"] is None
    for pair, value in plain[0].items():
        assert (value is None) == (tiled[0][pair] is None)
        assert value is None or abs(value - tiled[0][pair]) < 2e-4
    for one, other in zip(plain[1:], tiled[1:]):
        assert np.allclose(one, other, rtol=0, atol=1e-6)


def test_leading_eigenvectors():
    rng = np.random.default_rng(5)
    for p, k in [(3, 3), (40, 3), (200, 4)]:
        a = rng.normal(size=(p, 2 * p))
        a = a @ a.T / p
        values, vectors = leading_eigenvectors(lambda q: a @ q, p, k)
        exact, axes = np.linalg.eigh(a)
        assert np.allclose(values, exact[::-1][:k])
        assert np.allclose(np.abs(np.sum(vectors * axes[:, ::-1][:, :k], axis=0)), 1, atol=1e-8)
    flat, _ = leading_eigenvectors(lambda q: q * 0, 9, 2)
    assert np.allclose(flat, 0)


def test_forests_grow_on_cells_in_tasks(spark, monkeypatch):
    """Thousands of rows of some hundred cells need no fit over rows; copies change the draws only."""
    rng = np.random.default_rng(11)
    n = 400
    pdf = pd.DataFrame({
        "a": rng.integers(0, 20, n).astype(float), "b": rng.integers(0, 20, n).astype(float),
    })
    truth = np.where(pdf.a < 8, 10.0, 30.0) + np.where(pdf.b < 12, 0.0, 5.0)
    pdf["y"] = np.where(rng.random(n) < 0.2, np.nan, truth)
    pdf = pd.concat([pdf] * 10, ignore_index=True).assign(id=np.arange(10 * n))
    fits = []
    fit = iterative.RandomForestRegressor.fit
    monkeypatch.setattr(
        iterative.RandomForestRegressor, "fit", lambda self, df: fits.append(1) or fit(self, df))
    df = with_nulls(spark, pdf)
    got = impute_random_forest(df, ["a", "b", "y"], rounds=2, trees=10).toPandas()
    assert not fits
    assert np.allclose(got.sort_values("id")["y"], np.tile(truth, 10), atol=0.5)
    monkeypatch.setattr(iterative, "MOST_CELLS", 100)
    again = impute_random_forest(df, ["a", "b", "y"], rounds=1, trees=5).toPandas()
    assert fits and np.allclose(again.sort_values("id")["y"], np.tile(truth, 10), atol=0.5)


def test_trees_cut_half_way_between_the_bins_they_drew():
    """Bins that no row of a node has go to the nearer side."""
    seen = np.array([[b] for b in [*range(0, 11), *range(21, 32)]], dtype=np.int8)
    label = np.where(seen[:, 0] < 16, -1.0, 1.0)
    rows = np.full(len(seen), 50)
    parts = iterative._tree(seen, rows, label, 30, 64, np.random.default_rng(1))
    forest = iterative._Forest(*parts, np.array([0]))
    bins = np.arange(64, dtype=np.int8)[:, None]
    assert np.array_equal(forest.predict(bins), np.where(bins[:, 0] < 16, -1.0, 1.0))


def test_forests_of_many_cells_predict_where_they_grew(spark, monkeypatch):
    """Trees that answer in their tasks, block by block, say what trees that are sent say."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame(rng.integers(0, 15, (1500, 3)).astype(float), columns=list("abc"))
    pdf["y"] = np.where(rng.random(1500) < 0.3, np.nan, pdf.a * 3 + (pdf.b > 6) + pdf.c)
    pdf.loc[rng.random(1500) < 0.1, "c"] = np.nan
    df = with_nulls(spark, pdf.assign(id=np.arange(1500)))

    def filled():
        got = impute_random_forest(df, ["a", "b", "c", "y"], rounds=2, trees=4).toPandas()
        return got.sort_values("id").reset_index(drop=True)

    sent = filled()
    monkeypatch.setattr(iterative, "SENT_CELLS", 100)
    monkeypatch.setattr(iterative, "ASKED_CELLS", 100)
    monkeypatch.setattr(iterative, "_grown", None)
    pd.testing.assert_frame_equal(filled(), sent, rtol=1e-9)


def test_trees_of_many_nodes_are_grown_in_parts(monkeypatch):
    rng = np.random.default_rng(13)
    cells = np.unique(rng.integers(0, 64, (3000, 3)).astype(np.int8), axis=0)
    args = cells, rng.integers(1, 9, len(cells)), rng.normal(size=len(cells)), 30, 64
    whole = iterative._tree(*args, np.random.default_rng(1))
    monkeypatch.setattr(iterative, "NODES_AT_ONCE", 7)
    parts = iterative._tree(*args, np.random.default_rng(1))
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_forests_on_many_rows_and_cells_need_no_fit_over_rows(spark, monkeypatch, tmp_path):
    """Customers with balances of their own, and three continuous columns (over 32,768 cells)."""
    fits = []
    monkeypatch.setattr(iterative.RandomForestRegressor, "fit", lambda self, df: fits.append(1))
    spark.range(40_000).select(
        F.col("id").alias("c_custkey"), (F.rand(1) * 25).cast("int").alias("c_nationkey"),
        F.round(F.rand(2) * 11000 - 1000, 2).alias("c_acctbal"),
        F.element_at(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "AUTOMOBILE"))),
                     (F.col("id") % 3 + 1).cast("int")).alias("c_mktsegment"),
    ).write.parquet(str(tmp_path / "customer.parquet"))
    got = QUERIES["random_forest_fills_gaps_alone"].run(Tables(spark, str(tmp_path))).first()
    assert tuple(got) == (40_000, 0, 0, 3637, 3077) and not fits
    x = [F.rand(i) for i in (3, 4, 5)]
    df = spark.range(60_000).select("id", *[c.alias(n) for c, n in zip(x, "abc")])
    truth = F.col("a") * 4 + F.col("b") + F.col("c")
    df = df.withColumn("y", F.when(F.col("id") % 10 != 0, truth))
    got = impute_random_forest(df, ["a", "b", "c", "y"], rounds=1, trees=3).where("id % 10 = 0")
    assert got.agg(F.max(F.abs(F.col("y") - truth))).first()[0] < 0.5 and not fits
