"""Correlation matrix and principal components."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.operators.chart import running_share
from burnish.operators.impute import medians_of_gaps
from burnish.operators.typing import number, numeric_columns
from burnish.plans import products
from burnish.plans.fused import column_aggregates, small_table, working_copy
from burnish.plans.products import PairSums, pair_sums, tile_rows, times_own_rows

DEFAULT_COMPONENTS = 3
# Columns of a search block beyond the wanted components, and the residual that ends the search.
SPARE, RESIDUAL, SEED = 8, 1e-10, 11


def _numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    columns = list(numeric_columns(df) if columns is None else columns)
    if len(columns) < 2:
        raise ValueError("need at least two numeric columns")
    return columns


def _spread(sums: PairSums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances and covariances of all pairs, and each column's own deviation; 0 if constant."""
    n = np.maximum(sums.n, 1)
    mean = sums.x / n
    variance = sums.xx / n - mean**2
    # What is left of a constant column is the rounding of its mean.
    noise = (1e-13 * np.maximum(np.abs(sums.centre), 1e-300)[:, None]) ** 2
    variance = np.where(variance > noise, variance, 0.0)
    return variance, sums.xy / n - mean * mean.T, np.sqrt(np.diag(variance))


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_a, column_b, correlation)`` for all pairs, Pearson, 4 decimals.

    Each pair uses the rows where both are filled. A constant column gives NULL, also with
    itself. One scan takes the means, a second one all pairs; those of hundreds of columns are
    rows that the tasks make from their tiles.
    """
    columns = _numeric(df, columns)
    if len(columns) > products.TILE:
        return _tiled_correlations(df, columns)
    sums = pair_sums(df, {c: number(df, c) for c in columns})
    variance, covariance, _ = _spread(sums)
    scale = np.sqrt(variance * variance.T)
    rows = [
        (a, b, round(float(covariance[i, j] / scale[i, j]), 4) if scale[i, j] else None)
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return small_table(
        df.sparkSession, rows, "column_a string, column_b string, correlation double"
    )


def _tiled_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    values = {c: number(df, c) for c in columns}
    stats = column_aggregates(df, values, lambda x: {"n": F.count(x), "mean": F.avg(x)})
    centre = np.array([stats[c]["mean"] or 0.0 for c in columns])
    noise = (1e-13 * np.maximum(np.abs(centre), 1e-300)) ** 2
    names = np.array(columns, dtype=object)

    def finish(i: int, js: slice, sums: np.ndarray) -> pd.DataFrame:
        n, x, xx, y, yy, xy = sums
        n = np.maximum(n, 1)
        first, second = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2
        varies = (first > noise[i]) & (second > noise[js])
        scale = np.sqrt(np.where(varies, first * second, 1.0))
        # Each pair once: a tile on the diagonal holds them twice.
        kept = np.arange(js.start, js.stop) >= i
        found = np.round((xy / n - x * y / n**2) / scale, 4).astype(object)
        found = np.where(varies, found, None)[kept]
        one, other = np.full(kept.sum(), columns[i], dtype=object), names[js][kept]
        twice = other != columns[i]
        return pd.DataFrame({
            "column_a": np.concatenate([one, other[twice]]),
            "column_b": np.concatenate([other, one[twice]]),
            "correlation": np.concatenate([found, found[twice]]),
        })

    away = [x - F.lit(float(m)) for x, m in zip(values.values(), centre)]
    return tile_rows(df, away, finish, "column_a string, column_b string, correlation double")


def leading_eigenvectors(
    times: Callable[[np.ndarray], np.ndarray], p: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, and vectors, of a symmetric matrix known by its products.

    A random block and its images under the matrix span a space that grows by a block for every
    product, until the vectors found in it fit the matrix or it is the whole space.
    """
    block = np.linalg.qr(np.random.default_rng(SEED).normal(size=(p, min(p, k + SPARE))))[0]
    basis, images = np.zeros((p, 0)), np.zeros((p, 0))
    while True:
        image = times(block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        inner = basis.T @ images
        values, within = np.linalg.eigh((inner + inner.T) / 2)
        first = np.argsort(-values, kind="stable")[:k]
        values, within = values[first], within[:, first]
        vectors = basis @ within
        left = np.linalg.norm(images @ within - vectors * values, axis=0).max(initial=0.0)
        if left <= RESIDUAL * np.abs(values).max(initial=0.0) or basis.shape[1] == p:
            return values, vectors
        for _ in range(2):
            image = image - basis @ (basis.T @ image)
        new, sizes, _ = np.linalg.svd(image, full_matrices=False)
        block = new[:, sizes > 1e-13 * np.abs(values).max()][:, : p - basis.shape[1]]
        if not block.shape[1]:
            return values, vectors


def _leading_components(
    df: DataFrame, filled: dict[str, Column], n: int, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations, largest eigenvalues and their vectors, without a matrix of all pairs."""
    with working_copy(df.select(*[x.alias(f"x{i}") for i, x in enumerate(filled.values())])) as rows:
        xs = {c: F.col(f"x{i}") for i, c in enumerate(filled)}
        stats = column_aggregates(rows, xs, lambda x: {"mean": F.avg(x), "far": F.stddev_pop(x)})
        mean = np.array([stats[c]["mean"] or 0.0 for c in filled])
        scale = np.array([stats[c]["far"] or 0.0 for c in filled])
        scale = np.where(scale > 1e-13 * np.maximum(np.abs(mean), 1e-300), scale, 0.0)
        away = [
            (x - F.lit(float(m))) / F.lit(float(s)) if s else F.lit(0.0)
            for x, m, s in zip(xs.values(), mean, scale)
        ]
        values, weights = leading_eigenvectors(
            lambda q: times_own_rows(rows, away, q) / max(n, 1), len(filled), k
        )
    return mean, scale, values, weights


@dataclass(frozen=True)
class Components:
    """``explained``: one row per component; ``loadings``: component x feature; ``scores``: rows."""

    explained: DataFrame
    loadings: DataFrame
    scores: DataFrame


def principal_components(
    df: DataFrame, components: int = DEFAULT_COMPONENTS, columns: Sequence[str] | None = None
) -> Components:
    """PCA of the standardised numeric columns, gaps at the median.

    One scan takes the medians, one the means, one the sums of all pairs; the components are the
    eigenvectors of the correlation matrix, the scores a sum over the columns. With hundreds of
    columns the leading eigenvectors come from products with blocks of vectors, a scan each. Scores use the
    population deviation; without any variance the shares are NULL. A component's sign makes its largest loading
    positive. ``scores`` is the input with ``pc1 .. pck``.
    """
    columns = _numeric(df, columns)
    medians, n = medians_of_gaps(df, columns)
    filled = {c: F.coalesce(number(df, c), F.lit(medians.get(c, 0.0))) for c in columns}
    k = min(components, len(columns), n)
    wide = len(columns) > products.TILE and k > 0
    if wide:
        mean, scale, values, weights = _leading_components(df, filled, n, k)
        total = float(np.count_nonzero(scale))
    else:
        sums = pair_sums(df, filled)
        _, covariance, scale = _spread(sums)
        mean = sums.centre + np.diag(sums.x) / max(n, 1)
        unit = np.where(scale > 0, scale, 1.0)
        within = covariance / np.outer(unit, unit) * np.outer(scale > 0, scale > 0)
        values, weights = np.linalg.eigh(within)
        first = np.argsort(-values, kind="stable")[:k]
        values, weights, total = values[first], weights[:, first], np.sum(values)
    values, unit = np.maximum(values, 0.0), np.where(scale > 0, scale, 1.0)
    largest = np.abs(weights).argmax(axis=0)
    weights = weights * np.where(weights[largest, np.arange(k)] < 0, -1.0, 1.0)
    spark = df.sparkSession
    explained = running_share(
        small_table(
            spark,
            [(i + 1, float(v / total) if total > 0 else None) for i, v in enumerate(values)],
            "component int, explained double",
        ),
        "component",
        "explained",
        "cumulative",
    )
    loadings = small_table(
        spark,
        [(i + 1, c, float(weights[j, i]))
         for i in range(k) for j, c in enumerate(columns)],
        "component int, feature string, loading double",
    )
    away = {c: (x - F.lit(float(m))) / F.lit(float(u)) for (c, x), m, u in zip(filled.items(), mean, unit)}
    factors = weights * (scale > 0)[:, None]
    if wide:
        # One array of the row's values, since a sum of hundreds of terms is too deep a tree.
        cells = F.array(*away.values())
        scored = [
            F.aggregate(
                F.zip_with(cells, F.lit(factors[:, i].tolist()), lambda a, w: a * w),
                F.lit(0.0), lambda total, x: total + x,
            )
            for i in range(k)
        ]
    else:
        scored = [
            sum((a * F.lit(float(factors[j, i])) for j, a in enumerate(away.values())), F.lit(0.0))
            for i in range(k)
        ]
    scores = df.select(
        *[cell(c) for c in df.columns], *[x.alias(f"pc{i + 1}") for i, x in enumerate(scored)]
    )
    return Components(explained, loadings, scores)
