"""Isolation forest (Liu, Ting, Zhou 2008): bounded samples, trees in tasks, parallel scoring.

The training rows are a fixed-size random sample whatever the size of the table. Each
tree grows in its own task from its own draw of that sample; the trees, at most a few
hundred nodes each, travel back and score every row in Arrow batches. The score that
separates the wanted share of rows is an exact quantile of all scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.operators.impute import medians_of_gaps
from burnish.operators.typing import number, numeric_columns
from burnish.plans.materialize import stored
from burnish.plans.quantiles import exact_quantiles
from burnish.plans.shipping import ship

SCORE, IS_ANOMALY = "_anomaly_score", "_is_anomaly"
TREES, SAMPLE, SEED = 100, 256, 42
_MARGIN = 1.5
_EULER = 0.5772156649015329


def clamp_share(share: float) -> float:
    return max(0.01, min(0.5, share))


def mean_path(n: np.ndarray | int) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + _EULER) - 2.0 * (m - 1.0) / m, out)


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays; ``feature`` is -1 at a leaf, whose ``length`` is final."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    depth: int
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Minus the anomaly score of each row, in [-1, 0]: lower is more anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                step = np.where(goes_left, self.left[node], self.right[node])
                node = np.where(f < 0, node, step)
            total += self.length[node]
        scale = max(float(mean_path(self.sample)), 1e-12)
        return -np.exp2(-total / len(self.roots) / scale)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes ``(feature, threshold, left, right, length)`` of one isolation tree."""
    nodes: list[list] = [[-1, 0.0, 0, 0, 0.0]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(lo < hi)
        if depth >= limit or len(rows) < 2 or not len(splittable):
            nodes[at] = [-1, 0.0, 0, 0, depth + float(mean_path(len(rows)))]
            continue
        f = int(rng.choice(splittable))
        cut = float(rng.uniform(lo[f], hi[f]))
        below = part[:, f] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
        nodes[at] = [f, cut, left, right, 0.0]
        todo += [(left, rows[below], depth + 1), (right, rows[~below], depth + 1)]
    return [tuple(n) for n in nodes]


def _sample_rows(
    df: DataFrame, features: Sequence[Column], row_key: Sequence[str], n: int, pool: int
) -> np.ndarray:
    """At most ``pool`` rows at random, at most a few times that on the way.

    With a row key the draw depends on the key alone; without one, on the row's place.
    """
    if row_key:
        bits = F.xxhash64(F.lit(SEED), *[cell(c) for c in row_key])
        draw = F.pmod(bits, F.lit(1 << 53)) / float(1 << 53)
    else:
        draw = F.rand(SEED)
    values = df.select(draw.alias("draw"), F.array(*features).alias("x"))
    share = min(1.0, _MARGIN * pool / max(n, 1))
    picked = values.filter(F.col("draw") < share).orderBy("draw", "x").limit(pool).collect()
    return np.array([r["x"] for r in picked], dtype=float).reshape(len(picked), len(features))


def fit_forest(
    df: DataFrame,
    features: Sequence[Column],
    row_key: Sequence[str] = (),
    n: int | None = None,
    trees: int = TREES,
    sample: int = SAMPLE,
) -> Forest:
    """Grow ``trees`` trees from ``sample`` rows each, drawn from ``trees * sample`` rows."""
    spark = df.sparkSession
    n = df.count() if n is None else n
    pool = _sample_rows(df, features, row_key, n, trees * sample)
    if not len(pool):
        raise ValueError("an isolation forest needs at least one row")
    ship(spark)
    size = min(sample, len(pool))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    shared = spark.sparkContext.broadcast(pool)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["feature", "threshold", "left", "right", "length"]
        for batch in batches:
            for tree in batch["id"]:
                rng = np.random.default_rng([SEED, int(tree)])
                data = shared.value
                chosen = rng.choice(len(data), size, replace=False)
                out = pd.DataFrame(_grow(data[chosen], rng, limit), columns=names)
                yield out.assign(tree=tree, node=np.arange(len(out)))

    grown = spark.range(0, trees, 1, spark.sparkContext.defaultParallelism).mapInPandas(
        grow,
        "feature int, threshold double, left int, right int, length double, tree long, node int",
    )
    nodes = grown.toPandas().sort_values(["tree", "node"])
    first = nodes.groupby("tree").size().cumsum().shift(fill_value=0)
    base = nodes["tree"].map(first).to_numpy()
    return Forest(
        roots=first.to_numpy(),
        feature=nodes["feature"].to_numpy(),
        threshold=nodes["threshold"].to_numpy(),
        left=nodes["left"].to_numpy() + base,
        right=nodes["right"].to_numpy() + base,
        length=nodes["length"].to_numpy(),
        depth=limit,
        sample=size,
    )


def _scorer(df: DataFrame, forest: Forest, features: Sequence[Column]) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.Series(shared.value.score(x))

    return score(*features)


def anomaly_scores(
    df: DataFrame,
    contamination: float = 0.05,
    columns: Sequence[str] | None = None,
    row_key: Sequence[str] = (),
    flag: str = IS_ANOMALY,
    trees: int = TREES,
    sample: int = SAMPLE,
) -> DataFrame:
    """The input with ``_is_anomaly`` (0/1) and ``_anomaly_score`` (4 decimals).

    Missing numbers count as the column's median. Rows whose score lies below the
    ``contamination`` quantile of all scores are anomalies. ``trees`` trees learn from ``sample``
    rows each; every row is scored, once.
    """
    columns = list(numeric_columns(df) if columns is None else columns)
    if not columns:
        raise ValueError("no numeric columns")
    medians, rows = medians_of_gaps(df, columns)
    features = [F.coalesce(number(df, c), F.lit(medians.get(c, 0.0))) for c in columns]
    forest = fit_forest(df, features, row_key, rows, trees, sample)
    scored = stored(df.withColumn("__score", _scorer(df, forest, features)), "forest-scores")
    threshold = exact_quantiles(
        scored, {"score": F.col("__score")}, (clamp_share(contamination),)
    )["score"][0]
    low = F.col("__score") < F.lit(threshold)
    return scored.withColumns(
        {flag: low.cast("int"), SCORE: F.round("__score", 4)}
    ).drop("__score")
