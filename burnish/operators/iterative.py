"""Chained-equation imputation: Bayesian ridge from sums, and random forests.

Bayesian ridge needs only the sums of the products of the columns, and every value it
fills in is a linear function of the values that the row came with. So one scan takes
the sums per gap pattern (which columns a row lacks), the rounds are linear algebra on
those sums, and a last select applies each pattern's final coefficients. The stop rule asks
for the largest change of any value; its root mean square, known from the sums, rules most
rounds out, and a scan of the incomplete rows decides the others.

Tables with too many patterns for that touch the incomplete rows in every round and write
them down after it to keep plans short. Forests always do; the complete rows are cut into bins
once and written as a table of bytes, from which the forests of all columns and rounds learn.
Rows of equal bins are one cell to a tree. A table that has a bounded number of cells, however many
its rows, is grouped by them, and each tree grows on the cells in a task of its own. Trees of few
cells are sent to the rows; larger ones predict where they grew, and what they say is joined to the
rows. Other tables, and trees of a few nodes, are left to Spark's forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.operators.typing import number
from burnish.plans.fused import column_aggregates
from burnish.plans.materialize import materialize, stored
from burnish.plans.products import gram, grams_by_key
from burnish.plans.quantiles import exact_quantiles
from burnish.plans.shipping import ship

ROUNDS, TOLERANCE = 10, 1e-3
FOREST_TREES, FOREST_ROUNDS, FOREST_SEED = 50, 5, 42
# The deepest trees that the library grows.
FOREST_DEPTH = 30
# Bins per column: a byte each.
FOREST_BINS = 64
# Cells (distinct rows of bins) from which a task grows a tree: fewer make a tree of a few nodes, and
# more are Spark's forest's; their bins take 16 MB at most.
FEWEST_CELLS, MOST_CELLS, MOST_CELL_BYTES = 64, 1 << 20, 1 << 24
# Cells up to which trees are sent to the rows; cells that a larger tree predicts in a task.
SENT_CELLS, ASKED_CELLS = 1 << 15, 1 << 20
# Nodes whose sums a tree holds at once.
NODES_AT_ONCE = 1 << 12
# Numbers that the sums of all gap patterns may have (32 MB); coefficients have fewer.
MOST_SUMS = 4_000_000
_RIDGE_ROUNDS, _RIDGE_TOLERANCE, _PRIOR = 300, 1e-3, 1e-6


def _products(df: DataFrame, chain: _Chain) -> np.ndarray:
    """Sums of products of ``[1, x1, ..., xp]``, each ``x`` around the column's mean."""
    around = [F.col(x) - F.lit(chain.means[c]) for x, c in zip(chain.x, chain.columns)]
    return gram(df, around)


def bayesian_ridge(gram: np.ndarray, target: int) -> tuple[np.ndarray, float]:
    """Coefficients of the other columns and the intercept, by evidence maximisation.

    ``gram`` holds the sums of products of ``[1, x1, ..., xp]``; ``target`` is a column of it.
    """
    n = gram[0, 0]
    others = [i for i in range(1, len(gram)) if i != target]
    means = gram[0] / n
    centred = gram - n * np.outer(means, means)
    xx, xy, yy = centred[np.ix_(others, others)], centred[others, target], centred[target, target]
    eigen, vectors = np.linalg.eigh(xx)
    eigen = np.maximum(eigen, 0.0)
    rotated = vectors.T @ xy
    alpha, lam = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    coef = np.zeros(len(others))
    for step in range(_RIDGE_ROUNDS):
        new = vectors @ (rotated / (eigen + lam / alpha))
        residual = max(yy - 2.0 * new @ xy + new @ xx @ new, 0.0)
        effective = float(np.sum(alpha * eigen / (lam + alpha * eigen)))
        lam = (effective + 2 * _PRIOR) / (float(new @ new) + 2 * _PRIOR)
        alpha = (n - effective + 2 * _PRIOR) / (residual + 2 * _PRIOR)
        settled = step > 0 and np.sum(np.abs(coef - new)) < _RIDGE_TOLERANCE
        coef = new
        if settled:
            break
    coef = vectors @ (rotated / (eigen + lam / alpha))
    return coef, float(means[target] - coef @ means[others])


class _Chain:
    """Names and state shared by the two chained imputers."""

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        stats = column_aggregates(
            df,
            {c: number(df, c) for c in columns},
            lambda x: {"n": F.count(x), "mean": F.avg(x), "far": F.max(F.abs(x))},
        )
        # A column without any value stays as it is.
        self.columns = [c for c in columns if stats[c]["n"]]
        self.means = {c: stats[c]["mean"] for c in self.columns}
        self.filled = {c: stats[c]["n"] for c in self.columns}
        self.far = max((stats[c]["far"] for c in self.columns), default=0.0)
        total = df.count()
        gaps = [c for c in self.columns if self.filled[c] < total]
        self.gaps = sorted(gaps, key=lambda c: (-self.filled[c], self.columns.index(c)))
        self.x = [f"__x{i}" for i in range(len(self.columns))]
        self.m = [f"__m{i}" for i in range(len(self.columns))]
        # Columns whose features have too many cells.
        self.wide: set[int] = set()

    def at(self, column: str) -> int:
        return self.columns.index(column)

    def started(self, df: DataFrame) -> DataFrame:
        """Working columns: values with gaps at the mean, and gap marks."""
        values = [number(df, c) for c in self.columns]
        return df.withColumns(
            {x: F.coalesce(v, F.lit(self.means[c]))
             for x, v, c in zip(self.x, values, self.columns)}
            | {m: v.isNull() for m, v in zip(self.m, values)}
        )

    def pattern(self, started: DataFrame) -> DataFrame:
        """Add ``__pattern``: a mark per column, 1 where the row lacks it."""
        marks = [F.when(F.col(m), F.lit("1")).otherwise(F.lit("0")) for m in self.m]
        return started.withColumn("__pattern", F.concat(*marks))

    def moved(self) -> Column:
        """Largest change of a row in the last round."""
        return F.greatest(*[F.abs(F.col(x) - F.col(f"__was_{x}")) for x in self.x], F.lit(0.0))

    def restored(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        kept = dict(zip(self.columns, self.x))
        return df.select(*[F.col(kept[c]).alias(c) if c in kept else cell(c) for c in names])


def impute_mice(
    df: DataFrame, columns: Sequence[str], rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """Each gap predicted from the other columns by Bayesian ridge, round after round."""
    chain = _Chain(df, columns)
    if not chain.gaps:
        return df
    if len(chain.columns) < 2:
        return chain.restored(chain.started(df), df.columns)
    started = chain.started(df)
    most = MOST_SUMS // (len(chain.columns) + 1) ** 2
    keys = chain.pattern(started).select("__pattern").distinct().limit(most + 1).collect()
    if len(keys) <= most:
        return _mice_by_pattern(started, chain, df.columns, rounds, tolerance)
    return _mice_by_rounds(started, chain, df.columns, rounds, tolerance)


def _mice_by_pattern(
    started: DataFrame, chain: _Chain, names: Sequence[str], rounds: int, tolerance: float
) -> DataFrame:
    """All rounds on the sums of each gap pattern."""
    rows = chain.pattern(started)
    known = [
        F.when(F.col(m), 0.0).otherwise(F.col(x) - F.lit(chain.means[c]))
        for x, m, c in zip(chain.x, chain.m, chain.columns)
    ]
    found = grams_by_key(rows, "__pattern", known)
    keys = sorted(found)
    lacks = np.array([[mark == "1" for mark in k] for k in keys])
    start = np.stack([found[k] for k in keys])
    # Sums of the values as filled in so far, and those values as functions of the known ones.
    sums = start.copy()
    maps = np.zeros_like(sums)
    maps[:, 0, 0] = 1.0
    each, column = np.nonzero(~lacks)
    maps[each, column + 1, column + 1] = 1.0
    for _ in range(rounds):
        before = maps.copy()
        for c in chain.gaps:
            i = chain.at(c) + 1
            gap = lacks[:, i - 1]
            coef, intercept = bayesian_ridge(sums[~gap].sum(axis=0), i)
            line = np.insert(np.concatenate([[intercept], coef]), i, 0.0)
            maps[gap, i] = line @ maps[gap]
            row = line @ sums[gap]
            row[:, i] = row @ line
            sums[gap, i] = row
            sums[gap, :, i] = row
        change = maps - before
        squares = np.einsum("kci,kij,kcj->kc", change, start, change)
        typical = np.sqrt(np.max(np.maximum(squares, 0.0) / start[:, :1, 0]))
        limit = tolerance * chain.far
        if typical < limit and _largest(rows, chain, keys, lacks, change, known) < limit:
            break
    filled = _with_lines(rows, chain, keys, lacks, maps)
    values = {
        chain.x[chain.at(c)]: F.when(
            F.col(chain.m[chain.at(c)]), F.lit(chain.means[c]) + _line(k, known)
        ).otherwise(F.col(chain.x[chain.at(c)]))
        for k, c in enumerate(chain.gaps)
    }
    return chain.restored(filled.withColumns(values), names)


def _with_lines(
    rows: DataFrame, chain: _Chain, keys: list[str], lacks: np.ndarray, maps: np.ndarray
) -> DataFrame:
    """Add ``__lines``: per column with gaps the coefficients of the row's pattern.

    The broadcast table has less than ``MOST_SUMS`` numbers; complete rows match none of it.
    """
    at = [chain.at(c) + 1 for c in chain.gaps]
    table = [(k, m[at].tolist()) for k, gap, m in zip(keys, lacks, maps) if gap.any()]
    lines = rows.sparkSession.createDataFrame(
        table, "__pattern string, __lines array<array<double>>"
    )
    return rows.join(F.broadcast(lines), "__pattern", "left")


def _line(k: int, known: list[Column]) -> Column:
    line = F.col("__lines")[k]
    return reduce(lambda a, b: a + b, [line[j + 1] * x for j, x in enumerate(known)], line[0])


def _largest(
    rows: DataFrame, chain: _Chain, keys: list[str], lacks: np.ndarray, change: np.ndarray,
    known: list[Column],
) -> float:
    """Largest change of any filled value in a round."""
    step = _with_lines(rows.filter(F.col("__pattern").contains("1")), chain, keys, lacks, change)
    moved = F.greatest(*[F.abs(_line(k, known)) for k in range(len(chain.gaps))], F.lit(0.0))
    return step.agg(F.max(moved)).first()[0] or 0.0


def _mice_by_rounds(
    started: DataFrame, chain: _Chain, names: Sequence[str], rounds: int, tolerance: float
) -> DataFrame:
    """Each round by scans of the incomplete rows."""
    has_gap = reduce(or_, [F.col(m) for m in chain.m])
    fixed = _products(started.filter(~has_gap), chain)
    work = materialize(started.filter(has_gap))
    for _ in range(rounds):
        before = {x: F.col(x).alias(f"__was_{x}") for x in chain.x}
        step = work.select("*", *before.values())
        for c in chain.gaps:
            i = chain.at(c)
            sums = fixed + _products(step.filter(~F.col(chain.m[i])), chain)
            coef, intercept = bayesian_ridge(sums, i + 1)
            others = [j for j in range(len(chain.columns)) if j != i]
            predicted = F.lit(float(intercept + chain.means[c]))
            for k, j in enumerate(others):
                away = F.col(chain.x[j]) - F.lit(chain.means[chain.columns[j]])
                predicted = predicted + F.lit(float(coef[k])) * away
            step = step.withColumn(
                chain.x[i], F.when(F.col(chain.m[i]), predicted).otherwise(F.col(chain.x[i]))
            )
        step = materialize(step)
        largest = step.agg(F.max(chain.moved())).first()[0] or 0.0
        work = step.drop(*[f"__was_{x}" for x in chain.x])
        if largest < tolerance * chain.far:
            break
    complete = started.filter(~has_gap)
    return chain.restored(complete.unionByName(work), names)


def impute_random_forest(
    df: DataFrame,
    columns: Sequence[str],
    rounds: int = FOREST_ROUNDS,
    trees: int = FOREST_TREES,
    tolerance: float = TOLERANCE,
    max_depth: int = FOREST_DEPTH,
    bins: int = FOREST_BINS,
) -> DataFrame:
    """The same rounds with a random forest per column with gaps.

    The raw rows are read to find the ``bins`` (at most 128), to write the table of the complete
    rows' bins, to write the incomplete rows, and to put the result together; no fit reads them.
    """
    chain = _Chain(df, columns)
    if not chain.gaps:
        return df
    started = chain.started(df)
    if len(chain.columns) < 2:
        return chain.restored(started, df.columns)
    has_gap = reduce(or_, [F.col(m) for m in chain.m])
    complete = started.filter(~has_gap)
    binned = _binning(df, chain, bins)
    labels = [chain.x[chain.at(c)] for c in chain.gaps]
    table = stored(binned(complete).select(*_bytes(chain), *labels), "forest-bins")
    work = stored(started.filter(has_gap), "forest-gaps")
    for _ in range(rounds):
        step = work.select("*", *[F.col(x).alias(f"__was_{x}") for x in chain.x])
        for c in chain.gaps:
            step = _forest_step(table, binned(step), chain, chain.at(c), trees, max_depth, bins)
        step = stored(step, "forest-gaps")
        largest = step.agg(F.max(chain.moved())).first()[0] or 0.0
        work = step.drop(*[f"__was_{x}" for x in chain.x])
        if largest < tolerance * chain.far:
            break
    return chain.restored(complete.unionByName(work), df.columns)


def _bytes(chain: _Chain) -> list[Column]:
    return [F.col(f"__b{i}").cast("tinyint").alias(f"__b{i}") for i in range(len(chain.x))]


def _binning(df: DataFrame, chain: _Chain, bins: int) -> Callable[[DataFrame], DataFrame]:
    """Adds ``__b0, ...``: the bins of the working columns, cut at exact quantiles of known values."""
    values = {c: number(df, c) for c in chain.columns}
    shares = [i / bins for i in range(1, bins)]
    cuts = exact_quantiles(df, values, shares, chain.filled, interpolate=False)
    # Infinite cuts become the outermost finite ones, which part the infinities from the rest.
    most = np.finfo(float).max
    inner = [np.unique(np.clip(cuts[c], -most, most)).tolist() for c in chain.columns]
    bucketizer = Bucketizer(
        splitsArray=[[-np.inf, *cut, np.inf] for cut in inner],
        inputCols=chain.x,
        outputCols=[f"__b{i}" for i in range(len(chain.x))],
    )
    return bucketizer.transform


def _forest_step(
    table: DataFrame, step: DataFrame, chain: _Chain, i: int, trees: int, max_depth: int, bins: int
) -> DataFrame:
    """Learn from every row that has the column, predict the rows that lack it."""
    features = VectorAssembler(
        inputCols=[f"__b{j}" for j in range(len(chain.x)) if j != i], outputCol="__features"
    )
    gap = F.col(chain.m[i])
    wanted = [*features.getInputCols(), chain.x[i]]
    known = table.select(*wanted).unionAll(
        step.filter(~gap).select(*_bytes(chain), chain.x[i]).select(*wanted)
    )
    cells = None if i in chain.wide else _cells(known, chain, i)
    mean = F.lit(chain.means[chain.columns[i]])
    if cells is not None and len(cells[0]) > SENT_CELLS:
        inputs = features.getInputCols()
        answers = _answers(step.filter(gap), inputs, cells, trees, max_depth, bins)
        same = [F.col(c).cast("tinyint") == F.col(f"__of{c}") for c in inputs]
        predictions = (
            step.join(answers.withColumnsRenamed({c: f"__of{c}" for c in inputs}), same, "left")
            .withColumn("__predicted", mean + F.col("__answer"))
            .drop("__answer", *[f"__of{c}" for c in inputs])
        )
    elif cells is not None and len(cells[0]) >= FEWEST_CELLS:
        forest = _grown(step.sparkSession, cells, trees, max_depth, bins)
        predicted = mean + _predictor(step.sparkSession, forest)(
            *[F.col(c).cast("tinyint") for c in features.getInputCols()]
        )
        predictions = step.withColumn("__predicted", predicted)
    else:
        model = RandomForestRegressor(
            featuresCol="__features",
            labelCol=chain.x[i],
            predictionCol="__predicted",
            numTrees=trees,
            maxDepth=max_depth,
            maxBins=bins,
            featureSubsetStrategy="all",
            seed=FOREST_SEED,
        ).fit(features.transform(known).select("__features", chain.x[i]))
        predictions = model.transform(features.transform(step))
    return (
        predictions
        .withColumn(chain.x[i], F.when(gap, F.col("__predicted")).otherwise(F.col(chain.x[i])))
        .drop("__features", "__predicted", *[f"__b{j}" for j in range(len(chain.x))])
    )


def _cells(known: DataFrame, chain: _Chain, i: int) -> tuple | None:
    """Bins, rows and mean label (around the column's mean) of every cell, or None if too many."""
    inputs = [c for c in known.columns if c != chain.x[i]]
    most = min(MOST_CELLS, MOST_CELL_BYTES // len(inputs))
    around = F.col(chain.x[i]) - F.lit(chain.means[chain.columns[i]])
    found = (
        known.groupBy(*inputs).agg(F.count(F.lit(1)).alias("n"), F.avg(around).alias("mean"))
        .limit(most + 1).toArrow()
    )
    if len(found) > most:
        chain.wide.add(i)
        return None
    bins = np.stack([found.column(c).to_numpy() for c in inputs], axis=1).astype(np.int8)
    order = np.lexsort(bins.T[::-1])
    return bins[order], found.column("n").to_numpy()[order], found.column("mean").to_numpy()[order]


@dataclass
class _Forest:
    """Nodes of all trees: feature (-1: leaf), last bin to the left, left child, value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(bins)), np.arange(len(bins))
        for root in self.roots:
            node = np.full(len(bins), root)
            while True:
                inner = self.feature[node] >= 0
                if not inner.any():
                    break
                right = bins[rows, self.feature[node]] > self.cut[node]
                node = np.where(inner, self.left[node] + right, node)
            out += self.value[node]
        return out / len(self.roots)


def _best_cuts(x, w, t, at, sw, st, best, bin_count: int) -> tuple[np.ndarray, ...]:
    """Largest gain above ``best``, its feature (-1: none) and cut, of some nodes of one level."""
    size, best = len(sw), best.copy()
    feature, cut = np.full(size, -1), np.zeros(size, dtype=np.int64)
    for j in range(x.shape[1]):
        spot = at * bin_count + x[:, j]
        lw = np.bincount(spot, w, size * bin_count).reshape(size, -1).cumsum(axis=1)
        lt = np.bincount(spot, t, size * bin_count).reshape(size, -1).cumsum(axis=1)
        rw, rt = sw[:, None] - lw, st[:, None] - lt
        both = (lw > 0) & (rw > 0)
        gain = (lt**2 / np.where(both, lw, 1.0) + rt**2 / np.where(both, rw, 1.0)
                - (st**2 / sw)[:, None])
        gain[~both] = -1.0
        k = gain.argmax(axis=1)
        gain, first = gain[np.arange(size), k], lw[np.arange(size), k]
        # bins up to the next one drawn split the node alike
        last = (lw <= first[:, None]).sum(axis=1)
        better = gain > best
        best[better], feature[better], cut[better] = gain[better], j, ((k + last) // 2)[better]
    return best, feature, cut


def _tree(bins: np.ndarray, n: np.ndarray, mean: np.ndarray, depth: int, bin_count: int,
          rng: np.random.Generator) -> list[np.ndarray]:
    """A regression tree on rows drawn with replacement, grown level by level.

    A cell is drawn as often as its ``n`` rows together. Nodes split where the squared error falls
    most, on any feature, half way between the bins drawn there, down to ``depth`` or nodes of equal
    labels.
    """
    w = rng.poisson(n).astype(float)
    if not w.any():
        w = n.astype(float)
    drawn = w > 0
    x, w, t = bins[drawn], w[drawn], (w * mean)[drawn]
    at, size, base = np.zeros(len(x), dtype=np.int64), 1, 0
    levels = []
    for level in range(depth + 1):
        order = np.argsort(at, kind="stable")
        x, w, t, at = x[order], w[order], t[order], at[order]
        sw, st = np.bincount(at, w, size), np.bincount(at, t, size)
        feature, cut = np.full(size, -1), np.zeros(size, dtype=np.int64)
        # what rounding errors alone would gain
        best = 1e-10 * np.bincount(at, t * t / w, size)
        for low in range(0, size if level < depth else 0, NODES_AT_ONCE):
            some = slice(low, min(low + NODES_AT_ONCE, size))
            rows = slice(*np.searchsorted(at, [some.start, some.stop]))
            best[some], feature[some], cut[some] = _best_cuts(
                x[rows], w[rows], t[rows], at[rows] - low, sw[some], st[some], best[some], bin_count
            )
        split = feature >= 0
        child = 2 * (np.cumsum(split) - 1)
        levels.append([feature, cut, np.where(split, base + size + child, -1), st / sw])
        go = split[at]
        x, w, t, at = x[go], w[go], t[go], at[go]
        if not len(x):
            break
        at = child[at] + (x[np.arange(len(x)), feature[at]] > cut[at])
        base, size = base + size, 2 * int(split.sum())
    return [np.concatenate(parts) for parts in zip(*levels)]


def _grown(spark, cells: tuple, trees: int, depth: int, bin_count: int) -> _Forest:
    """The trees, each grown in a task."""
    ship(spark)
    shared = spark.sparkContext.broadcast(cells)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rng = np.random.default_rng((FOREST_SEED, k))
                parts = _tree(*shared.value, depth, bin_count, rng)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), *[pa.array([p]) for p in parts]],
                    ["k", "feature", "cut", "left", "value"],
                )

    kind = "k bigint, feature array<bigint>, cut array<bigint>, left array<bigint>, value array<double>"
    found = spark.range(0, trees, 1, trees).mapInArrow(grow, kind).toArrow().sort_by("k")
    shared.unpersist()
    sizes = np.array([len(x) for x in found.column("feature")])
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = {c: found.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            for c in ("feature", "cut", "left", "value")}
    return _Forest(flat["feature"].astype(np.int16), flat["cut"].astype(np.int16),
                   (flat["left"] + np.repeat(roots, sizes)).astype(np.int32), flat["value"], roots)


def _answers(
    gaps: DataFrame, inputs: list[str], cells: tuple, trees: int, depth: int, bin_count: int
) -> DataFrame:
    """Mean of the trees (``__answer``) for the distinct cells of the rows with gaps.

    A task grows a tree and predicts a block of them; more blocks than one grow the same tree again.
    """
    spark = gaps.sparkSession
    asked = stored(
        gaps.select(*[F.col(c).cast("tinyint").alias(c) for c in inputs]).distinct(), "forest-asked"
    )
    blocks = -(-asked.count() // ASKED_CELLS)
    if not blocks:
        return asked.withColumn("__answer", F.lit(0.0))
    block = F.pmod(F.xxhash64(*inputs), F.lit(blocks))
    task = (F.col("__tree") * blocks + block).cast("int")
    dealt = asked.crossJoin(F.broadcast(spark.range(trees).toDF("__tree"))).select(
        task.alias("__task"), *inputs
    )
    ship(spark)
    shared = spark.sparkContext.broadcast(cells)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            tasks = batch.column(0).to_numpy()
            bins = np.stack([batch.column(c).to_numpy() for c in inputs], axis=1)
            for k in np.unique(tasks).tolist():
                parts.setdefault(k, []).append(bins[tasks == k])
        for k, found in parts.items():
            rng = np.random.default_rng((FOREST_SEED, k // blocks))
            tree = _Forest(*_tree(*shared.value, depth, bin_count, rng), np.array([0]))
            for bins in found:
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(bins[:, j]) for j in range(len(inputs))],
                     pa.array(tree.predict(bins))],
                    [*inputs, "__answer"],
                )

    kind = ", ".join([*[f"{c} tinyint" for c in inputs], "__answer double"])
    said = dealt.repartitionById(trees * blocks, "__task").mapInArrow(grow, kind)
    answers = stored(said.groupBy(*inputs).agg(F.avg("__answer").alias("__answer")), "forest-answers")
    shared.unpersist()
    return answers


def _predictor(spark, forest: _Forest) -> Callable[..., Column]:
    """Mean of the trees from the columns of bins; equal rows of a batch are predicted once."""
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def predict(*columns: pa.Array) -> pa.Array:
        bins = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
        some, place = np.unique(bins, axis=0, return_inverse=True)
        return pa.array(shared.value.predict(some)[place.reshape(-1)])

    return predict


IMPUTERS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {
    "mice": impute_mice,
    "iterative": impute_mice,
    "random_forest": impute_random_forest,
}
