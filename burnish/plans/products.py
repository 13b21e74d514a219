"""Sums of products of many columns in one scan.

A few columns run as one wide SQL aggregate. With more, their pairs would take a scan for
every few dozen of them; instead each task multiplies its Arrow batches as matrices and
sends one row, and those rows are added up in a bounded number of groups.

Of hundreds of columns the sums are kept in tiles of ``TILE`` by ``TILE`` pairs. A task holds the
tiles of one scan, they are added up row by row in many tasks, and no table of all pairs
comes together in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.plans.fused import aggregate_row, column_aggregates
from burnish.plans.shipping import ship

# Up to this many columns the pairs fit one wide aggregate of reasonable size.
FEW_COLUMNS = 6
_TERMS = ("n", "x", "xx", "xy")
# Columns on a side of a tile, and tiles that a task holds at once (3 MB each).
TILE, TILES = 256, 64


@dataclass(frozen=True)
class PairSums:
    """Over the rows where both columns of a pair are filled; ``[i, j]`` sums column ``i``.

    Values are taken relative to ``centre``, which keeps the sums well conditioned.
    """

    centre: np.ndarray
    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray


def pair_sums(df: DataFrame, values: Mapping[str, Column]) -> PairSums:
    stats = column_aggregates(df, values, lambda x: {"n": F.count(x), "mean": F.avg(x)})
    centre = np.array([stats[c]["mean"] or 0.0 for c in values])
    relative = [x - F.lit(float(m)) for x, m in zip(values.values(), centre)]
    few = len(relative) <= FEW_COLUMNS
    count = _by_aggregate if few else _by_matrices
    return PairSums(centre, *count(df, relative))


def _by_aggregate(df: DataFrame, xs: list[Column]) -> list[np.ndarray]:
    p = len(xs)
    both = {
        (i, j): xs[i].isNotNull() & xs[j].isNotNull() for i in range(p) for j in range(p)
    }
    terms = {
        "n": lambda i, j: F.count_if(both[i, j]),
        "x": lambda i, j: F.sum(F.when(both[i, j], xs[i])),
        "xx": lambda i, j: F.sum(F.when(both[i, j], xs[i] * xs[i])),
        "xy": lambda i, j: F.sum(xs[i] * xs[j]),
    }
    symmetric = ("n", "xy")
    exprs = {
        (k, i, j): term(i, j)
        for k, term in terms.items()
        for i in range(p)
        for j in range(p)
        if j >= i or k not in symmetric
    }
    row = aggregate_row(df, exprs)

    def at(k: str, i: int, j: int) -> float:
        return row[k, min(i, j), max(i, j)] if k in symmetric else row[k, i, j]

    return [
        np.array([[float(at(k, i, j) or 0.0) for j in range(p)] for i in range(p)]) for k in terms
    ]


def _by_matrices(df: DataFrame, xs: list[Column]) -> list[np.ndarray]:
    p = len(xs)
    i, j = (k.ravel().astype(np.int32) for k in np.indices((p, p)))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, p, p))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            known = ~np.isnan(x)
            m, x = known.astype(float), np.where(known, x, 0.0)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pd.DataFrame({"i": i, "j": j} | dict(zip(_TERMS, total.reshape(4, -1))))

    wide = df.select(*[x.alias(f"x{k}") for k, x in enumerate(xs)])
    parts = wide.mapInPandas(partial, "i int, j int, n double, x double, xx double, xy double")
    added = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _TERMS]).collect()
    total = np.zeros((4, p, p))
    for r in added:
        total[:, r["i"], r["j"]] = [r[c] for c in _TERMS]
    return list(total)


def gram(df: DataFrame, xs: list[Column]) -> np.ndarray:
    """Sums of products of ``[1, x1, ..., xp]`` over rows without gaps, as a symmetric matrix."""
    if len(xs) > FEW_COLUMNS:
        return _by_matrices(df, [F.lit(1.0), *xs])[3]
    terms = [F.lit(1.0), *xs]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    row = aggregate_row(df, {f"{i},{j}": F.sum(terms[i] * terms[j]) for i, j in pairs})
    out = np.zeros((len(terms), len(terms)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"{i},{j}"] or 0.0
    return out


def grams_by_key(df: DataFrame, key: str, xs: list[Column]) -> dict[str, np.ndarray]:
    """``gram`` for each value of a column that has few values."""
    terms = [F.lit(1.0), *xs]
    p = len(terms)
    if len(xs) <= FEW_COLUMNS:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        sums = [F.sum(terms[i] * terms[j]).alias(f"{i},{j}") for i, j in pairs]
        out = {}
        for r in df.groupBy(key).agg(*sums).collect():
            out[r[key]] = total = np.zeros((p, p))
            for i, j in pairs:
                total[i, j] = total[j, i] = r[f"{i},{j}"] or 0.0
        return out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            x = batch.drop(columns="key").to_numpy(dtype=float)
            for k, rows in batch.groupby("key").indices.items():
                totals[k] = totals.get(k, 0.0) + x[rows].T @ x[rows]
        for k, total in totals.items():
            yield pd.DataFrame(
                {"key": k, "i": np.arange(p, dtype=np.int32), "row": list(total)}
            )

    wide = df.select(F.col(key).alias("key"), *[x.alias(f"x{k}") for k, x in enumerate(terms)])
    parts = wide.mapInPandas(partial, "key string, i int, row array<double>")
    sums = [F.sum(F.col("row")[j]).alias(f"s{j}") for j in range(p)]
    out = {}
    for r in parts.groupBy("key", "i").agg(*sums).collect():
        out.setdefault(r["key"], np.zeros((p, p)))[r["i"]] = [r[f"s{j}"] for j in range(p)]
    return out


def few_tasks(df: DataFrame) -> DataFrame:
    """Two tasks a core at most, without a shuffle: what each task sends is large."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of one array column; a gap is NaN."""
    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float, copy=False).reshape(-1, width)


def tile_rows(
    df: DataFrame,
    xs: list[Column],
    finish: Callable[[int, slice, np.ndarray], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """``finish(i, js, sums)`` for each column ``i`` and each tile's columns ``js`` from ``i``'s on.

    ``sums`` has six rows, each over the rows where both columns are filled: their number, the
    sums and squares of ``i``, those of ``js``, and the products. A scan for every ``TILES`` tiles.
    """
    p, side = len(xs), TILE
    spans = [slice(at, min(at + side, p)) for at in range(0, p, side)]
    pairs = [(a, b) for a in range(len(spans)) for b in range(a, len(spans))]
    wide = few_tasks(df.select(F.array(*[x.cast("double") for x in xs]).alias("xs")))
    ship(df.sparkSession)
    fields = pa.schema([("i", pa.int32()), ("b", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def partial(mine: list[tuple[int, int]]):
        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                x = _matrix(batch, p)
                known = ~np.isnan(x)
                m, x = known.astype(float), np.where(known, x, 0.0)
                xx = x * x
                for a, b in mine:
                    i, j = spans[a], spans[b]
                    left, right = (m[:, i], x[:, i], xx[:, i]), (m[:, j], x[:, j], xx[:, j])
                    part = [
                        left[0].T @ right[0], left[1].T @ right[0], left[2].T @ right[0],
                        left[0].T @ right[1], left[0].T @ right[2], left[1].T @ right[1],
                    ]
                    total[a, b] = total.get((a, b), 0.0) + np.stack(part, axis=1)
            for (a, b), sums in total.items():
                at = np.arange(spans[a].start, spans[a].stop, dtype=np.int32)
                columns = [at, np.full(len(at), b, np.int32), list(sums.reshape(len(at), -1))]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, fields)]
                yield pa.RecordBatch.from_arrays(arrays, schema=fields)

        return added

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, b, sums in zip(batch["i"], batch["b"], batch["sums"]):
                total[i, b] = total.get((i, b), 0.0) + sums
        for (i, b), sums in total.items():
            yield finish(i, spans[b], sums.reshape(6, -1))

    out = None
    for at in range(0, len(pairs), TILES):
        parts = wide.mapInArrow(partial(pairs[at : at + TILES]), "i int, b int, sums array<double>")
        rows = parts.repartition("i", "b").mapInPandas(whole, schema)
        out = rows if out is None else out.unionAll(rows)
    return out


def times_own_rows(df: DataFrame, xs: list[Column], right: np.ndarray) -> np.ndarray:
    """``X' (X right)`` for the matrix ``X`` of columns without gaps, in one scan."""
    p, width = right.shape
    names = [f"s{k}" for k in range(width)]
    schema = pa.schema([("i", pa.int32()), *[(c, pa.float64()) for c in names]])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, width))
        for batch in batches:
            x = _matrix(batch, p)
            total += x.T @ (x @ right)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(p, dtype=np.int32)), *[pa.array(c) for c in total.T.copy()]], schema=schema
        )

    wide = few_tasks(df.select(F.array(*xs).alias("xs")))
    ship(df.sparkSession)
    parts = wide.mapInArrow(partial, "i int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((p, width))
    for i, *sums in parts.groupBy("i").agg(*[F.sum(c) for c in names]).collect():
        out[i] = sums
    return out
