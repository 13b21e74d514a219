"""Whitening of embeddings by an incremental eigendecomposition.

Vectors become whole numbers ``x = floor(256 * c)``; the covariance is over the distinct ones. A
task keeps count, mean and spectrum of the scatter of the vectors it has seen; the next vector is a
centred rank-one update: the secular equation gives the new eigenvalues, after the directions that
do not change (no share in the update, or equal eigenvalues, turned by a reflection) are deflated.
The spectra of the tasks, one row each, are combined in groups of ``FAN_IN`` until one is left: the
eigenpairs of one spectrum are rank-one updates of the other, and so is the difference of the means.

The combined eigenvectors carry the rounding of many updates, so they only serve as a basis: one
more pass sums the products of the centred vectors in that basis, and the eigenvectors of this
small matrix (Rayleigh-Ritz) turn the basis to the components in double precision. Counts and sums
per dimension are exact.

Defined results: null vectors and those with null or non-finite entries take no part, nor those
with an entry beyond 62 bits; ``vec_id`` may be null or repeat; vectors of different lengths are
whitened apart; empty vectors give no rows; other columns are ignored. A component without variance
has null ``whitened``, and no variance at all gives null ``explained``; ``identity_error`` is over
the components with variance and null without any; ``deviation`` is null beyond 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.llm.common import prepare, written

SCALE = 256
#: Spectra that one task combines.
FAN_IN = 8
#: Rows that a task works on at a time.
ROWS = 4096
_EPS = np.finfo(float).eps
_ROUNDS = 80


# One update


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z2 / (d - x))`` for rising, separate ``d`` and positive ``rho``.

    Root ``i`` lies between ``d[i]`` and the next pole. Returns the roots and the differences
    ``d[j] - root[i]``, which are exact to rounding: each root is kept relative to its closer
    pole. A step fits a pole on each side to the sums below and above; steps that leave the
    bracket are halved instead.
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    gap = upper - d
    below = np.tri(k)
    beyond = 1 - below
    weights = rho * z2
    inner = np.arange(k) < k - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        at_middle = 1 + (weights / (d - (d + gap / 2)[:, None])).sum(axis=1)
    right = inner & (at_middle < 0)
    origin = np.where(right, upper, d)
    delta = d - origin[:, None]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(inner, gap / 2, gap))
    x = (low + high) / 2
    rows = np.arange(k)
    above = np.minimum(rows + 1, k - 1)
    for _ in range(_ROUNDS):
        away = delta - x[:, None]
        with np.errstate(all="ignore"):
            terms = weights / away
            slopes = terms / away
            psi, phi = (terms * below).sum(axis=1), (terms * beyond).sum(axis=1)
            dpsi, dphi = (slopes * below).sum(axis=1), (slopes * beyond).sum(axis=1)
            f = 1 + psi + phi
            small = np.abs(f) <= _EPS * k * (1 + np.abs(psi) + np.abs(phi))
            still = small | (high - low <= 4 * _EPS * np.maximum(np.abs(low), np.abs(high)))
            if still.all():
                break
            low = np.where(f < 0, x, low)
            high = np.where(f < 0, high, x)
            a, b = away[rows, rows], away[rows, above]
            s1, s2 = dpsi * a * a, np.where(inner, dphi * b * b, 0.0)
            c = 1 + (psi - dpsi * a) + np.where(inner, phi - dphi * b, 0.0)
            p, q = c * (a + b) + s1 + s2, a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0.0))
            step = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
            step = np.where(inner, step, a + s1 / c)
            new = x + step
            fine = np.isfinite(new) & (new > low) & (new < high)
            still |= np.abs(step) <= 2 * _EPS * np.abs(x)
        x = np.where(still, x, np.where(fine, new, (low + high) / 2))
    return origin + x, delta - x[:, None]


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float) -> tuple:
    """Eigenvalues, rising, and eigenvectors of ``u @ diag(d) @ u.T + rho * v @ v.T``."""
    z = u.T @ v
    norm = np.linalg.norm(z)
    if not norm or rho <= 0:
        return d, u
    z, rho = z / norm, rho * norm * norm
    tolerance = 8 * _EPS * max(abs(d[-1]), rho)
    edges = np.flatnonzero(np.diff(d) > tolerance) + 1
    if len(edges) < len(d) - 1:
        u = u.copy()
        for same in np.split(np.arange(len(d)), edges):
            if len(same) > 1:
                _gather(z, u, same)
    active = np.flatnonzero(rho * np.abs(z) > tolerance)
    if not len(active):
        return d, u
    values, vectors = _updated(d[active], z[active], rho)
    d, out = d.copy(), u.copy()
    d[active] = values
    out[:, active] = u[:, active] @ vectors
    order = np.argsort(d, kind="stable")
    return d[order], out[:, order]


def _gather(z: np.ndarray, u: np.ndarray, same: np.ndarray) -> None:
    """Turn directions of equal eigenvalue so that only the last one has a share in the update."""
    part = z[same]
    size = np.linalg.norm(part)
    if not size or not part[:-1].any():
        return
    w = part.copy()
    w[-1] += np.copysign(size, w[-1])
    w /= np.linalg.norm(w)
    u[:, same] -= 2 * np.outer(u[:, same] @ w, w)
    z[same] = 0.0
    z[same[-1]] = -np.copysign(size, part[-1])


def _updated(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``diag(d) + rho * z @ z.T`` with separate ``d`` and no zero in ``z``.

    The vectors come from the update that has exactly the computed roots, which keeps them
    orthogonal however close the roots are.
    """
    roots, away = secular_roots(d, z * z, rho)
    k = len(d)
    apart = d[:, None] - d
    ratio = np.ones((k, k))
    i, j = np.indices((k, k))
    ratio[i < j] = apart[i < j]
    later = (i >= j) & (i < k - 1)
    ratio[later] = np.roll(apart, -1, axis=0)[later]
    share = np.sqrt(np.abs(np.prod(-away / ratio, axis=0)))
    vectors = np.copysign(share, z)[:, None] / away.T
    return roots, vectors / np.linalg.norm(vectors, axis=0)


@dataclass
class Spectrum:
    """Count, mean and eigenpairs of the scatter (sum of centred products) of some vectors."""

    n: int
    mean: np.ndarray
    d: np.ndarray
    u: np.ndarray

    @staticmethod
    def empty(width: int) -> Spectrum:
        return Spectrum(0, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.d, self.u = rank_one(self.d, self.u, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.d, other.u.T):
            self.d, self.u = rank_one(self.d, self.u, vector, float(value))
        total = self.n + other.n
        away = other.mean - self.mean
        self.d, self.u = rank_one(self.d, self.u, away, self.n * other.n / total)
        self.mean = self.mean + away * (other.n / total)
        self.n = total


# Over all tasks


def whole_vectors(df: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part, ``v`` in whole numbers."""
    fine = F.col("embedding").isNotNull() & F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**62 / SCALE)),
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return df.where(fine).select("vec_id", whole.alias("v")).where(F.size("v") > 0)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        flat = column.flatten().to_numpy().reshape(len(column), -1)
        for at in range(0, len(flat), ROWS):
            yield flat[at:at + ROWS]


_SPECTRUM = "part int, n long, mean array<double>, d array<double>, u array<double>"


def _frame(part: int, s: Spectrum) -> pd.DataFrame:
    return pd.DataFrame({"part": np.array([part], dtype=np.int32), "n": [s.n], "mean": [s.mean],
                         "d": [s.d], "u": [s.u.ravel()]})


def _combined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = None
    for r in rows.sort_values("part").itertuples():
        width = len(r.mean)
        s = Spectrum(r.n, np.array(r.mean), np.array(r.d), np.array(r.u).reshape(width, width))
        if total is None:
            total = s
        else:
            total.merge(s)
    return _frame(int(key[0]), total)


def spectrum(fit: DataFrame, width: int) -> Spectrum:
    """The spectrum of all vectors of ``fit``, combined in rounds of ``FAN_IN``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        own = Spectrum.empty(width)
        for rows in _matrices(batches):
            for x in rows.astype(float):
                own.add(x)
        if own.n:
            frame = _frame(pyspark.TaskContext.get().partitionId(), own)
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    parts = written(fit.select("v").mapInArrow(partial, _SPECTRUM), "spectra")
    while (last := parts.agg(F.max("part")).first()[0]) > 0:
        group = F.floor(F.col("part") / FAN_IN).cast("int").alias("group")
        parts = written(parts.groupBy(group).applyInPandas(_combined, _SPECTRUM), f"spectra-{last}")
    r = parts.first()
    return Spectrum(r["n"], np.array(r["mean"]), np.array(r["d"]),
                    np.array(r["u"]).reshape(width, width))


def exact_sums(fit: DataFrame, width: int) -> list[int]:
    """Sums per dimension, exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for rows in _matrices(batches):
            safe = max(abs(int(rows.max())), abs(int(rows.min()))) < (1 << 62) // len(rows)
            sums = rows.sum(axis=0) if safe else rows.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, sums)]
        values = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width, dtype=np.int32)), values], ["i", "s"]
        )

    parts = fit.select("v").mapInArrow(partial, "i int, s decimal(38,0)")
    found = parts.groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(s) for _, s in sorted((r["i"], r["s"]) for r in found)]


def _products(fit: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the centred vectors in the columns of a basis."""
    k = shared.value.basis.shape[1]
    cells = k * (k + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total = np.zeros((k + 1, k))
        for rows in _matrices(batches):
            y = c.centred(rows) @ c.basis
            total[:k] += y.T @ y
            total[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(cells, dtype=np.int32)), pa.array(total.ravel())], ["i", "s"]
        )

    parts = fit.select("v").mapInArrow(partial, "i int, s double")
    total = np.zeros(cells)
    for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect():
        total[r["i"]] = r["s"]
    total = total.reshape(k + 1, k)
    return total[k], total[:k]


@dataclass
class Centre:
    """The exact mean ``sums / n`` and a basis; ``most`` bounds the entries of all vectors."""

    n: int
    sums: list[int]
    basis: np.ndarray
    most: int

    def numerators(self, rows: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact."""
        if self.bound < 1 << 62:
            return rows * self.n - np.array(self.sums, dtype=np.int64)
        return rows.astype(object) * self.n - np.array(self.sums, dtype=object)

    @property
    def bound(self) -> int:
        return self.n * self.most + max(abs(s) for s in self.sums)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return (self.numerators(rows) / self.n).astype(float)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        away = self.numerators(rows)
        if len(self.sums) * self.bound**2 < 1 << 63:
            return (away * away).sum(axis=1).tolist()
        away = away.astype(object)
        found = (away * away).sum(axis=1)
        return [int(x) if x < 1 << 63 else None for x in found]


@dataclass
class Whitening:
    """Components of one length of vectors, in columns by falling variance."""

    centre: Centre
    variances: np.ndarray
    trace: float
    identity_error: float | None = None

    def scales(self) -> np.ndarray:
        """``1 / sqrt(e)``; not a number where there is no variance."""
        least = self.trace * _EPS * len(self.centre.sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > least, 1 / np.sqrt(self.variances), np.nan)


def fit_whitening(fit: DataFrame, width: int, components: int) -> Whitening:
    """Learn from distinct whole-number vectors of one length."""
    sc = fit.sparkSession.sparkContext
    sums = exact_sums(fit, width)
    most = fit.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]
    found = spectrum(fit, width)
    basis = np.linalg.qr(found.u[:, ::-1])[0]
    centre = Centre(found.n, sums, basis, most)
    _, products = _products(fit, sc.broadcast(centre))
    values, turn = np.linalg.eigh((products + products.T) / (2 * found.n))
    k = min(components, width)
    vectors = basis @ turn[:, ::-1][:, :k]
    sign = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(k)])
    centre.basis = vectors * sign
    out = Whitening(centre, np.maximum(values[::-1][:k], 0.0), float(np.trace(products) / found.n))
    good = np.isfinite(scales := out.scales())
    if good.any():
        white = Centre(found.n, sums, centre.basis[:, good] * scales[good], most)
        first, second = _products(fit, sc.broadcast(white))
        covariance = second / found.n - np.outer(first, first) / found.n**2
        out.identity_error = float(np.abs(covariance - np.eye(good.sum())).max())
    return out


def _projected(shared):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Whitening = shared.value
        k = len(w.variances)
        scales, n = w.scales(), w.centre.n
        for batch in batches:
            at = 0
            for rows in _matrices([batch]):
                white = w.centre.centred(rows) @ w.centre.basis * scales
                size = len(rows)
                row = np.repeat(np.arange(size), k)
                share = w.variances / w.trace if w.trace else np.full(k, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(at + row)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * k, n, dtype=np.int64)),
                        pa.array(w.centre.deviations(rows), pa.int64()).take(pa.array(row)),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(np.tile(share, size), from_pandas=True),
                        pa.array([w.identity_error] * (size * k), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained",
                     "identity_error"],
                )
                at += size

    return project


def whiten(df: DataFrame, components: int = 4) -> DataFrame:
    """A row per vector and component of ``vec_id, embedding``.

    ``vec_id, component, n, deviation, whitened, explained, identity_error``: component from 1,
    number of distinct vectors, exact ``sum((n * x - S) ^ 2)``, whitened coordinate, share of the
    variance, and the largest error of the whitened covariance of the distinct vectors.
    """
    spark = df.sparkSession
    prepare(spark)
    schema = T.StructType([
        T.StructField("vec_id", df.schema["vec_id"].dataType),
        *T.StructType.fromDDL("component int, n long, deviation long, whitened double, "
                              "explained double, identity_error double"),
    ])
    vectors = written(whole_vectors(df).withColumn("size", F.size("v")), "whole-vectors")
    fit = written(vectors.select("size", "v").distinct(), "distinct-vectors")
    out = spark.createDataFrame([], schema)
    # one fit per length of vectors: as a rule there is one
    for (size,) in fit.select("size").distinct().orderBy("size").collect():
        learned = fit_whitening(fit.where(F.col("size") == size), size, components)
        rows = vectors.where(F.col("size") == size).select("vec_id", "v")
        out = out.union(rows.mapInArrow(_projected(spark.sparkContext.broadcast(learned)), schema))
    return out
