"""Exact k-nearest-neighbour imputation without comparing all rows with all rows.

Distinct number vectors, with their multiplicities, are sorted into the leaves of a median-split
tree whose depth follows the data; a cell holds the vectors of one leaf and one pattern of missing
columns. A vector with gaps first meets the vectors of its own leaf; the distance of the last
neighbour found there is its radius, and it then visits only those other leaves with a cell whose
box the radius reaches. Boxes are compared block by block: all vectors of a leaf and pattern at
once, and one by one only with the cells that the block can reach. Leaves of many vectors, or of
many visitors, are split into chunks of bounded size. Distances are Euclidean over the columns that both
vectors have, scaled up to all columns; a task computes them for a block of visitors and a block of
donors at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.operators.typing import number
from burnish.plans.fused import column_aggregates, small_table
from burnish.plans.materialize import stored
from burnish.plans.shipping import ship

CELL_ROWS = 512
#: Boxes are broadcast: at most so many of them, and leaves.
MOST_CELLS = 1 << 17
_CHUNK = 20_000
#: Sampled vectors for each leaf of the tree.
_LEAF_SAMPLE = 16
#: Pairs of vectors that a task compares at a time.
_PAIRS = 1 << 20
_SLACK = 1.0 + 1e-9
_MIXED = "*"
_FOUND = "id bigint, j int, d2 double, value double, n bigint"


def neighbours(rows: int) -> int:
    return min(5, max(1, rows // 20 or 1))


class _Tree:
    """Median splits of a sample; missing numbers go by the sample's medians."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.centre = np.zeros(sample.shape[1])
        for j in range(sample.shape[1]):
            known = sample[~np.isnan(sample[:, j]), j]
            self.centre[j] = np.median(known) if len(known) else 0.0
        parts = [np.where(np.isnan(sample), self.centre, sample)]
        self.dim = np.zeros(2**levels - 1, dtype=int)
        self.cut = np.zeros(2**levels - 1)
        for node in range(2**levels - 1):
            part, parts[node] = parts[node], None
            if len(part) > 1:
                self.dim[node] = int(np.argmax(part.std(axis=0)))
                self.cut[node] = np.median(part[:, self.dim[node]])
            above = part[:, self.dim[node]] > self.cut[node]
            parts += [part[~above], part[above]]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.centre, x)
        node = np.zeros(len(x), dtype=int)
        rows = np.arange(len(x))
        for _ in range(self.levels):
            node = 2 * node + 1 + (x[rows, self.dim[node]] > self.cut[node])
        return node - (2**self.levels - 1)


class _Cells:
    """Boxes, masks and sizes of all cells, for bounds on the distance of their vectors."""

    def __init__(self, table: pd.DataFrame, width: int):
        self.leaf = table["leaf"].to_numpy()
        self.rows = table["rows"].to_numpy()
        self.lo = np.array(table["lo"].tolist(), dtype=float).reshape(len(table), width)
        self.hi = np.array(table["hi"].tolist(), dtype=float).reshape(len(table), width)
        self.mixed = (table["mask"] == _MIXED).to_numpy()
        self.has = ~np.isnan(self.lo)
        self.width = width

    def least(self, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared lower bounds between the boxes ``[lo, hi]`` and the cells ``at``.

        Infinite where they share no column. In a mixed cell the shared columns are unknown: the
        mean is at least the least term.
        """
        gap = np.maximum(self.lo[at] - hi[:, None], lo[:, None] - self.hi[at])
        usable = ~np.isnan(gap)
        term = np.where(usable, np.maximum(gap, 0.0), 0.0) ** 2
        shared = usable.sum(axis=2)
        low = term.sum(axis=2) * (self.width / np.maximum(shared, 1))
        mixed = np.where(usable, term, np.inf).min(axis=2) * self.width
        return np.where(shared == 0, np.inf, np.where(self.mixed[at], mixed, low))

    def reach(self, q: np.ndarray, j: int, k: int) -> float:
        """A squared distance within which ``k`` rows with column ``j`` surely lie."""
        far = np.maximum(np.abs(self.lo - q), np.abs(self.hi - q))
        usable = ~np.isnan(far)
        shared = usable.sum(axis=1)
        high = (np.where(usable, far, 0.0) ** 2).sum(axis=1) * (self.width / np.maximum(shared, 1))
        sure = np.flatnonzero(self.has[:, j] & ~self.mixed & (shared > 0))
        order = sure[np.argsort(high[sure], kind="stable")]
        enough = np.searchsorted(np.cumsum(self.rows[order]), k)
        return high[order[enough]] if enough < len(order) else np.inf

    def to_visit(self, q: np.ndarray, radius: np.ndarray, leaf: int, k: int) -> list[np.ndarray]:
        """For vectors of one leaf and pattern: the other leaves with a cell that their radii reach.

        ``radius`` is a squared distance per missing column, NaN where the leaf gave no ``k``.
        """
        gaps = np.flatnonzero(np.isnan(q[0]))
        radius = radius[:, gaps].copy()
        for i, g in np.argwhere(np.isnan(radius)):
            radius[i, g] = self.reach(q[i], gaps[g], k)
        radius *= _SLACK
        every = np.arange(len(self.leaf))
        near = self.least(q.min(axis=0)[None], q.max(axis=0)[None], every)[0]
        donors = self.has[:, gaps]
        block = (donors & (near[:, None] <= radius.max(axis=0))).any(axis=1)
        at = np.flatnonzero(block & (self.leaf != leaf) & np.isfinite(near))
        low = self.least(q, q, at)
        wanted = np.zeros(low.shape, dtype=bool)
        for g in range(len(gaps)):
            wanted |= donors[at, g] & (low <= radius[:, g, None])
        return [np.unique(self.leaf[at[w]]) for w in wanted]


def _parts(rows: int) -> int:
    return max(1, -(-int(rows) // _CHUNK))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _vectors(frame: pd.Series, width: int) -> np.ndarray:
    return np.array(frame.tolist(), dtype=float).reshape(len(frame), width)


def _nearest(queries: np.ndarray, donors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(query, column, squared distance, donor)`` of the k nearest donors, block by block."""
    width = queries.shape[1]
    known = ~np.isnan(donors)
    step = max(1, _PAIRS // max(len(donors), 1))
    for at in range(0, len(queries), step):
        block = queries[at:at + step]
        total = np.zeros((len(block), len(donors)))
        shared = np.zeros((len(block), len(donors)), dtype=np.int64)
        for j in range(width):
            gap = block[:, j, None] - donors[:, j]
            both = ~np.isnan(gap)
            shared += both
            total += np.where(both, gap, 0.0) ** 2
        d2 = np.where(shared > 0, total * (width / np.maximum(shared, 1)), np.inf)
        for j in range(width):
            asking = np.flatnonzero(np.isnan(block[:, j]))
            able = np.flatnonzero(known[:, j])
            if not len(asking) or not len(able):
                continue
            mine = d2[np.ix_(asking, able)]
            if len(able) > k:
                kth = np.partition(mine, k - 1, axis=1)[:, k - 1, None]
                row, column = np.nonzero((mine <= kth) & np.isfinite(mine))
            else:
                row, column = np.nonzero(np.isfinite(mine))
            far, donor = mine[row, column], able[column]
            order = np.lexsort((donors[donor, j], far, row))
            row, far, donor = row[order], far[order], donor[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
            yield (at + asking[row[kept]], np.full(kept.sum(), j, dtype=np.int32), far[kept],
                   donor[kept])


def _visit(left: pd.DataFrame, right: pd.DataFrame, k: int, width: int) -> pd.DataFrame:
    columns = ["id", "j", "d2", "value", "n"]
    if left.empty or right.empty:
        return pd.DataFrame(columns=columns)
    donors, n = _vectors(right["x"], width), right["n"].to_numpy()
    ids = left["id"].to_numpy()
    found = [
        pd.DataFrame({"id": ids[i], "j": j, "d2": d2, "value": donors[a, j], "n": n[a]})
        for i, j, d2, a in _nearest(_vectors(left["q"], width), donors, k)
    ]
    return pd.concat(found) if found else pd.DataFrame(columns=columns)


def _into_cells(
    vectors: DataFrame, width: int, cell_rows: int
) -> tuple[DataFrame, pd.DataFrame]:
    """The vectors with ``mask`` and ``leaf``, and the small table of all cells."""
    ship(vectors.sparkSession)
    total = vectors.count()
    wanted = min(max(total / cell_rows, 1), MOST_CELLS)
    levels = math.ceil(math.log2(wanted))
    size = _LEAF_SAMPLE << levels
    sample = vectors.select("x").sample(min(1.0, 1.5 * size / max(total, 1)), seed=1).limit(size)
    points = _matrix(sample.toArrow()["x"].combine_chunks(), width)
    shared = vectors.sparkSession.sparkContext.broadcast(_Tree(points, levels))

    @F.arrow_udf("int")
    def leaf(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.leaf(_matrix(x, width)), pa.int32())

    bits = F.transform("x", lambda v: F.when(v.isNull(), "1").otherwise("0"))
    placed = stored(
        vectors.withColumns({"mask": F.array_join(bits, ""), "leaf": leaf("x")}), "knn-placed"
    )
    lo = [F.min(F.col("x")[j]).alias(f"lo{j}") for j in range(width)]
    hi = [F.max(F.col("x")[j]).alias(f"hi{j}") for j in range(width)]
    finest = stored(
        placed.groupBy("mask", "leaf").agg(
            *lo, *hi, F.sum("n").alias("rows"), F.count("*").alias("vectors")
        ),
        "knn-cells",
    )
    # Coarser cells, from the table of the finest, until they fit one small table.
    dropped, mask = 0, F.col("mask")
    while _coarser(finest, mask, dropped).count().count() > MOST_CELLS:
        if dropped < levels:
            dropped += 1
        else:
            dropped, mask = 0, F.lit(_MIXED)
    boxes = _coarser(finest, mask, dropped).agg(
        F.array(*[F.min(f"lo{j}") for j in range(width)]).alias("lo"),
        F.array(*[F.max(f"hi{j}") for j in range(width)]).alias("hi"),
        F.sum("rows").alias("rows"),
        F.sum("vectors").alias("vectors"),
    )
    table = boxes.orderBy("mask", "leaf").toPandas()
    return placed.withColumns({"mask": mask, "leaf": F.shiftright("leaf", dropped)}), table


def _coarser(finest: DataFrame, mask: Column, dropped: int) -> GroupedData:
    """The finest cells grouped by a shorter leaf code."""
    return finest.groupBy(mask.alias("mask"), F.shiftright("leaf", dropped).alias("leaf"))


def _met(queries: DataFrame, donors: DataFrame, plan: DataFrame, k: int, width: int) -> DataFrame:
    """The donors that visitors find where both are, in chunks and turns of bounded size.

    ``plan`` has the numbers of both for each place.
    """
    plan = F.broadcast(plan)

    def part(c: str, n: str) -> Column:
        return F.pmod(F.xxhash64(c), F.col(n)).cast("int")

    left = (
        queries.join(plan, "place")
        .withColumn("turn", part("q", "turns"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("place", "chunk", "turn", "id", "q")
    )
    right = (
        donors.join(plan, "place")
        .withColumn("chunk", part("x", "chunks"))
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        .select(F.col("place").alias("at"), "chunk", "turn", "x", "n")
    )
    asking, there = left.groupBy("place", "chunk", "turn"), right.groupBy("at", "chunk", "turn")
    return asking.cogroup(there).applyInPandas(lambda a, b: _visit(a, b, k, width), _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The rows that hold the ``k`` nearest donors of each column, with the running ``upto``."""
    order = Window.partitionBy("id", "j").orderBy("d2", "value", "n")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumns({"upto": upto, "place": F.row_number().over(order)}).filter(
        F.col("place") <= k
    ).drop("place")


def _predictions(vectors: DataFrame, width: int, k: int, cell_rows: int) -> DataFrame:
    """``(q, j, value)`` for every missing column ``j`` of every distinct vector ``q``."""
    spark = vectors.sparkSession
    placed, table = _into_cells(vectors, width, cell_rows)
    cells = _Cells(table, width)
    shared = spark.sparkContext.broadcast(cells)
    queries = placed.filter(F.exists("x", lambda v: v.isNull())).withColumnRenamed("x", "q")

    # 1: the vectors of the own leaf; one row per leaf, at most MOST_CELLS of them
    asking = table["vectors"].where(table["mask"].str.contains("1|\\*"), 0)
    leaves = pd.DataFrame({"place": cells.leaf, "all": table["vectors"], "asking": asking})
    leaves = leaves.groupby("place", as_index=False).sum()
    sizes = small_table(
        spark,
        [(int(p), _parts(a), _parts(q)) for p, a, q in leaves.itertuples(index=False)],
        "place int, chunks int, turns int",
    )
    placed = placed.withColumnRenamed("leaf", "place")
    queries = queries.withColumnRenamed("leaf", "place")
    near = stored(_best(_met(queries, placed, sizes, k, width), k), "knn-home")
    radius = near.groupBy("id", "j").agg(F.min(F.when(F.col("upto") >= k, F.col("d2"))).alias("r"))
    radii = radius.groupBy("id").agg(
        F.array(*[F.max(F.when(F.col("j") == j, F.col("r"))) for j in range(width)]).alias("radii")
    )

    # 2: the other leaves within the radius
    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = [None] * width
        for batch in batches:
            q = _vectors(batch["q"], width)
            r = _vectors(batch["radii"].map(lambda v: none if v is None else v), width)
            out = np.empty(len(batch), dtype=object)
            leaf = batch["place"].to_numpy()
            blocks = batch.reset_index(drop=True).groupby(["place", "mask"]).indices
            for rows in blocks.values():
                found = shared.value.to_visit(q[rows], r[rows], leaf[rows[0]], k)
                for i, places in zip(rows, found):
                    out[i] = places
            yield pd.DataFrame({"id": batch["id"], "q": batch["q"], "places": out})

    patterns = F.array_join(F.transform("q", lambda v: F.when(v.isNull(), "1").otherwise("0")), "")
    asked = queries.withColumn("mask", patterns).join(radii, "id", "left")
    asked = asked.repartitionByRange("place", "mask").sortWithinPartitions("place", "mask")
    asked = stored(
        asked.select("id", "q", "place", "mask", "radii")
        .mapInPandas(visits, "id bigint, q array<double>, places array<int>")
        .select("id", "q", F.explode("places").alias("place")),
        "knn-visits",
    )
    turns = F.ceil(F.count("*") / _CHUNK).cast("int").alias("turns")
    plan = sizes.drop("turns").join(asked.groupBy("place").agg(turns), "place")
    away = _met(asked, placed, plan, k, width)
    best = _best(near.drop("upto").unionByName(away), k)
    taken = F.greatest(F.least(F.col("n"), k - (F.col("upto") - F.col("n"))), F.lit(0))
    weight = F.col("taken") / F.sqrt("d2")
    same = F.sum(F.when(F.col("d2") == 0, F.col("taken")))
    same_sum = F.sum(F.when(F.col("d2") == 0, F.col("taken") * F.col("value")))
    far = F.when(F.col("d2") > 0, weight)
    values = (
        best.withColumn("taken", taken)
        .groupBy("id", "j")
        .agg(
            F.coalesce(
                F.try_divide(same_sum, same), F.try_divide(F.sum(far * F.col("value")), F.sum(far))
            ).alias("value")
        )
    )
    return values.join(queries.select("id", "q"), "id")


def impute_knn(
    df: DataFrame, columns: Sequence[str], k: int | None = None, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Gaps become the distance-weighted mean of the ``k`` nearest rows that have the column.

    Rows at distance zero take all the weight; without a usable neighbour the column's mean
    is used. ``k`` defaults to a twentieth of the rows, between 1 and 5.
    """
    stats = column_aggregates(
        df,
        {c: number(df, c) for c in columns},
        lambda x: {"n": F.count(x), "mean": F.avg(x), "rows": F.count(F.lit(1))},
    )
    total = max((s["rows"] or 0 for s in stats.values()), default=0)
    columns = [c for c in columns if stats[c]["n"]]
    if not columns or all(stats[c]["n"] == total for c in columns):
        return df
    k = k or neighbours(total)
    x = F.array(*[number(df, c) for c in columns])
    keyed = df.withColumn("__q", x)
    vectors = stored(
        keyed.groupBy(F.col("__q").alias("x")).agg(F.count("*").alias("n"))
        .withColumn("id", F.monotonically_increasing_id()),
        "knn-vectors",
    )
    predicted = _predictions(vectors, len(columns), k, cell_rows)
    wide = predicted.groupBy(F.col("q").alias("__q")).agg(
        *[F.max(F.when(F.col("j") == j, F.col("value"))).alias(f"__p{j}")
          for j in range(len(columns))]
    )
    gap = F.exists("__q", lambda v: v.isNull())
    # A vector that very many rows share is split by adaptive execution: the rows are the left side.
    joined = keyed.filter(gap).join(wide, "__q", "left")
    new = {
        c: F.coalesce(F.col("__q")[j], F.col(f"__p{j}"), F.lit(stats[c]["mean"])).alias(c)
        for j, c in enumerate(columns)
    }
    kept = {c: F.col("__q")[j].alias(c) for j, c in enumerate(columns)}
    return (
        keyed.filter(~gap).select(*[kept.get(c, cell(c)) for c in df.columns])
        .unionByName(joined.select(*[new.get(c, cell(c)) for c in df.columns]))
    )
