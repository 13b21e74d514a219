"""Exact top-k search by inner product: distributed histograms locate every kth score.

Scores are integers: components become ``floor(256 * x)``. The queries are a stated set, taken in
blocks of ``QUERIES``; a block is broadcast and meets all vectors.

Each pass scores everything again (a matrix product per batch) instead of keeping scores. The
first passes count, per query, the scores in the bins of its current range; the sums over all
batches tell which bin holds the kth score, and that bin is the next range, until it is one score
wide. The last pass keeps the scores at or above the kth and breaks ties by ``vec_id``. A batch
hands on only what is not below its own kth score, which no result can be, so neither the counts
nor the rows of a pass grow with ties, copies or a common vector.

Defined results: rows without ``vec_id``, and vectors that are null or hold null or non-finite
components, take no part; vectors of different lengths are not compared; a query is not compared
with any row of its own ``vec_id``; repeated query rows of one ``vec_id`` and vector are asked
once; fewer candidates than ``k`` give them all; components and scores beyond 64 bits count as the
ends of that range (plus or minus ``2**63 - 1``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import written
from burnish.plans.shipping import ship

#: Queries broadcast at a time, bins of a histogram, candidates scored at a time.
QUERIES, BINS, ROWS = 4096, 4096, 2048
#: The largest score.
LARGEST = (1 << 63) - 1


def whole_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v`` of the rows that take part, ``v`` in whole numbers."""
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    whole = F.transform("embedding", lambda x: F.greatest(
        F.floor(x.cast("double") * scale).cast("long"), F.lit(-LARGEST)))
    return df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


class Block:
    """A block of queries: ids, vectors and, per query, the range that is still open."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, bound: int):
        self.ids, self.k = ids, k
        self.vectors, self.real = vectors, vectors.astype(np.float64)
        self.most = int(np.abs(vectors).max(initial=0))
        wide = bound >= 1 << 62
        self.low = np.full(len(ids), -1 << 63 if wide else -bound, dtype=np.int64)
        self.span = 1 << 64 if wide else 2 * bound + 1  # of the open range from ``low`` on
        self.width = -(-self.span // BINS)
        self.need = np.full(len(ids), k, dtype=np.int64)
        self.done = np.zeros(len(ids), dtype=bool)

    def products(self, rows: np.ndarray) -> np.ndarray:
        """Inner products of all queries and rows; the parts that doubles can't hold apart."""
        limit = rows.shape[1] * self.most * int(np.abs(rows).max(initial=0))
        real = rows.astype(np.float64).T
        if limit < 1 << 53:
            return (self.real @ real).astype(np.int64)
        got = self.vectors @ rows.T  # wraps where 64 bits do not suffice
        if limit >= 1 << 62:
            for q, r in np.argwhere(np.abs(self.real) @ np.abs(real) >= 2.0**62):
                exact = sum(a * b for a, b in zip(self.vectors[q].tolist(), rows[r].tolist()))
                got[q, r] = max(-LARGEST, min(LARGEST, exact))
        return got

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates' ids, scores and which of them are worth handing on."""
        ids = batch.column("vec_id").to_numpy()
        flat = batch.column("v").flatten().to_numpy().reshape(len(ids), -1)
        for at in range(0, len(ids), ROWS):
            own = ids[at:at + ROWS]
            rows = flat[at:at + ROWS]
            got = self.products(rows)
            other = self.ids[:, None] != own[None, :]
            if len(own) > self.k:
                masked = np.where(other, got, np.iinfo(np.int64).min)
                floor = np.partition(masked, len(own) - self.k, axis=1)[:, len(own) - self.k]
                other &= got >= floor[:, None]
            yield own, got, other


def _histogram(block) -> object:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            for _, scores, worth in b.scores(batch):
                # as unsigned numbers scores below ``low`` lie beyond the span
                where = scores.view(np.uint64) - b.low.view(np.uint64)[:, None]
                worth = worth & (where <= np.uint64(b.span - 1)) & ~b.done[:, None]
                where = (where // np.uint64(b.width)).astype(np.int64)
                query, column = np.nonzero(worth)
                cells, n = np.unique(query * BINS + where[query, column], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells // BINS), pa.array(cells % BINS), pa.array(n)],
                    ["query", "bin", "n"],
                )

    return counted


def _chosen(block) -> object:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            for ids, scores, worth in b.scores(batch):
                query, column = np.nonzero(worth & (scores >= b.low[:, None]))
                found, own = scores[query, column], ids[column]
                order = np.lexsort((own, -found, query))
                query, found, own = query[order], found[order], own[order]
                first = np.searchsorted(query, query, side="left")
                kept = np.arange(len(query)) - first < b.k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query[kept]), pa.array(b.ids[query[kept]]), pa.array(own[kept]),
                     pa.array(found[kept])],
                    ["query", "query_id", "vec_id", "score"],
                )

    return best


def _located(candidates: DataFrame, block: Block) -> Block:
    """Narrow every query's range until it is its kth score alone."""
    sc = candidates.sparkSession.sparkContext
    while True:
        shared = sc.broadcast(block)
        counts = candidates.mapInArrow(_histogram(shared), "query long, bin long, n long")
        counts = counts.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        upto = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))
        rows = counts.withColumn("upto", upto).withColumn("above", F.col("upto") - F.col("n"))
        need = candidates.sparkSession.createDataFrame(
            [(i, int(n)) for i, n in enumerate(block.need)], "query long, need long"
        )
        rows = rows.join(F.broadcast(need), "query").where("above < need and need <= upto")
        hits = rows.select("query", "bin", "above").collect()
        found = {r["query"]: (r["bin"], r["above"]) for r in hits}
        for i in range(len(block.ids)):
            if block.done[i]:
                continue
            if i not in found:  # fewer candidates than k: everything at or above the low end
                block.done[i] = True
                continue
            at, above = found[i]
            block.low[i] = int(block.low[i]) + at * block.width
            block.need[i] -= above
        if block.width == 1 or block.done.all():
            return block
        block.span = block.width
        block.width = -(-block.span // BINS)


def top_k(df: DataFrame, asked: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best of each row for which ``asked`` holds."""
    spark = df.sparkSession
    ship(spark)
    vectors = written(
        whole_vectors(df).withColumn("size", F.size("v")).withColumn(
            "most", F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0))
        ),
        "vectors",
    )
    queries = written(vectors.where(asked).select("vec_id", "v", "size").distinct(), "queries")
    parts = []
    sizes = queries.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()
    for size, n in sizes:
        if not size:
            continue
        candidates = vectors.where(F.col("size") == size)
        most = candidates.agg(F.max("most")).first()[0]
        blocks = -(-n // (QUERIES // 2)) if n > QUERIES else 1
        for i in range(blocks):
            mine = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == i
            rows = queries.where((F.col("size") == size) & mine).collect()
            rows.sort(key=lambda r: (r["vec_id"], r["v"]))
            ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
            table = np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), size)
            bound = size * most * int(np.abs(table).max(initial=0))
            block = _located(candidates.select("vec_id", "v"), Block(ids, table, k, bound))
            shared = spark.sparkContext.broadcast(block)
            parts.append(candidates.select("vec_id", "v").mapInArrow(
                _chosen(shared), "query long, query_id long, vec_id long, score long"
            ).withColumn("block", F.lit(f"{size}:{i}")))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
