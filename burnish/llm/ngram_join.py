"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Texts are compared by their sets of five-word shingles (lower-cased words between white space; a
text of fewer words is one shingle). Links join different texts of Jaccard similarity 0.8 or more.

1. One pass over the texts gives each a digest of its words, its MinHash values and band keys.
   Equal texts fall together by the digest; everything after works on one row per digest.
2. In every band bucket all members are paired with the smallest one (a star, never all pairs).
   MinHash values of a pair are compared in steps; it is dropped as soon as the posterior
   probability of reaching the threshold falls below the tolerance. The rest is verified exactly.
3. Members of a bucket that are not linked to a common leader are compared with each other, in
   blocks, across leaders only; the members of the bucket's largest leader, who are joined already,
   meet the blocks of the others and never their own. A task hands on the exact links that join
   what it had not joined yet, at most one per member. So no pair that shares a bucket is skipped
   unless its two texts are connected already. Components of all links follow by large-star and
   small-star rounds.
4. Inside each class all pairs of different texts are counted exactly, in blocks of members, by a
   product of their shingle incidence matrices; only counts leave a task.

Defined results: null texts and texts without words have no shingles, link to nothing, and each
such row is its own class; rows that repeat a ``doc_id`` are separate documents; ``class_id`` is
the smallest ``doc_id`` of the class, null if there is none; columns other than ``doc_id`` and the
text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import BLANKS, prepare, slices, written

WORDS = 5
THRESHOLD = 0.8
BANDS, PER_BAND = 24, 4
#: MinHash values compared before each look at the posterior, and the tolerance.
STEP, TOLERANCE = 16, 1e-6
#: Members of a bucket or class that are compared with each other in one task.
BLOCK = 512
#: Ids up to this number (8 MB of digests) are broadcast to pick out their texts.
MOST_BROADCAST = 500_000

_HASHES = BANDS * PER_BAND
_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1, 1 << 32, _HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, _HASHES, dtype=np.uint32)
_WORD_MIX = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_EMPTY = np.uint64(xxhash.xxh64_intdigest(""))
_BAND_MIX = _RNG.integers(1, 1 << 63, PER_BAND, dtype=np.uint64) | np.uint64(1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in a row, and where each text's begin."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    codes = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    hashed = np.array([xxhash.xxh64_intdigest(w) for w in codes.dictionary.to_pylist()], np.uint64)
    values = hashed[codes.indices.to_numpy()] if len(hashed) else np.zeros(0, np.uint64)
    # a text that begins or ends with white space has empty words at its ends
    real = values != _EMPTY
    before = np.concatenate([[0], np.cumsum(real)])
    return values[real], before[offsets - offsets[0]]


def _digests(values: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128 bits of the words of each text; None for a text without words."""
    return [
        hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None
        for a, b in zip(offsets[:-1], offsets[1:])
    ]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of a common public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, and where each text's begin. Repeats stay."""
    sizes = np.diff(offsets)
    counts = np.where(sizes >= WORDS, sizes - WORDS + 1, (sizes > 0).astype(sizes.dtype))
    starts = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(offsets[:-1] - starts[:-1], counts) + np.arange(starts[-1])
    have = np.repeat(np.minimum(sizes, WORDS), counts)
    padded = np.concatenate([values, np.zeros(WORDS, dtype=np.uint64)])
    out = np.zeros(starts[-1], dtype=np.uint64)
    for i in range(WORDS):
        term = padded[first + i] * _WORD_MIX[i]
        out = _mixed(out + np.where(have > i, term, np.uint64(i)))
    return out, starts


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return values[offsets[0]:offsets[-1]], offsets - offsets[0]


def _binary_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of the matrix as bytes."""
    matrix = np.ascontiguousarray(matrix)
    data = pa.py_buffer(matrix.tobytes())
    kind = pa.binary(matrix.shape[1] * matrix.itemsize)
    return pa.FixedSizeBinaryArray.from_buffers(kind, len(matrix), [None, data]).cast(pa.binary())


def _min_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values of texts that all have shingles, one row per text."""
    low = (values >> np.uint64(16)).astype(np.uint32)
    out = np.empty((len(starts) - 1, _HASHES), dtype=np.uint32)
    step = 1 << 15  # a slice that stays in the processor's cache
    begin = 0
    while begin < len(starts) - 1:
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + step, "right")) - 1)
        part = low[starts[begin]:starts[end]]
        cuts = starts[begin:end] - starts[begin]
        for h in range(_HASHES):
            out[begin:end, h] = np.minimum.reduceat(part * _MULTIPLY[h] + _ADD[h], cuts)
        begin = end
    return out


def _bands(mins: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band of every row."""
    grouped = mins.reshape(len(mins), BANDS, PER_BAND).astype(np.uint64)
    key = np.zeros((len(mins), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(PER_BAND):
        key = _mixed(key + grouped[:, :, i] * _BAND_MIX[i])
    return key


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, digest, mins, bands`` of the documents that have words."""
    for batch in batches:
        for rows in slices(batch.column("text")):
            part = batch.slice(int(rows[0]), len(rows))
            hashes, offsets = word_hashes(part.column("text"))
            digest = pa.array(_digests(hashes, offsets), pa.binary())
            some = np.diff(offsets) > 0
            values, starts = shingles(hashes, offsets)
            mins = _min_hashes(values, np.append(starts[:-1][some], starts[-1]))
            keys = _bands(mins).view(np.int64)
            cuts = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").filter(pa.array(some)),
                    digest.filter(pa.array(some)),
                    _binary_rows(mins),
                    pa.ListArray.from_arrays(cuts, pa.array(keys.ravel())),
                ],
                ["doc_id", "digest", "mins", "bands"],
            )


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``digest, grams``: the sorted shingle hashes of the documents that have words."""
    for batch in batches:
        for rows in slices(batch.column("text")):
            hashes, offsets = word_hashes(batch.column("text").slice(int(rows[0]), len(rows)))
            values, starts = shingles(hashes, offsets)
            for i, digest in enumerate(_digests(hashes, offsets)):
                if digest:
                    own = np.unique(values[starts[i]:starts[i + 1]]).view(np.int64)
                    cuts = pa.array([0, len(own)], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([digest], pa.binary()),
                         pa.ListArray.from_arrays(cuts, pa.array(own))],
                        ["digest", "grams"],
                    )


@cache
def least_matches() -> np.ndarray:
    """For 0..all values compared, the fewest matches a pair may have to go on.

    With a uniform prior the similarity after ``m`` matches of ``n`` is Beta(m + 1, n - m + 1);
    its mass above the threshold is the chance of at most ``m`` successes in ``n + 1`` trials.
    """
    out = np.zeros(_HASHES + 1, dtype=np.int64)
    for n in range(1, _HASHES + 1):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
            if tail >= TOLERANCE:
                out[n] = m
                break
    return out


def _survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two equally long MinHash tables stay after all looks at the posterior."""
    least = least_matches()
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    for n in range(STEP, _HASHES + 1, STEP):
        cols = slice(n - STEP, n)
        matches[alive] += (a[alive, cols] == b[alive, cols]).sum(axis=1)
        alive = alive[matches[alive] >= least[n]]
    keep = np.zeros(len(a), dtype=bool)
    keep[alive] = True
    return keep


def _table(column: pa.Array) -> np.ndarray:
    rows = b"".join(v.as_py() for v in column)
    return np.frombuffer(rows, dtype=np.uint32).reshape(len(column), _HASHES)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keep = _survivors(_table(batch.column("mins_a")), _table(batch.column("mins_b")))
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def picked(df: DataFrame, few: DataFrame, on, how: str) -> DataFrame:
    """Join the documents with some of their keys, which are broadcast while they are few."""
    return df.join(F.broadcast(few) if few.count() <= MOST_BROADCAST else few, on, how)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``digest, grams`` of the wanted ``digest, doc_id`` rows, written down."""
    ids = wanted.select(F.col("doc_id").alias("__id"))
    own = picked(docs, ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    found = own.select("text").mapInArrow(_grams, "digest binary, grams array<bigint>")
    found = found.join(wanted.select("digest"), "digest", "left_semi")
    return written(found.groupBy("digest").agg(F.any_value("grams").alias("grams")), "grams")


def _verified(pairs: DataFrame, grams: DataFrame, name: str) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold."""
    left = grams.select(F.col("digest").alias("a"), F.col("grams").alias("grams_a"))
    right = grams.select(F.col("digest").alias("b"), F.col("grams").alias("grams_b"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    either = F.size("grams_a") + F.size("grams_b") - both
    close = pairs.join(left, "a").join(right, "b").where(both >= THRESHOLD * either)
    return written(close.select("a", "b"), name)


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected component, for all linked nodes.

    Large-star and small-star rounds: a node hands its larger neighbours, then itself, to its
    smallest neighbour. Both are grouped minima and joins; the last round changes nothing.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u != v").distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "low")
        large = (
            both.join(low, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
        )
        large = written(large.where("u != v").distinct(), "large-star")
        low = written(large.groupBy("u").agg(F.min("v").alias("low")), "low")
        small = large.join(low, "u").where("v != low")
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.union(low.select("u", F.col("low").alias("v")))
        fresh = written(small.where("u != v").distinct(), "small-star")
        now = _mark(fresh)
        if now == mark:
            break
        edges, mark = fresh, now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(df: DataFrame):
    """Equal for equal sets of edges."""
    return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                  F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()


def _block_pairs(members: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Deal the members of each group into blocks and repeat each for every pair of blocks.

    ``members`` tells the group's size ``n``, how many of these are ``n_joined`` with each other
    already, and whether a row is one of them (``joined``). Returns ``group, i, j`` with ``i <= j``
    and ``side`` 0 or 1; a row sits in block ``i`` or ``j`` of its pair. A block holds about
    ``BLOCK`` members. Blocks of joined members come first and are paired with the others only.
    """
    def blocks(n):
        return F.ceil(n / F.lit(BLOCK)).cast("int")

    dealt = members.withColumn("first", blocks(F.col("n_joined"))).withColumn(
        "rest", blocks(F.col("n") - F.col("n_joined"))
    )
    own = F.when(F.col("joined"), F.col("first")).otherwise(F.col("rest")).cast("long")
    mine = F.pmod(F.xxhash64("digest"), own) + F.when(F.col("joined"), 0).otherwise(F.col("first"))
    dealt = dealt.withColumn("mine", mine.cast("int")).withColumn(
        "other",
        F.explode(F.sequence(
            F.when(F.col("joined"), F.col("first")).otherwise(0),
            F.col("first") + F.col("rest") - 1,
        )),
    )
    return dealt.select(
        F.col(group).alias("group"),
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
        *columns,
    )


def _open_bands(placed: DataFrame) -> DataFrame:
    """Members of the bands that hold more than one root, marked for ``_block_pairs``.

    ``placed`` has ``digest, band, root``. Joined are those of the band's largest root.
    """
    roots = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = F.struct("size", "root")
    bands = (
        roots.groupBy("band")
        .agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("roots"), F.max(largest).alias("top"))
        .where("n > 2 and roots > 1")
        .select("band", "n", F.col("top.size").alias("n_joined"), F.col("top.root").alias("most"))
    )
    marked = placed.join(written(bands, "open-bands"), "band")
    return marked.withColumn("joined", F.col("root") == F.col("most")).drop("most")


def _across(table: pa.Table) -> pa.Table:
    """Links of one block pair between members that nothing has joined yet.

    A pair belongs to the first band on which its two texts agree, so no other bucket looks at
    it. What survives the pruning is verified exactly unless links of this block pair connect it.
    """
    mins = _table(table.column("mins").combine_chunks())
    digest = table.column("digest").to_pylist()
    roots = table.column("root").to_pylist()
    side = table.column("side").to_numpy()
    values, offsets = _flat(table.column("grams"))
    sizes = np.diff(offsets)
    same_block = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    keys = _bands(mins).view(np.int64)
    band = (keys == table.column("group")[0].as_py()).argmax(axis=1)
    number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    label = np.array([number[r] for r in roots])
    rows = np.arange(len(digest))
    left, right = (rows, rows) if same_block else (rows[side == 0], rows[side == 1])
    code = np.unique(values, return_inverse=True)[1]
    mine = np.zeros(len(values), dtype=bool)
    out: list[tuple[bytes, bytes]] = []
    for x in left:
        y = right[right > x] if same_block else right
        y = y[(label[y] != label[x])
              & (np.minimum(sizes[y], sizes[x]) >= THRESHOLD * np.maximum(sizes[y], sizes[x]))]
        y = y[(keys[y] == keys[x]).argmax(axis=1) == band[x]]
        if len(y):
            y = y[_survivors(np.broadcast_to(mins[x], (len(y), _HASHES)), mins[y])]
        y = y[label[y] != label[x]]
        own = code[offsets[x]:offsets[x + 1]]
        mine[own] = True
        for z in y:
            if label[z] == label[x]:
                continue
            both = np.count_nonzero(mine[code[offsets[z]:offsets[z + 1]]])
            if both >= THRESHOLD * (sizes[x] + sizes[z] - both):
                label[label == label[z]] = label[x]
                out.append((min(digest[x], digest[z]), max(digest[x], digest[z])))
        mine[own] = False
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()),
                     "b": pa.array([b for _, b in out], pa.binary())})


def _degrees(table: pa.Table) -> pa.Table:
    """How many members of the other block each member is linked to, exactly."""
    digest = table.column("digest").to_pylist()
    side = table.column("side").to_numpy()
    values, offsets = _flat(table.column("grams"))
    same_block = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    sizes = np.diff(offsets)
    order, number = np.unique(values, return_inverse=True)
    shared = np.bincount(number, minlength=len(order)) > 1
    links = np.zeros(len(digest), dtype=np.int64)
    rows = np.arange(len(digest))
    left, right = (rows, rows) if same_block else (rows[side == 0], rows[side == 1])
    column = np.cumsum(shared) - 1
    owner = np.repeat(rows, sizes)
    keep = shared[number]
    owner, place = owner[keep], column[number[keep]]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    at_left = np.full(len(digest), -1)
    at_left[left] = np.arange(len(left))
    at_right = np.full(len(digest), -1)
    at_right[right] = np.arange(len(right))
    width = 8192  # columns of the incidence matrices at a time
    by_place = np.argsort(place, kind="stable")
    owner, place = owner[by_place], place[by_place]
    for begin in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, [begin, begin + width])
        who, where = owner[a:b], place[a:b] - begin
        x = np.zeros((len(left), width), dtype=np.float32)
        mine = at_left[who] >= 0
        x[at_left[who[mine]], where[mine]] = 1
        if same_block:
            y = x
        else:
            y = np.zeros((len(right), width), dtype=np.float32)
            mine = at_right[who] >= 0
            y[at_right[who[mine]], where[mine]] = 1
        both += x @ y.T
    either = sizes[left][:, None] + sizes[right][None, :] - both
    close = both >= THRESHOLD * either
    if same_block:
        np.fill_diagonal(close, False)
        links[left] = close.sum(axis=1)
    else:
        links[left] = close.sum(axis=1)
        links[right] = close.sum(axis=0)
    return pa.table({"digest": pa.array(digest, pa.binary()), "n": pa.array(links)})


def linked_digests(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components of digests, the documents' digests, and the shingles of the candidates.

    The first has ``digest, root`` for every digest that is linked to another, the second
    ``doc_id, digest`` for every document with words, the third ``digest, grams``.
    """
    prepare(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"),
                     F.col(f"`{text}`").alias("text"))
    sketch = written(
        docs.mapInArrow(
            _sketch, "doc_id bigint, digest binary, mins binary, bands array<bigint>"
        ),
        "sketch",
    )
    distinct = written(
        sketch.groupBy("digest").agg(
            F.any_value("mins").alias("mins"),
            F.any_value("bands").alias("bands"),
            F.min("doc_id").alias("doc_id"),
        ),
        "distinct",
    )
    banded = distinct.select("digest", F.explode("bands").alias("band"))
    firsts = banded.groupBy("band").agg(F.min("digest").alias("a"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where("n > 1").select("band", "a"), "firsts")
    crowded = written(banded.join(firsts, "band"), "crowded")
    stars = crowded.where("a != digest").select("a", F.col("digest").alias("b")).distinct()
    mins = distinct.select("digest", "mins")
    left = mins.select(F.col("digest").alias("a"), F.col("mins").alias("mins_a"))
    right = mins.select(F.col("digest").alias("b"), F.col("mins").alias("mins_b"))
    stars = stars.join(right, "b").join(left, "a").select("a", "b", "mins_a", "mins_b")
    pruned = written(stars.mapInArrow(_prune, "a binary, b binary"), "pruned")
    wanted = distinct.join(crowded.select("digest").distinct(), "digest", "left_semi")
    grams = _texts_of(docs, written(wanted.select("digest", "doc_id"), "wanted"))
    links = _verified(pruned, grams, "links")
    leaders = written(links.groupBy(F.col("b").alias("digest")).agg(F.min("a").alias("lead")),
                      "leaders")
    placed = crowded.select("digest", "band").join(leaders, "digest", "left").withColumn(
        "root", F.coalesce("lead", "digest")
    )
    placed = written(placed.select("digest", "band", "root"), "placed")
    placed = _open_bands(placed)
    placed = placed.join(mins, "digest").join(grams, "digest")
    dealt = _block_pairs(placed, "band", ["digest", "root", "mins", "grams"])
    more = dealt.groupBy("group", "i", "j").applyInArrow(_across, "a binary, b binary")
    roots = components(links.union(written(more, "across")))
    roots = written(roots.select(F.col("node").alias("digest"), "root"), "roots")
    return roots, sketch.select("doc_id", "digest"), grams


def join_classes(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of digests with exact link counts, and the documents' digests.

    The first has ``digest, root, n_links`` for every digest that is linked to another; the second
    ``doc_id, digest`` for every document with words.
    """
    roots, docs, grams = linked_digests(df, text)
    sizes = written(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "class-sizes")
    members = roots.join(sizes, "root").join(grams, "digest").withColumns(
        {"n_joined": F.lit(0), "joined": F.lit(False)}
    )
    dealt = _block_pairs(members, "root", ["digest", "grams"])
    counts = dealt.groupBy("group", "i", "j").applyInArrow(_degrees, "digest binary, n bigint")
    counts = counts.groupBy("digest").agg(F.sum("n").alias("n_links"))
    return written(roots.join(counts, "digest"), "classes"), docs


def near_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` of every document.

    ``class_id`` is the smallest ``doc_id`` of the documents joined directly or through others,
    ``n_links`` the number of other texts at the threshold or above, ``n_copies`` the number of
    documents with this very text (the document itself included).
    """
    classes, docs = join_classes(df, text)
    same = docs.groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies")
    )
    same = written(same.join(classes, "digest", "left"), "copies")
    first = same.where("root is not null").groupBy("root").agg(F.min("least").alias("first"))
    named = same.join(written(first, "first-of-class"), "root", "left").select(
        "digest",
        F.coalesce("first", "least").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_copies",
    )
    own = docs.join(named, "digest").drop("digest")
    bare = df.where(~F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(f"[^{BLANKS}]")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("doc_id").cast("long").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("n_copies"),
    )
    return own.unionByName(bare)


def keep_one(df: DataFrame, text: str = "text") -> DataFrame:
    """One document of each class stays: the one with the smallest ``doc_id`` (null last).

    Of rows that repeat this ``doc_id`` and text one stays. Documents without words all stay.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    roots, docs, _ = linked_digests(df, text)
    linked = docs.join(roots, "digest", "left").withColumn(
        "root", F.coalesce("root", "digest")
    )
    linked = written(linked, "linked")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    best = linked.groupBy("root").agg(F.min(one).alias("best"), F.count(F.lit(1)).alias("n"))
    best = written(best.where("n > 1").select("root", "best"), "best")
    groups = linked.select("root", "digest").distinct().join(best, "root")
    groups = written(
        groups.select(F.col("digest").alias("__digest"), F.col("best").alias("__best")), "groups"
    )
    own = df.withColumn("__digest", _digest_udf()(F.col(f"`{text}`")))
    own = picked(own, groups, "__digest", "left")
    alone = F.col("__best").isNull()
    chosen = (F.col("__best.digest") == F.col("__digest")) & F.col("__best.doc_id").eqNullSafe(
        F.col("doc_id").cast("long")
    )
    once = own.where(~alone & chosen).dropDuplicates(["__digest"])
    return own.where(alone).select(*names).unionByName(once.select(*names))


def _digest_udf():
    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        out: list[bytes | None] = []
        for rows in slices(texts):
            out += _digests(*word_hashes(texts.slice(int(rows[0]), len(rows))))
        return pa.array(out, pa.binary())

    return digest
