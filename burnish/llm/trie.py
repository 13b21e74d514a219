"""Prefix trie of conversations by vertical bitmaps.

Conversations go to shards by ranges of ids. A shard numbers its conversations by id and holds, for
every (position, turn), a bitset of those that have this turn there, and for every length a bitset
of those that end there. From the root down, a node's bitset meets the postings of the next
position: the lowest member left names the next turn, the intersection is the child, and its
members are taken out, so only postings that give a child are touched. Popcounts are the members,
the lowest bit is the smallest member, and the intersection with the ends is the end list.

Nodes of different shards are the same if the digests of their prefixes are; one aggregation by
digest merges them. What a subtree sums up needs no walk over the merged trie: a node belongs to
its smallest member, so a conversation owns the nodes of its path from some depth on. A second walk
of the shards, which knows that depth of every conversation and whether its last node is childless,
adds up each subtree from the members' own shares, and these sums are merged like the counts.

End lists keep the order of the shards, whose ids are disjoint ranges; they are hashed piece by
piece and never held whole.

Defined results: turns are ordered by ``turn`` (null first), ties by role and text; a null role or
text is an empty one; rows without ``conv_id`` take no part; an empty table gives no rows. A
conversation's turns meet in one task as 16-byte digests.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import prepare, shuffle_partitions, written

#: Conversations and turns of a shard: the width of its bitsets and its memory.
SHARD, SHARD_TURNS = 2048, 1 << 18
#: First turns that a conversation may take from the first of its hundred, at most.
HEADS = 5
#: Rows of a batch that a task hands on.
OUT_ROWS = 8192

_TURNS = "conv_id long, range int, nth long, turn_key binary, chars long"


# Turns as digests with their positions


def numbered_turns(df: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_key, chars``: positions from 0, turns as 16 bytes of SHA-256.

    Rows are sorted in ranges of (conversation, turn), so a conversation may span ranges; the
    counts of its earlier ranges are added.
    """
    spark = df.sparkSession
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        text.alias("text"),
    )
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    ranges = (
        rows.repartitionByRange(shuffle_partitions(spark), *order)
        .withColumn("range", F.spark_partition_id())
        .sortWithinPartitions(*order)
        .select("conv_id", "range", F.unhex(F.substring(key, 1, 32)).alias("turn_key"),
                F.length("text").cast("long").alias("chars"))
    )
    rows = written(ranges.mapInArrow(_counted, _TURNS), "turns")
    totals = rows.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    spans = totals.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("range", "n")))
                                          .alias("parts"))
    # one entry per range that a conversation touches: as many as there are partitions, at most
    earlier = F.aggregate(
        F.filter("parts", lambda p: p["range"] < F.col("range")),
        F.lit(0).cast("long"), lambda a, p: a + p["n"],
    )
    return rows.join(spans, "conv_id").select(
        "conv_id", (F.col("nth") + earlier).alias("pos"), "turn_key", "chars",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("turns"),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation inside a sorted range."""
    last, seen = None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        new = np.flatnonzero(np.diff(ids)) + 1
        first = np.zeros(len(ids), dtype=np.int64)
        first[new] = new
        nth = np.arange(len(ids)) - np.maximum.accumulate(first)
        if ids[0] == last:
            nth[: new[0] if len(new) else len(ids)] += seen
        last, seen = ids[-1], int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("range"), pa.array(nth),
             batch.column("turn_key"), batch.column("chars")],
            ["conv_id", "range", "nth", "turn_key", "chars"],
        )


def rebuilt(df: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_key, chars`` of the rebuilt conversations, and a row of position -1 each.

    A conversation takes the first ``crc32(conv_id) % 6`` turns of the first of its hundred and
    goes on with its own turns after as many.
    """
    turns = written(numbered_turns(df), "positions")
    own = turns.where("pos = 0").select("conv_id", "turns")
    head = (F.crc32(F.col("conv_id").cast("string")) % (HEADS + 1)).cast("long")
    convs = own.select("conv_id", head.alias("h"),
                       (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    sizes = own.select(F.col("conv_id").alias("base"), F.col("turns").alias("there"))
    convs = written(
        convs.join(sizes, "base", "left").withColumn(
            "taken", F.least("h", F.coalesce("there", F.lit(0)))
        ).drop("there"),
        "conversations",
    )
    heads = turns.where(F.col("pos") < HEADS).select(
        F.col("conv_id").alias("base"), "pos", "turn_key", "chars"
    ).where("base % 100 = 0")
    first = convs.join(heads, "base").where("pos < taken")
    rest = turns.join(convs, "conv_id").where("pos >= h").withColumn(
        "pos", F.col("pos") - F.col("h") + F.col("taken")
    )
    marks = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"),
                         F.lit(None).cast("binary").alias("turn_key"),
                         F.lit(0).cast("long").alias("chars"))
    columns = ["conv_id", "pos", "turn_key", "chars"]
    return first.select(*columns).unionByName(rest.select(*columns)).unionByName(marks)


# The walk of a shard


class Shard:
    """Vertical index of some conversations in ascending order of id."""

    def __init__(self):
        self.ids: list[int] = []
        self.paths: list[list[bytes]] = []
        self.owned: list[tuple[int, bool]] = []
        self.postings: dict[tuple[int, bytes], int] = defaultdict(int)
        self.ends: dict[int, int] = defaultdict(int)
        self.chars: dict[bytes, int] = {}
        self.turns = 0

    def start(self, conv: int, first: int | None, leaf: bool | None) -> None:
        self.close()
        self.ids.append(conv)
        self.paths.append([])
        self.owned.append((first if first is not None else -1, bool(leaf)))

    def add(self, key: bytes, chars: int) -> None:
        path = self.paths[-1]
        self.postings[len(path), key] |= 1 << len(self.ids) - 1
        self.chars[key] = chars
        path.append(key)
        self.turns += 1

    def close(self) -> None:
        if self.ids:
            self.ends[len(self.paths[-1])] |= 1 << len(self.ids) - 1

    def nodes(self) -> Iterator[tuple[int, int, int, bytes | None, bytes]]:
        """``(row of the parent, bitset, depth, last turn, digest)``, parents before children."""
        if not self.ids:
            return
        stack = [(-1, (1 << len(self.ids)) - 1, 0, None, b"\0" * 16)]
        row = -1
        while stack:
            node = stack.pop()
            yield node
            row += 1
            _, members, depth, _, digest = node
            rest = members & ~self.ends.get(depth, 0)
            while rest:
                turn = self.paths[(rest & -rest).bit_length() - 1][depth]
                child = members & self.postings[depth, turn]
                rest &= ~child
                name = hashlib.sha256(digest + turn).digest()[:16]
                stack.append((row, child, depth + 1, turn, name))

    def members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of bounded size from rows sorted by conversation and position."""
    shard = Shard()
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv, pos, key, chars, *owned in zip(*columns):
            if pos < 0:
                if len(shard.ids) == SHARD or shard.turns >= SHARD_TURNS:
                    shard.close()
                    yield shard
                    shard = Shard()
                shard.start(conv, *(owned or (None, None)))
            else:
                shard.add(key, chars)
    shard.close()
    yield shard


_LOCAL = "digest binary, parent binary, depth long, conv_id long, n_convs long, ends array<long>"


def _local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("digest", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()),
        ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends", pa.list_(pa.int64())),
    ])
    for shard in _shards(batches):
        names: list[bytes] = []
        rows: list[tuple] = []
        for parent, members, depth, _, digest in shard.nodes():
            names.append(digest)
            ends = members & shard.ends.get(depth, 0)
            rows.append((digest, names[parent] if parent >= 0 else None, depth,
                         shard.ids[(members & -members).bit_length() - 1], members.bit_count(),
                         shard.members(ends) if ends else None))
            if len(rows) == OUT_ROWS:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)


_SUMS = "digest binary, leaves long, walked long, distinct_chars long"


def _local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the members of a shard add to each subtree.

    ``walked`` counts each node's last text once per member; ``distinct_chars`` counts it once, in
    the shard of the conversation that owns the node.
    """
    schema = pa.schema([("digest", pa.binary()), ("leaves", pa.int64()), ("walked", pa.int64()),
                        ("distinct_chars", pa.int64())])
    for shard in _shards(batches):
        parents, names, leaves, walked, once = [], [], [], [], []
        for parent, members, depth, turn, digest in shard.nodes():
            low = (members & -members).bit_length() - 1
            first, childless = shard.owned[low]
            mine = 0 <= first <= depth
            chars = shard.chars[turn] if turn is not None else 0
            parents.append(parent)
            names.append(digest)
            leaves.append(int(mine and childless and depth == len(shard.paths[low])))
            walked.append(members.bit_count() * chars)
            once.append(chars if mine else 0)
        for i in range(len(parents) - 1, 0, -1):
            p = parents[i]
            leaves[p] += leaves[i]
            walked[p] += walked[i]
            once[p] += once[i]
        for at in range(0, len(names), OUT_ROWS):
            cut = slice(at, at + OUT_ROWS)
            yield _batch(list(zip(names[cut], leaves[cut], walked[cut], once[cut])), schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names
    )


def _ranged(df: DataFrame) -> DataFrame:
    """Whole conversations in ranges of ids, sorted for the shards."""
    n = shuffle_partitions(df.sparkSession)
    return df.repartitionByRange(n, "conv_id").sortWithinPartitions("conv_id", "pos")


# Merging the shards


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined end lists of each node; rows come sorted by node and first id."""
    last, state, done = None, None, []
    for batch in batches:
        names = batch.column("digest").to_pylist()
        for name, ends in zip(names, batch.column("ends")):
            text = ",".join(map(str, ends.values.to_pylist())).encode()
            if name == last:
                state.update(b"," + text)
                continue
            if state is not None:
                done.append((last, state.hexdigest()))
            last, state = name, hashlib.sha256(text)
        if done:
            yield _ended(done)
            done = []
    if state is not None:
        yield _ended([(last, state.hexdigest())])


def _ended(done: list[tuple]) -> pa.RecordBatch:
    digests, hashes = zip(*done)
    return pa.RecordBatch.from_arrays(
        [pa.array(digests, pa.binary()), pa.array(hashes, pa.string())], ["digest", "ends_sha256"]
    )


def prefix_trie(df: DataFrame, rebuild: bool = True) -> DataFrame:
    """A row per node of the trie of all conversations (``conv_id, turn, role, text``).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``
    and ``n_ends``. With ``rebuild`` conversations are first given the heads that ``rebuilt`` says.
    """
    spark = df.sparkSession
    prepare(spark)
    if rebuild:
        paths = rebuilt(df)
    else:
        turns = written(numbered_turns(df), "positions")
        marks = turns.where("pos = 0").select(
            "conv_id", F.lit(-1).cast("long").alias("pos"),
            F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("chars"))
        paths = turns.drop("turns").unionByName(marks)
    paths = written(paths, "paths")
    local = written(_ranged(paths).mapInArrow(_local_nodes, _LOCAL), "nodes")
    merged = written(
        local.groupBy("digest").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            F.sum(F.coalesce(F.size("ends"), F.lit(0)).cast("long")).alias("n_ends"),
        ),
        "merged",
    )
    children = merged.groupBy(F.col("parent").alias("digest")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = written(
        merged.join(children, "digest", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0))),
        "counted",
    )
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("first"), F.max(F.col("n_children") == 0).alias("leaf")
    )
    known = paths.join(owners, "conv_id", "left").select(*paths.columns, "first", "leaf")
    sums = _ranged(known).mapInArrow(_local_sums, _SUMS).groupBy("digest").agg(
        F.sum("leaves").alias("n_leaves"),
        (F.sum("walked") - F.sum("distinct_chars")).alias("saved_tokens"),
    )
    lists = local.where("ends is not null").select("digest", "ends")
    ends = (
        lists.repartition(shuffle_partitions(spark), "digest")
        .withColumn("first", F.element_at("ends", 1))
        .sortWithinPartitions("digest", "first")
        .select("digest", "ends")
        .mapInArrow(_hashed_ends, "digest binary, ends_sha256 string")
    )
    above = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, "digest")
        .join(ends, "digest", "left")
        .join(above, "parent", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
            "n_ends",
        )
    )
