"""Packing documents into training sequences by minimum bin slack.

A document is its token ids and an end mark. It is cut into pieces: as many whole sequences as it
has, and the rest. Only the histogram of piece lengths, at most ``capacity`` rows, reaches the
driver. There, window after window takes the longest length left and the multiset of remaining
lengths that comes closest to filling the window: a bitset holds the sums that can be reached (one
shift per length and power of two of its count) and the counts are found by going back through the
bitsets. A window's multiset is used as often as the counts allow, so that each one uses up a
length and the number of different windows follows the number of lengths, never the data.

Every length then gives its pieces to windows by rank: a piece's rank is its number among the
pieces of its length in its task (given when it is encoded) and the count of the tasks before. No
piece is sorted and no group is gathered.

Pieces of windows that could not be filled are laid end to end and cut anew at multiples of
``capacity``; what is left over after that is cut at powers of two, largest first. So every
sequence is full or as long as a power of two, and nothing is padded.

Ids are those of a byte-pair vocabulary (``encoding``); a mark of the vocabulary in a text is its
own id, as the vocabulary's authors encode it.

Defined results: null and empty texts are the end mark alone; repeated rows are packed each;
``key`` may be null and repeat; other columns are ignored; an empty table gives no rows. A rerun
over the same partitions gives the same rows; other partitions may give other windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.llm.common import prepare, written
from burnish.llm.encoding import VOCABULARY, Encoder, encoder_of, shared_vocabulary

CAPACITY = 2048
#: Closes every document.
END = 1
#: The vocabulary's strings with ids of their own: fixed values of the vocabulary.
MARKS = {"<|endoftext|>": 50256}
#: Bytes of ids that a task hands on at a time.
OUT_BYTES = 1 << 20


# The plan: which lengths share a window


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (each at most its count) whose sum is at most ``room`` and closest.

    Bit ``s`` of the bitset says that some multiset of the lengths so far sums to ``s``.
    """
    if counts.get(room):
        return {room: 1}
    mask = (1 << room + 1) - 1
    reached, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reached))
            reached |= reached << length * k & mask
            left, k = left - k, 2 * k
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + k
            total -= length * k
    return chosen


@dataclass(frozen=True)
class Filling:
    """``times`` windows that hold ``counts[length]`` pieces of each length."""

    times: int
    counts: dict[int, int]

    @property
    def total(self) -> int:
        return sum(length * n for length, n in self.counts.items())


def fillings(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Windows that use up the histogram, the longest remaining length first."""
    left = {length: n for length, n in histogram.items() if n}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        counts = fullest({k: n for k, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        counts[longest] = counts.get(longest, 0) + 1
        times = min(left[length] // n for length, n in counts.items())
        out.append(Filling(times, counts))
        for length, n in counts.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
    return out


@dataclass
class Allotment:
    """Where the pieces of each length go, by rank: a row per length and filling.

    Full windows are sequences at once; windows with slack have a place in the stream of pieces
    that is cut anew.
    """

    capacity: int
    starts: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    base: np.ndarray = field(default_factory=lambda: np.empty((0, 6), dtype=np.int64))
    cuts: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    sequences: int = 0
    stream: int = 0

    @staticmethod
    def of(histogram: dict[int, int], capacity: int = CAPACITY) -> Allotment:
        rows = []
        rank = dict.fromkeys(histogram, 0)
        sequences = stream = 0
        for f in fillings(histogram, capacity):
            full, offset = f.total == capacity, 0
            for length in sorted(f.counts, reverse=True):
                n = f.counts[length]
                rows.append((length, rank[length], n, offset, f.total, full,
                             sequences if full else stream))
                rank[length] += f.times * n
                offset += length * n
            if full:
                sequences += f.times
            else:
                stream += f.times * f.total
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(len(rows), 7)
        rest, tail = stream % capacity, []
        for power in range(capacity.bit_length(), -1, -1):
            if rest >> power & 1:
                tail.append((tail[-1] if tail else stream - stream % capacity) + (1 << power))
        return Allotment(capacity, _place(table[:, 0], table[:, 1]), table[:, 1:],
                         np.array(tail, dtype=np.int64), sequences, stream)

    def windows(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per piece: whether its window is full, the window's sequence, the offset or place."""
        row = self.base[np.searchsorted(self.starts, _place(length, rank), side="right") - 1]
        first, n, offset, total, full, start = row.T
        window, slot = np.divmod(rank - first, n)
        inside = offset + slot * length
        sequence = np.where(full == 1, start + window, -1)
        return full == 1, sequence, np.where(full == 1, inside, start + window * total + inside)

    def sections(self, place: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """``(from, to, sequence, offset)`` of a piece in the stream, cut where sequences end."""
        whole, at = self.stream // self.capacity, place
        while at < place + length:
            n = at // self.capacity
            if n < whole:
                begin, end, sequence = n * self.capacity, (n + 1) * self.capacity, n
            else:
                i = int(np.searchsorted(self.cuts, at, side="right"))
                begin = int(self.cuts[i - 1]) if i else whole * self.capacity
                end, sequence = int(self.cuts[i]), whole + i
            end = min(end, place + length)
            yield at - place, end - place, self.sequences + sequence, at - begin
            at = end


def _place(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length.astype(np.int64) << 44) + rank


# The tasks: encode and cut, then place


def _width(top: int) -> np.dtype:
    return np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")


def _binaries(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow array of the bytes of each part."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([p.nbytes for p in parts], out=offsets[1:])
    data = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint8)
    return pa.Array.from_buffers(
        pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


def _numbered(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each piece's number among those of its length; ``seen`` counts on."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    within = np.arange(len(ordered)) - np.searchsorted(ordered, ordered, side="left")
    out = np.empty(len(lengths), dtype=np.int64)
    out[order] = seen[ordered] + within
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def encoded_pieces(df: DataFrame, key: str, text: str, capacity: int, path: str) -> DataFrame:
    """``key, task, nth, start, length, doc_tokens, ids`` of every piece, ids in 2 or 4 bytes."""
    vocabulary = shared_vocabulary(df.sparkSession, path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder_of(vocabulary, MARKS)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        task = pyspark.TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < len(texts):
                begin, size, docs = at, 0, []
                while at < len(texts) and size < OUT_BYTES:
                    docs.append(_document(own, texts[at].as_py()))
                    size += docs[-1].nbytes
                    at += 1
                yield _pieces_of(batch.column(0), begin, docs, capacity, task, seen)

    fields = [
        T.StructField("key", df.schema[key].dataType),
        *T.StructType.fromDDL(
            "task int, nth long, start long, length int, doc_tokens long, ids binary"
        ),
    ]
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(cut, T.StructType(fields))


def _document(own: Encoder, text: str | None) -> np.ndarray:
    ids = own.ids(text or "")
    out = np.empty(len(ids) + 1, dtype=_width(max(own.top, END)))
    out[:-1], out[-1] = ids, END
    return out


def _pieces_of(keys: pa.Array, begin: int, docs: list[np.ndarray], capacity: int, task: int,
               seen: np.ndarray) -> pa.RecordBatch:
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    pieces = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(docs)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
    length = np.minimum(capacity, sizes[doc] - start)
    ids = [docs[d][s:s + n] for d, s, n in zip(doc, start, length)]
    return pa.RecordBatch.from_arrays(
        [
            keys.take(pa.array(begin + doc)),
            pa.array(np.full(len(doc), task, dtype=np.int32)),
            pa.array(_numbered(length, seen)),
            pa.array(start),
            pa.array(length.astype(np.int32)),
            pa.array(sizes[doc]),
            _binaries(ids),
        ],
        ["key", "task", "nth", "start", "length", "doc_tokens", "ids"],
    )


def _placed(shared, width: np.dtype):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allotment: Allotment = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("before").to_numpy() + batch.column("nth").to_numpy()
            full, sequence, offset = allotment.windows(length, rank)
            ids = [np.frombuffer(b.as_buffer(), dtype=width) for b in batch.column("ids")]
            row, low, high = np.arange(len(length)), np.zeros(len(length), dtype=np.int64), length
            if not full.all():
                loose = np.flatnonzero(~full)
                cut = np.array(
                    [(i, *s) for i in loose
                     for s in allotment.sections(int(offset[i]), int(length[i]))],
                    dtype=np.int64,
                )
                kept = np.flatnonzero(full)
                row = np.concatenate([kept, cut[:, 0]])
                low = np.concatenate([low[kept], cut[:, 1]])
                high = np.concatenate([high[kept], cut[:, 2]])
                sequence = np.concatenate([sequence[kept], cut[:, 3]])
                offset = np.concatenate([offset[kept], cut[:, 4]])
            start = batch.column("start").to_numpy()[row] + low
            tokens = batch.column("doc_tokens").to_numpy()[row]
            size = np.cumsum(4 * (high - low)) // OUT_BYTES
            for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(size)) + 1):
                if len(part):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("key").take(pa.array(row[part])),
                            pa.array(start[part]),
                            pa.array((high - low)[part]),
                            _binaries([ids[row[i]][low[i]:high[i]].astype("<u4") for i in part]),
                            pa.array(tokens[part]),
                            pa.array(sequence[part]),
                            pa.array(offset[part]),
                        ],
                        ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                    )

    return place


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         path: str = VOCABULARY) -> DataFrame:
    """A row per piece: ``key, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers; sequences are numbered
    from 0; ``offset`` is where the piece begins in its sequence.
    """
    spark = df.sparkSession
    prepare(spark)
    pieces = written(encoded_pieces(df, key, text, capacity, path), "pieces")
    counts = written(
        pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts"
    )
    histogram = {
        r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    }
    allotment = Allotment.of(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    ranked = pieces.join(counts.select("task", "length", before), ["task", "length"])
    width = _width(max(Encoder(shared_vocabulary(spark, path).value, MARKS).top, END))
    fields = [
        T.StructField("key", df.schema[key].dataType),
        *T.StructType.fromDDL(
            "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
        ),
    ]
    out = ranked.mapInArrow(_placed(spark.sparkContext.broadcast(allotment), width),
                            T.StructType(fields))
    return out.withColumnRenamed("key", key)
