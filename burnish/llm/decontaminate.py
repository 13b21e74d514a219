"""Benchmark passages in documents: pigeonhole pieces, exact hits, Myers distance.

A test item of ``n`` characters may differ in ``k = floor(n * rate)`` edits. Cut into ``k + 1``
pieces, at least one of them is unchanged in any such copy. One automaton of all pieces runs over
every whole text; around its hits Myers' bit-parallel recurrence gives the smallest distance of
the item to any stretch of the text.

An item may also differ in whole words, whatever their length: in ``WORD_EDITS`` of them, and in
one at most of every ``WORDS_PER_EDIT``. Pieces cut between words and the same recurrence over
words find all these copies. Their distance is reported in characters too, and may be over ``k``.

Both sides are compared as lower-cased words joined by one space. The items are a stated query
set: they are read in blocks of bounded size, each block is sent to the executors once and meets
all documents in one map-only pass. Nothing of the documents is shuffled or collected.

Defined results: null and empty texts match nothing; items without a letter or digit are ignored;
repeated items and repeated documents are all reported; an empty benchmark gives empty lists.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import prepare


#: Edits allowed per character of an item.
RATE = 0.08
#: Whole words that may be dropped, added or replaced, and the words an item needs for each.
WORD_EDITS, WORDS_PER_EDIT = 2, 6
#: Characters of benchmark text that are sent to the executors at a time.
BLOCK_CHARS = 4_000_000

_WORD = re.compile(r"[^\W_]+")
_TYPE = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def plain(text: str | None) -> str:
    """Words in lower case, joined by one space."""
    return " ".join(_WORD.findall(text or "")).lower()


def pieces(item: Sequence[str], edits: int) -> Iterator[tuple[int, int]]:
    """``edits + 1`` stretches of nearly equal length that cover the item."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return zip(cuts[:-1], cuts[1:])


def word_pieces(words: list[str], edits: int) -> Iterator[tuple[str, int]]:
    """``edits + 1`` stretches of whole words that cover the item, with their first words."""
    for a, b in pieces(words, edits):
        yield " ".join(words[a:b]), a


def myers(masks: dict[str, int], m: int, text: Sequence[str], most: int) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a stretch of ``text``, and where it first ends.

    ``text`` is a string or a list of words, the pattern's ``masks`` are of its like.
    ``most + 1`` stands for any larger distance.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, most + 1, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def _masks(item: Sequence[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """The items of one block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.words, hits = [], [], {}
        for item_id, text in items:
            body = plain(text)
            if not body:
                continue
            edits = min(int(len(body) * rate), len(body) - 1)
            at = len(self.items)
            self.items.append((item_id, body, edits, _masks(body), _masks(body[::-1])))
            for a, b in pieces(body, edits):
                hits.setdefault(body[a:b], []).append((at, b, None))
            words = body.split(" ")
            swaps = min(WORD_EDITS, len(words) // WORDS_PER_EDIT) if rate else 0
            self.words.append((words, swaps, _masks(words), _masks(words[::-1])))
            for piece, first in word_pieces(words, swaps) if swaps else ():
                hits.setdefault(piece, []).append((at, len(piece), first))
        self.automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.automaton.add_word(piece, where)
        if hits:
            self.automaton.make_automaton()

    def _best(self, at: int, text: str, windows: list[list[int]]) -> tuple[int, int, int] | None:
        _, body, edits, masks, back = self.items[at]
        best = None
        for lo, hi in windows:
            window = text[lo:hi]
            found = window.find(body)
            if found >= 0:
                return 0, lo + found, lo + found + len(body)
            distance, end = myers(masks, len(body), window, edits)
            if distance <= edits and (best is None or distance < best[0]):
                _, size = myers(back, len(body), window[:end][::-1], distance)
                best = distance, lo + end - size, lo + end
        return best

    def _by_words(self, at: int, text: list[str], starts: list[int], body: str,
                  places: list[int]) -> tuple[int, int, int] | None:
        """The item's place with the fewest word edits, if they are few enough.

        ``places`` are the words of the text where the item may begin.
        """
        words, swaps, masks, back = self.words[at]
        best = None
        for place in sorted(set(places)):
            lo = max(0, place - swaps)
            window = text[lo:max(0, place + len(words) + swaps)]
            edits, end = myers(masks, len(words), window, swaps)
            if edits <= swaps and (best is None or edits < best[0]):
                _, size = myers(back, len(words), window[:end][::-1], edits)
                best = edits, lo + end - size, lo + end - 1
        if best is None:
            return None
        a, b = starts[best[1]], starts[best[2]] + len(text[best[2]])
        item = self.items[at]
        return myers(item[3], len(item[1]), body[a:b], len(item[1]))[0], a, b

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """Item, distance and offsets in ``text`` of the best place of every item found."""
        if not text or not self.items:
            return []
        body = plain(text)
        windows: dict[int, list[list[int]]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        for last, where in self.automaton.iter(body):
            for at, stop, word in where:
                if word is not None:
                    begin = last + 1 - stop
                    if (not begin or body[begin - 1] == " ") and body[last + 1:last + 2] in ("", " "):
                        whole.setdefault(at, []).append((begin, word))
                    continue
                _, item, edits, _, _ = self.items[at]
                lo = max(0, last + 1 - stop - edits)
                hi = last + 1 - stop + len(item) + edits
                own = windows.setdefault(at, [])
                if own and lo <= own[-1][1]:
                    own[-1][0] = min(own[-1][0], lo)
                    own[-1][1] = max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        found, words, starts = [], [], []
        for at in sorted(windows.keys() | whole.keys()):
            best = self._best(at, body, windows.get(at, []))
            if best is None and at in whole:
                if not words:
                    words = body.split(" ")
                    starts = [0, *accumulate(len(w) + 1 for w in words[:-1])]
                places = [bisect_left(starts, begin) - word for begin, word in whole[at]]
                best = self._by_words(at, words, starts, body, places)
            if best:
                found.append((self.items[at][0], *best))
        return _in_original(text, found) if found else []


def _in_original(text: str, found: list[tuple[int, int, int, int]]) -> list:
    """Offsets of the words-only text as offsets of the text itself."""
    starts, ends, at = [], [], 0
    begins, stops = [], []
    for word in _WORD.finditer(text):
        size = len(word.group().lower())
        starts.append(at)
        ends.append(at + size)
        begins.append(word.start())
        stops.append(word.end())
        at += size + 1
    out = []
    for item_id, distance, a, b in found:
        first = max(0, bisect_right(starts, a) - 1)
        last = min(len(ends) - 1, bisect_left(ends, b))
        out.append((item_id, distance, begins[first], stops[last]))
    return out


def _finder(block, rate: float):
    state: dict[str, Matcher] = {}
    kind = pa.list_(
        pa.struct(
            [("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()),
             ("end", pa.int32())]
        )
    )

    @F.arrow_udf(_TYPE)
    def find(texts: pa.Array) -> pa.Array:
        if "matcher" not in state:
            state["matcher"] = Matcher(block.value, rate)
        names = ("item_id", "distance", "start", "end")
        return pa.array(
            [[dict(zip(names, hit)) for hit in state["matcher"].find(t.as_py())] for t in texts],
            type=kind,
        )

    # else a filter on the matches is pushed below them and finds them a second time
    return find.asNondeterministic()


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``BLOCK_CHARS`` characters, one at a time."""
    items = benchmark.select("item_id", "text").where("text is not null and text != ''")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // BLOCK_CHARS)
    for i in range(count):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i)
        yield sorted((tuple(r) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text",
               rate: float = RATE) -> DataFrame:
    """Add ``matches``: for every item found its best place in the text."""
    spark = docs.sparkSession
    prepare(spark)
    found = [
        _finder(spark.sparkContext.broadcast(block), rate)(F.col(f"`{text}`"))
        for block in _blocks(benchmark)
    ]
    none = F.array().cast(_TYPE)
    matches = F.concat(none, *found)
    return docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "matches"], matches.alias("matches")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no item is found."""
    names = docs.columns
    body = docs.select("*", F.col("text").alias("__body"))
    found = find_items(body.drop("matches"), benchmark, "__body", rate)
    if "matches" in names:
        found = find_items(body.withColumnRenamed("matches", "__matches"), benchmark, "__body", rate)
    kept = found.where(F.size("matches") == 0)
    if "matches" in names:
        kept = kept.drop("matches").withColumnRenamed("__matches", "matches")
    return kept.select(*[F.col(f"`{c}`") for c in names])
