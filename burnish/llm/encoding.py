"""Byte-pair encoding of whole texts, of any length, with a given vocabulary file.

The file (a base64 token and its rank per line) is read by the driver and broadcast; it has a
fixed size. A text is cut by a fixed pattern before merging. A long run of white space is a piece
of its own in that pattern, up to its last character where more text follows, so such runs are cut
out beforehand: the pattern's search would keep a state per character of them.
"""

from __future__ import annotations

import base64
import re
from pathlib import Path

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

from burnish.plans.shipping import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's authors cut a text before merging: a fixed value of the format.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The white space of that pattern: a fixed value of Unicode.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space of at least so many characters are cut out before the pattern is applied.
LONG_RUN = 10_000
_LONG_BLANK = re.compile(f"[{_BLANK}]{{{LONG_RUN},}}+")


class Encoder:
    """Token ids of texts; ``marks`` are strings with ids of their own, ordinary text by default."""

    def __init__(self, vocabulary: bytes, marks: dict[str, int] | None = None):
        import tiktoken

        lines = (x.split() for x in vocabulary.splitlines() if x)
        ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.marks = marks or {}
        self.top = max([*ranks.values(), *self.marks.values()], default=0)
        self._split = re.compile("|".join(map(re.escape, self.marks))) if self.marks else None
        self._own = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, as unsigned 32-bit numbers."""
        parts: list[np.ndarray] = []
        at = 0
        for mark in self._split.finditer(text) if self._split else ():
            self._plain(text[at:mark.start()], parts)
            parts.append(np.array([self.marks[mark[0]]], dtype=np.uint32))
            at = mark.end()
        self._plain(text[at:] if at else text, parts)
        if len(parts) == 1:
            return parts[0]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)

    def _plain(self, text: str, parts: list[np.ndarray]) -> None:
        at = 0
        if len(text) >= LONG_RUN:
            for run in _LONG_BLANK.finditer(text):
                end = run.end() if run.end() == len(text) else run.end() - 1
                self._pieces(text[at:run.start()], parts)
                one = self._own._encode_single_piece(text[run.start():end].encode())
                parts.append(np.array(one, dtype=np.uint32))
                at = end
        self._pieces(text[at:] if at else text, parts)

    def _pieces(self, text: str, parts: list[np.ndarray]) -> None:
        if text:
            found = self._own.encode_to_numpy(text, disallowed_special=())
            parts.append(found.astype(np.uint32, copy=False))


_made: dict[tuple, Encoder] = {}


def shared_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    ship(spark)
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encoder_of(vocabulary: Broadcast, marks: dict[str, int] | None = None) -> Encoder:
    """The encoder in a task's process, built once there."""
    key = (vocabulary.value, tuple(sorted((marks or {}).items())))
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(vocabulary.value, marks)
    return _made[key]
