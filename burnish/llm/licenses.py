"""License scans: a positional index of rare licence words, key phrases verified.

The licence words are those of the templates below. Their inverse document frequencies come from
counts over all documents. For each file its highest-IDF licence words (and each template's own
rarest word) are looked up in the postings ``word -> (template, position)``; postings that agree
on the relative position propose that the template begins there. A proposal stands if the
template's mandatory phrases are there word for word and enough of its other words are. A text
may begin inside a template, which then counts from the text's first word.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; on UTF-8 bytes
that is letters, digits and all bytes from 0x80. Two map-only passes over the texts; between them
one small table of counts (a row per licence word) reaches the driver.

Defined results: a null text is an empty text; no places give null ``first_word`` and
``last_word``, empty labels and score 0; repeated rows and equal templates give repeated results;
an empty table gives an empty result; other columns are kept, those named like an added one
replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.plans.shipping import ship

#: Licence words of a file that are looked up, besides each template's rarest.
RARE = 12
#: Share of a template's words that must stand at their place.
LEAST_COVER = 0.6

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False


# Phrases of the base labels, and sentences of public licences.
TEMPLATES = (
    Template("gpl", "gnu general public license", ("gnu general public license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("cc-by", "cc by", ("cc by",), True),
    Template("mit", "mit license", ("mit license",), True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files",
        ("permission is hereby granted free of charge", "to any person obtaining a copy"),
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file "
        "except in compliance with the license",
        ("licensed under the apache license", "except in compliance with the license"),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation",
        ("this program is free software", "gnu general public license"),
    ),
    Template(
        "lgpl",
        "under the terms of the gnu lesser general public license as published by the free "
        "software foundation",
        ("gnu lesser general public license",),
    ),
    Template("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license",
        ("terms of the mozilla public license",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software", "into the public domain"),
    ),
    Template(
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("licensed under a creative commons attribution",),
    ),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
)
VOCABULARY = frozenset(w.encode() for t in TEMPLATES for w in t.text.split())


def file_words(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").lower())


class Index:
    """Postings of the templates' words, and what a proposal must show."""

    def __init__(self, idf: dict[bytes, float]):
        self.idf = idf
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.words: list[list[bytes]] = []
        self.phrases: list[list[tuple[int, list[bytes]]]] = []
        self.anchors: set[bytes] = set()
        for at, t in enumerate(TEMPLATES):
            words = t.text.encode().split()
            self.words.append(words)
            for i, w in enumerate(words):
                self.postings[w].append((at, i))
            needed = []
            for p in t.phrases:
                part = p.encode().split()
                begin = next(i for i in range(len(words)) if words[i:i + len(part)] == part)
                needed.append((begin, part))
            self.phrases.append(needed)
            # the rarest word of the first mandatory phrase is always looked up
            self.anchors.add(max(needed[0][1], key=lambda w: (idf[w], w)))

    def scan(self, text: bytes | None) -> tuple:
        """Word count, base places, their ends, both label lists and the score."""
        words = file_words(text)
        present = self.idf.keys() & set(words)
        asked = set(sorted(present, key=lambda w: (-self.idf[w], w))[:RARE])
        asked |= present & self.anchors
        if not asked & self.anchors:
            return len(words), 0, None, None, "", "", 0.0
        proposals = set()
        for i, w in enumerate(words):
            if w in asked:
                proposals.update((at, i - p) for at, p in self.postings[w])
        base, labels, places, score = set(), set(), [], 0.0
        for at, start in proposals:
            if not all(start + b >= 0 and words[start + b:start + b + len(p)] == p
                       for b, p in self.phrases[at]):
                continue
            own = self.words[at][max(0, -start):]  # from the first word that the text has
            there = words[max(0, start):max(0, start) + len(own)]
            cover = sum(x == y for x, y in zip(own, there)) / len(own)
            if cover < LEAST_COVER:
                continue
            labels.add(TEMPLATES[at].label)
            score = max(score, cover)
            if TEMPLATES[at].base:
                base.add(TEMPLATES[at].label)
                places.append(start)
        return (len(words), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score)


def inverse_frequencies(docs: DataFrame, text: str = "text") -> dict[bytes, float]:
    """IDF of every licence word, from counts over all documents."""
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        rows = 0
        for batch in batches:
            for t in batch.column("t"):
                rows += 1
                for w in VOCABULARY.intersection(file_words(t.as_py())):
                    seen[w] += 1
        names = [b"", *seen]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n.decode() for n in names]), pa.array([rows, *seen.values()], pa.int64())],
            ["word", "n"],
        )

    body = docs.select(F.col(f"`{text}`").cast("binary").alias("t"))
    counts = body.mapInArrow(counted, "word string, n long").groupBy("word")
    found = {r["word"].encode(): r["n"] for r in counts.agg(F.sum("n").alias("n")).collect()}
    rows = found.get(b"", 0)
    return {w: log((rows + 1) / (found.get(w, 0) + 1)) for w in sorted(VOCABULARY)}


_ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs, text))
    state: dict[str, Index] = {}
    kind = pa.struct(list(zip(_ADDED, _TYPES)))

    @F.arrow_udf(
        "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,"
        "labels:string,score:double>"
    )
    def scan(texts: pa.Array) -> pa.Array:
        if "index" not in state:
            state["index"] = Index(idf.value)
        find = state["index"].scan
        columns = zip(*[find(t.as_py()) for t in texts])
        arrays = [pa.array(c, k) for c, k in zip(columns, _TYPES)]
        return pa.StructArray.from_arrays(arrays, fields=list(kind)) if arrays else pa.array([], kind)

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in _ADDED]
    found = docs.withColumn("__found", scan(F.col(f"`{text}`").cast("binary")))
    return found.select(*kept, *[F.col(f"__found.{c}").alias(c) for c in _ADDED])
