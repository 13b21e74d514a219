"""Packing, the conversation trie and whitening against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.llm import encoding, packing, trie, whitening
from burnish.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


# encoding


@pytest.fixture(scope="module")
def tool():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.VOCABULARY.replace(".tiktoken", ".json"))


@pytest.fixture(scope="module")
def own():
    from pathlib import Path

    return encoding.Encoder(Path(encoding.VOCABULARY).read_bytes(), packing.MARKS)


def test_ids_are_those_of_the_other_library(tool, own, monkeypatch):
    monkeypatch.setattr(encoding, "LONG_RUN", 3)
    monkeypatch.setattr(
        encoding, "_LONG_BLANK", encoding.re.compile(f"[{encoding._BLANK}]{{3,}}+")
    )
    rng = random.Random(4)
    signs = [" ", " ", "\n", "\t", "\x1c", "　", " ", "a", "b1", "é", "'s", ".",
             "<|endoftext|>", "\U0001f600", "ひ"]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(50))
        assert own.ids(text).tolist() == tool.encode(text, add_special_tokens=False).ids
    assert own.ids("").tolist() == []


@pytest.mark.parametrize("text, n", [
    (" " * 2_000_000, 2_000_000), ("\n" * 2_000_000, 1_000_000), ("a" * 2_000_000, 500_000),
    ("　" * 1_200_000 + "x", 2_400_001), ("x" + " " * 1_100_000 + "<|endoftext|>", 1_100_002),
])
def test_very_long_runs(own, text, n):
    assert len(own.ids(text)) == n


# 13: packing


def padding(rows):
    """Tokens of padding, after checking that sequences have no gap and are long enough."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    lost = 0
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
        lost += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert sorted(by) == list(range(len(by)))
    return lost


def check_packed(df, tool):
    given = defaultdict(int)
    for r in df.select("doc_id", "text").collect():
        ids = (*tool.encode(r["text"] or "", add_special_tokens=False).ids, packing.END)
        given[r["doc_id"], np.array(ids, dtype="<u4").tobytes()] += 1
    rows = packing.pack(df).collect()
    assert padding(rows) == 0
    pieces = defaultdict(list)
    for r in rows:
        assert 4 * r["length"] == len(r["ids"])
        pieces[r["doc_id"], r["doc_tokens"], r["start"]].append(bytes(r["ids"]))
    for (doc, data), n in list(given.items()):  # every document can be laid out of its pieces
        for _ in range(n):
            at = 0
            while at < len(data):
                found = pieces[doc, len(data) // 4, at // 4]
                fits = [p for p in found if data[at:at + len(p)] == p]
                assert fits
                found.remove(fits[0])
                at += len(fits[0])
    assert not any(pieces.values())


def test_every_id_lies_in_one_piece(spark, documents, awkward, tool):
    check_packed(documents, tool)
    check_packed(awkward, tool)
    rows = [(i, "word " * 1500) for i in range(40)] + [(None, None), (7, ""), (7, "")]
    check_packed(spark.createDataFrame(rows, "doc_id long, text string"), tool)
    assert packing.pack(documents.where("false")).count() == 0


def test_packing_repeats_itself(documents):
    one, two = (sorted(map(str, packing.pack(documents).collect())) for _ in range(2))
    assert one == two


def test_windows_use_the_histogram_up():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 5) for _ in range(rng.randint(0, 7))}
        room = rng.randint(0, 90)
        chosen = packing.fullest(counts, room)
        sums = {0}
        for length, n in counts.items():
            sums = {x + k * length for x in sums for k in range(n + 1)}
        assert all(n <= counts[x] for x, n in chosen.items())
        assert sum(x * n for x, n in chosen.items()) == max(x for x in sums if x <= room)
        left = dict(counts)
        for f in packing.fillings(counts, 64):
            assert f.total <= 64
            for length, n in f.counts.items():
                left[length] -= f.times * n
        assert not any(left.values())
    assert len(packing.fillings({x: 10**9 for x in range(1, 2049)})) < 10_000


def test_packing_query(spark):
    row = QUERIES["op13_packed_sequences"](spark, FOLDER).where("doc_id = 3").orderBy("start")
    r = row.first()
    ids = packing.pack(spark.read.parquet(f"{FOLDER}/documents.parquet")).where(
        (F.col("doc_id") == 3) & (F.col("start") == 0)).first()["ids"]
    assert r["ids_crc32"] == zlib.crc32(ids)


# 11: trie


def plain_trie(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = (turn is not None, turn or 0, role or "", text or "")
            convs[c].append((key, (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - int(math.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children.get(p)
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m),
                    children.get(p, 0), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def got_trie(df, rebuild=True):
    rows = trie.prefix_trie(df, rebuild).drop("n_ends").collect()
    return sorted(map(tuple, rows), key=str)


CONV = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None, "\U0001f600"]))
            for c in [*range(-120, 260, 7), 0, 100, 200, -100] for t in range(rng.randint(0, 7))]
    rows += [(300, None, "user", "z"), (300, 1, None, None), (300, 1, "user", None),
             (300, 1, "user", "a"), (300, 1, "user", "a"), (None, 0, "user", "lost"),
             (301, 0, "us", "era"), (302, 0, "user", "a"), (303, 9, "user", "x" * 100_000)]
    rows += [(400, t, "user", f"t{t % 3}") for t in range(700)]
    rows += [(c, t, "user", "same") for c in range(500, 900) for t in range(3)]
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_against_a_plain_version(spark, rebuild):
    rows = conversations()
    df = spark.createDataFrame(rows, CONV).repartition(5).withColumn("pos", F.lit("own"))
    assert got_trie(df, rebuild) == plain_trie(rows, rebuild)


def test_conversations_without_turns_are_members_of_the_root(spark):
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(lone, 0, "user", "a"), (lone, 1, "user", "b")]
    assert got_trie(spark.createDataFrame(rows, CONV)) == [
        (lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert trie.prefix_trie(spark.createDataFrame([], CONV)).count() == 0


def test_shards_of_few_conversations():
    shard = trie.Shard()
    for c in range(40):
        shard.start(c, None, None)
        for d in range(c % 4):
            shard.add(b"%d" % (c % 2 if d else 0), 1)
    shard.close()
    nodes = list(shard.nodes())
    assert nodes[0][1].bit_count() == 40 and len({n[4] for n in nodes}) == len(nodes)


# 12: whitening


@pytest.mark.parametrize("width, n, kind", [
    (5, 40, "normal"), (32, 200, "normal"), (8, 60, "whole"), (6, 30, "flat"), (32, 20, "normal"),
    (3, 50, "copies"), (10, 300, "scales"), (4, 1, "normal"), (1, 30, "normal"),
])
def test_spectra_against_a_library(width, n, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, width)) * 100
    if kind == "whole":
        x = np.round(x / 60)
    elif kind == "flat":
        x = np.round(x[:, :2] @ rng.normal(size=(2, width)))
    elif kind == "copies":
        x = np.repeat(x[:5], 10, axis=0)
    elif kind == "scales":
        x *= 10.0 ** np.arange(-5, 5)
    parts = [whitening.Spectrum.empty(width) for _ in range(3)]
    for i, row in enumerate(x):
        parts[i % 3].add(row)
    total = parts[0]
    total.merge(parts[1])
    total.merge(parts[2])
    away = x - x.mean(axis=0)
    scatter = away.T @ away
    size = max(np.abs(scatter).max(), 1e-300)
    assert total.n == n and total.mean == pytest.approx(x.mean(axis=0), abs=1e-9)
    assert np.abs(total.u.T @ total.u - np.eye(width)).max() < 1e-12
    assert np.abs(total.u * total.d @ total.u.T - scatter).max() / size < 1e-13
    assert np.abs(total.d - np.linalg.eigvalsh(scatter)).max() / size < 1e-13


def check_whitened(df, components=4):
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    whole = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows
             if v and all(c is not None and math.isfinite(c) for c in v)]
    got = defaultdict(list)
    for r in whitening.whiten(df, components).collect():
        got[r["vec_id"], r["deviation"]].append(r)
    found = 0
    for size in {len(v) for _, v in whole}:
        mine = [(i, v) for i, v in whole if len(v) == size]
        fit = sorted({v for _, v in mine})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        k = min(components, size)
        for i, v in mine:
            deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
            rs = [r for r in got[i, deviation] if r["n"] == n]
            assert {r["component"] for r in rs} == set(range(1, k + 1))
            for r in rs:
                j = r["component"] - 1
                if values.sum() > 0:
                    assert r["explained"] == pytest.approx(values[j] / values.sum(), abs=1e-12)
                else:
                    assert r["explained"] is None and r["whitened"] is None
                if values[j] > 1e-12 * values[0] and values[0] > 0:
                    x = np.array([(n * a - s) / n for a, s in zip(v, sums)])
                    assert abs(r["whitened"]) == pytest.approx(
                        abs(x @ vectors[:, j]) / math.sqrt(values[j]), abs=1e-8)
                    assert r["identity_error"] < 1e-9
            found += 1
    assert sum(map(len, got.values())) == sum(min(components, len(v)) for _, v in whole)
    return found


VEC = "vec_id long, embedding array<float>"


def test_whitened_vectors(spark):
    check_whitened(spark.read.parquet(f"{FOLDER}/embeddings.parquet"))
    rng = np.random.default_rng(5)
    rows = [(i, [float(a) for a in rng.normal(size=6) * [9, 5, 3, 2, 1, 0]]) for i in range(60)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (70, None), (71, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
             (72, [float("nan")] * 6), (73, [float("inf")] * 6), (74, []), (75, [1e30] * 6),
             (76, [-0.0] * 6)]
    df = spark.createDataFrame(rows, VEC).withColumn("n", F.lit("own"))
    assert check_whitened(df.where("vec_id is null or vec_id <> 75")) == 63
    assert check_whitened(df.where("vec_id <> 75").limit(1)) == 1
    ids = {r["vec_id"] for r in whitening.whiten(df).select("vec_id").collect()}
    assert not ids & {70, 71, 72, 73, 74, 75}
    mixed = spark.createDataFrame([*rows[:20], *((90 + i, [float(i), 1.0]) for i in range(5))], VEC)
    assert check_whitened(mixed) == 25
    assert whitening.whiten(df.where("false")).count() == 0


def test_large_whole_numbers_stay_exact(spark):
    rows = [(i, [float(10**5 * i + 1), 3.0]) for i in range(8)]
    check_whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2)
    huge = spark.createDataFrame([(i, [1e12 * i, 3.0]) for i in range(8)],
                                 "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(huge).collect()} == {None}


def test_whitening_query(spark):
    rows = QUERIES["op12_whitened_vectors"](spark, FOLDER)
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                            "identity_error"]
    assert dict(rows.dtypes)["component"] == "int"
    assert rows.agg(F.max("identity_error")).first()[0] < 1e-9
