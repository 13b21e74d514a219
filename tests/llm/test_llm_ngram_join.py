from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from burnish.llm import ngram_join as J

BLANKS = " \t\n\x0b\x0c\r"


def grams(text):
    words = [w for w in "".join(" " if c in BLANKS else c for c in text or "").lower().split(" ") if w]
    if not words:
        return None, frozenset()
    n = max(1, len(words) - J.WORDS + 1)
    return tuple(words), frozenset(tuple(words[i:i + J.WORDS]) for i in range(n))


def brute(rows):
    """Per row: class (smallest id over links), links to other texts, copies."""
    texts = {}
    for i, t in rows:
        words, own = grams(t)
        if words:
            texts.setdefault(words, (own, []))[1].append(i)
    names = list(texts)
    where = defaultdict(list)
    for k, w in enumerate(names):
        for g in texts[w][0]:
            where[g].append(k)
    shared = Counter()
    for own in where.values():
        for x in range(len(own)):
            for y in range(x + 1, len(own)):
                shared[own[x], own[y]] += 1
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for (x, y), n in shared.items():
        total = len(texts[names[x]][0]) + len(texts[names[y]][0]) - n
        if n >= J.THRESHOLD * total:
            links[x] += 1
            links[y] += 1
            parent[find(x)] = find(y)
    least = {}
    for k, w in enumerate(names):
        ids = [i for i in texts[w][1] if i is not None]
        if ids:
            r = find(k)
            least[r] = min(least.get(r, min(ids)), min(ids))
    number = {w: k for k, w in enumerate(names)}
    out = []
    for i, t in rows:
        words, _ = grams(t)
        if words:
            k = number[words]
            out.append((i, least.get(find(k)), links[k], len(texts[words][1])))
        else:
            out.append((i, i, 0, 1))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in J.near_duplicates(df).collect()), key=str)


def test_same_as_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert found(df) == brute([tuple(r) for r in df.collect()])


def test_near_copies_of_a_hot_text(spark):
    """One text with hundreds of near copies that form a chain of overlapping neighbourhoods."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.choice(60, size=int(rng.integers(0, 3)), replace=False):
            words[at] = f"v{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    for i in range(30):  # each differs from the one before in one word
        words = [f"c{j}" for j in range(60)]
        words[:i] = [f"d{j}" for j in range(i)]
        rows.append((1000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)


def test_awkward_rows(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(awkward) == brute(rows)


def test_empty_table(empty):
    assert found(empty) == []
    assert J.keep_one(empty).count() == 0


def test_one_of_each_class_stays(awkward, documents):
    for df in (documents, awkward):
        kept = J.keep_one(df)
        assert kept.columns == df.columns
        classes = brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        bare = df.where(F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n", "  ")) == "").count()
        worded = [c for i, c, n, k in classes if (n, k) != (0, 1) or i is None or i != c]
        single = [c for i, c, n, k in classes if (n, k) == (0, 1) and i == c and i is not None]
        expected = len(set(worded) - set()) + len(single)
        if df is documents:
            assert kept.count() == expected
            assert {r["doc_id"] for r in kept.collect()} == {c for _, c, _, _ in classes}
        else:
            assert kept.where("text is null or trim(text) = ''").count() >= 3
            assert kept.where("doc_id in (6, 7)").count() == 1
            assert kept.where("doc_id in (1, 2)").count() == 1
            assert bare >= 3


def test_pruning_follows_the_posterior():
    """Simulated pairs at the threshold survive, pairs far below it go early."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, (4000, J._HASHES), dtype=np.uint32)
    for share, low, high in ((0.8, 0.999, 1.0), (0.3, 0.0, 0.01)):
        b = np.where(rng.random(a.shape) < share, a, a + np.uint32(1))
        assert low <= J._survivors(a, b).mean() <= high


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 22), (22, 23), (23, 20)]
    edges += [(i, i + 1) for i in range(100, 160)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in J.components(df).collect()}
    assert got == {
        **{i: 3 for i in (3, 4, 5, 9)}, **{i: 20 for i in (20, 21, 22, 23)},
        **{i: 100 for i in range(100, 161)},
    }


def dealt(spark, sizes):
    """Block pairs of one band whose roots have these many members."""
    rows = [(f"{r}-{i}".encode(), 7, f"{r}".encode()) for r, n in enumerate(sizes) for i in range(n)]
    placed = spark.createDataFrame(rows, "digest binary, band long, root binary")
    return J._block_pairs(J._open_bands(placed), "band", ["digest", "root"]).toPandas()


def test_a_stranger_does_not_deal_a_hot_bucket_anew(spark):
    got = dealt(spark, [5_000, 1])
    assert len(got) < 3 * 5_000
    stranger = got[got["root"].map(bytes) == b"1"]
    met = got.merge(stranger[["i", "j"]], on=["i", "j"])
    assert met["digest"].map(bytes).nunique() == 5_001


def test_all_members_of_different_roots_meet_once(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    sizes = [40, 23, 1, 1, 30]
    pairs = Counter()
    for (i, j), rows in dealt(spark, sizes).groupby(["i", "j"]):
        assert len(rows) <= 80
        own = [(bytes(d), bytes(r), s) for d, r, s in zip(rows["digest"], rows["root"], rows["side"])]
        for x in range(len(own)):
            for y in range(x + 1, len(own)):
                if own[x][1] != own[y][1] and (i == j or own[x][2] != own[y][2]):
                    pairs[frozenset((own[x][0], own[y][0]))] += 1
    total = sum(sizes)
    assert len(pairs) == (total * total - sum(n * n for n in sizes)) // 2
    assert set(pairs.values()) == {1}
    assert dealt(spark, [9]).empty


def test_blocks_of_a_hot_bucket_find_the_links(spark, monkeypatch):
    """Two chains share buckets with a crowd of near copies; small blocks."""
    monkeypatch.setattr(J, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        words = [f"w{k}" for k in range(60)]
        for at in range(int(rng.integers(0, 24))):  # from near copies to strangers
            words[at] = f"v{rng.integers(0, 6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)
