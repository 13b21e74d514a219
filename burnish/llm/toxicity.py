"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

1. Labelled documents tell how much more often toxic documents hold a word or a word beginning
   (counts in Spark; the strongest features, at most ``FEATURES``, are the lexicon). How strong a
   feature must be follows from the data: under labels drawn at random, at most ``CHANCE`` times
   as many features may reach the limit, so few labels still give a lexicon and many a clean one.
2. Tokens of toxic documents that carry a lexicon feature are labelled toxic, all others not. On
   these labelled tokens a two-state chain is fitted: its node weights look at the token and both
   neighbours, its edge weights at the state before.
3. Forward-backward gives every token of every whole text its marginal. A logistic curve over the
   expected number, share and largest marginal of toxic tokens is the document's score. Tokens
   above one half are spans.

Chain and curve see each labelled document through a lexicon counted without its own fold, the
scores use the lexicon of all folds. The model is fitted on at most ``ROWS`` labelled documents (the smallest hashes of ``doc_id``), of
which ``CHAIN_ROWS`` train the chain; scoring is one map-only pass with the model broadcast (a
lexicon of bounded size). Inputs of a score are the text's words, nothing else.

Defined results: null and empty texts have no tokens and get the curve's value for none; labels
other than 0 and 1 are ignored; a ``doc_id`` labelled twice counts as toxic if one label says so;
without labelled rows of both kinds every score is the smoothed share of toxic labels; repeated
rows get equal scores; other columns are kept, columns named like an added one replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import hash_key, prepare, slices, written

#: Labelled documents the model is fitted on at most, and those that train the chain.
ROWS, CHAIN_ROWS = 8000, 1200
#: Features in the lexicon at most, and the likelihood ratio a feature must reach at least.
FEATURES, LEAST_RATIO = 3000, 6.0
#: Folds of the labelled documents, random labellings, and the share of features due to chance.
FOLDS, SHAMS, CHANCE = 5, 4, 0.3
#: Documents of the usual mix that a feature's odds start from, so rare features count little.
_USUAL = 2.0
#: Steps per unit in which the limit of the ratio is sought.
_STEPS = 2
#: Lengths of word beginnings that are features.
STEMS = (4, 5, 6, 7)
#: Slopes of the document score (toxic tokens, largest marginal, share) that few labels start from.
SLOPES = (1.0, 1.0, 0.3)
#: Limits between the bins of a token's log-odds.
BINS = (1.0, 2.0, 3.0, 4.0, 5.0)

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'()[]{}|*"


def features(word: str) -> list[str]:
    word = word.strip(_EDGES)
    return [f"={word}"] + [word[:n] for n in STEMS if len(word) >= n] if word else []


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    node: np.ndarray = field(default_factory=lambda: np.zeros((3, len(BINS) + 2)))
    edge: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def bins(self, words: list[str]) -> np.ndarray:
        """0 for words without a lexicon feature, else 1 + the bin of the strongest."""
        get = self.lexicon.get
        odds = [max((get(f, 0.0) for f in features(w)), default=0.0) for w in words]
        odds = np.asarray(odds, dtype=float)
        return np.where(odds > 0, 1 + np.searchsorted(BINS, odds), 0).astype(np.int8)


def tokens(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the tokens of all texts in a row, and where each text's begin."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    codes = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    words = codes.dictionary.to_pylist()
    index = codes.indices.to_numpy()
    real = np.array([w != "" for w in words], dtype=bool)[index] if words else np.zeros(0, bool)
    bins = model.bins(words)[index] if words else np.zeros(0, np.int8)
    before = np.concatenate([[0], np.cumsum(real)])
    return bins[real], before[offsets - offsets[0]]


def _potentials(bins: np.ndarray, offsets: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Log-odds of the toxic state at each token, from its bin and its neighbours' bins."""
    border = node.shape[1] - 1  # beyond the text
    before = np.concatenate([[border], bins[:-1]]).astype(np.int64) if len(bins) else bins
    after = np.concatenate([bins[1:], [border]]).astype(np.int64) if len(bins) else bins
    some = np.diff(offsets) > 0
    if len(bins):
        before[offsets[:-1][some]] = border
        after[offsets[1:][some] - 1] = border
    return node[0][bins] + node[1][before] + node[2][after]


def marginals(odds: np.ndarray, offsets: np.ndarray, edge: np.ndarray) -> tuple:
    """Probability of the toxic state at each token, and the two message ratios.

    Messages are kept as ratios of the two states, so nothing under- or overflows. Texts advance
    side by side, the longest first; a step touches those that are long enough.
    """
    u = np.exp(np.clip(odds, -30, 30))
    a = np.exp(edge)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    starts, ends = offsets[:-1][order], offsets[1:][order]
    longest = int(sizes.max()) if len(sizes) else 0
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    forward, backward = np.empty(len(u)), np.empty(len(u))
    f = u[starts[: active[0]]] if longest else u
    if longest:
        forward[starts[: active[0]]] = f
        backward[ends[: active[0]] - 1] = 1.0
        b = np.ones(active[0])
    for t in range(1, longest):
        n = active[t]
        at = starts[:n] + t
        f = f[:n]
        f = u[at] * (a[0, 1] + a[1, 1] * f) / (a[0, 0] + a[1, 0] * f)
        forward[at] = f
        at = ends[:n] - 1 - t
        next_ = u[at + 1] * b[:n]
        b = (a[1, 0] + a[1, 1] * next_) / (a[0, 0] + a[0, 1] * next_)
        backward[at] = b
    product = forward * backward
    return product / (1 + product), forward, backward, u


def fit_chain(bins: np.ndarray, offsets: np.ndarray, labels: np.ndarray, bin_count: int,
              rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Weights that make the token labels likely, by steps of Adam.

    A small ridge holds them near weights that rise with the bin, for bins that few tokens have.
    """
    node = np.zeros((3, bin_count + 1))
    node[0, :bin_count] = np.arange(bin_count) - 1.0
    node[0, 0] = -3.0
    edge = np.zeros((2, 2))
    start = np.concatenate([node.ravel(), edge.ravel()])
    if not len(bins):
        return node, edge
    border = bin_count
    before = np.concatenate([[border], bins[:-1]]).astype(np.int64)
    after = np.concatenate([bins[1:], [border]]).astype(np.int64)
    some = np.diff(offsets) > 0
    first = offsets[:-1][some]
    before[first] = border
    after[offsets[1:][some] - 1] = border
    inner = np.ones(len(bins), bool)
    inner[first] = False
    later = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[later - 1], labels[later]), 1)
    moment = [np.zeros(node.size + 4), np.zeros(node.size + 4)]
    for r in range(1, rounds + 1):
        odds = node[0][bins] + node[1][before] + node[2][after]
        p, f, b, u = marginals(odds, offsets, edge)
        gap = labels - p
        grad_node = np.stack([np.bincount(x, weights=gap, minlength=border + 1)
                              for x in (bins.astype(np.int64), before, after)])
        a = np.exp(edge)
        fl, ur = f[later - 1], u[later] * b[later]
        joint = np.stack([a[0, 0] * np.ones(len(later)), a[0, 1] * ur, a[1, 0] * fl,
                          a[1, 1] * fl * ur])
        joint = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        grad = np.concatenate([grad_node.ravel(), (seen - joint).ravel()])
        weights = np.concatenate([node.ravel(), edge.ravel()])
        grad = grad / max(1, labels.sum()) - 1e-3 * (weights - start)
        grad[-4] = 0  # the edge from clean to clean is the origin
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.99 * moment[1] + 0.01 * grad**2
        step = moment[0] / (1 - 0.9**r) / (np.sqrt(moment[1] / (1 - 0.99**r)) + 1e-8)
        weights = weights + 0.15 * step
        node, edge = weights[:-4].reshape(node.shape), weights[-4:].reshape(2, 2)
    return node, edge


def summary(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: 1, and its expected toxic tokens, largest marginal and toxic share."""
    sizes = np.diff(offsets)
    some = sizes > 0
    total, most = np.zeros(len(sizes)), np.zeros(len(sizes))
    if some.any():
        total[some] = np.add.reduceat(p, offsets[:-1][some])
        most[some] = np.maximum.reduceat(p, offsets[:-1][some])
    share = np.log((total + 0.01) / (sizes + 10))
    return np.stack([np.ones(len(sizes)), np.log1p(total), most, share], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps; a ridge holds the slopes near ``SLOPES``.

    More toxic tokens never make a text less toxic: slopes that come out negative are 0.
    """
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if y.min() == y.max():
        return w
    base, used = w[0], np.arange(x.shape[1])
    while True:
        z, usual = x[:, used], np.array([0.0, *SLOPES])[used]
        v = usual.copy()
        v[0] = base - z[:, 1:].mean(axis=0) @ v[1:]
        ridge = np.diag(np.where(used > 0, 0.5, 1e-3))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
            hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge
            v = v + np.linalg.solve(hessian, z.T @ (y - p) - ridge @ (v - usual))
        if v[1:].min(initial=0.0) >= 0:
            break
        used = np.delete(used, 1 + np.argmin(v[1:]))
    w[:] = 0.0
    w[used] = v
    return w


def held_out(doc_id):
    """Rows that no label is learned from; a null id is none of them, and has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    prepare(spark)
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
        .withColumn("key", hash_key(F.lit("toxic"), F.col("doc_id")))
        .orderBy("key", "doc_id").limit(ROWS)
    )
    known = written(known, "labelled")
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # of rows that share a labelled id one text is learned from, whatever their number
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    train = train.groupBy("doc_id", "toxic", "key").agg(one.alias("text"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    shams = [(F.pmod(hash_key(F.lit(f"sham {j}"), F.col("doc_id")), F.lit(1_000_000))
              < int(share * 1_000_000)).cast("int") for j in range(SHAMS)]
    fold = F.pmod(hash_key(F.lit("fold"), F.col("doc_id")), F.lit(FOLDS)).cast("int")
    train = written(train.withColumn("fold", fold).withColumn("shams", F.array(*shams)),
                    "labelled-texts")
    model, *blind = [Model(lexicon=x) for x in _lexicons(train)]
    rows = train.orderBy("key", "doc_id").limit(CHAIN_ROWS)
    bins, offsets, toxic = _binned(rows, blind)
    labels_of = np.repeat(toxic, np.diff(offsets)) * (bins > 0)
    model.node, model.edge = fit_chain(bins, offsets, labels_of.astype(np.int64), len(BINS) + 2)
    for m in blind:
        m.node, m.edge = model.node, model.edge
    model.curve = _fitted_curve(train, blind)
    return model


def _lexicons(train: DataFrame) -> list[dict[str, float]]:
    """Log-odds of the features that stand out in toxic documents: of all folds, then without each."""
    # counted in each batch: clean and toxic rows of each fold, then the toxic ones of each sham
    places = 2 * FOLDS + SHAMS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            counts = [Counter() for _ in range(places)]
            for text, y, fold, shams in zip(*(batch.column(c).to_pylist() for c in
                                              ("text", "toxic", "fold", "shams"))):
                own = {f for w in set(_TOKEN.findall((text or "").lower())) for f in features(w)}
                counts[2 * fold + y].update(own)
                for j, sham in enumerate(shams):
                    if sham:
                        counts[2 * FOLDS + j].update(own)
            names = list(set().union(*counts[: 2 * FOLDS]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()),
                 *[pa.array([c[f] for f in names], pa.int64()) for c in counts]],
                ["feature", *[f"n{i}" for i in range(places)]],
            )

    kinds = ", ".join(f"n{i} long" for i in range(places))
    counts = train.select("text", "toxic", "fold", "shams").mapInArrow(
        counted, f"feature string, {kinds}"
    ).groupBy("feature").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(places)])
    seen = [F.col(f"n{i}") for i in range(places)]
    toxic = sum(seen[1 : 2 * FOLDS : 2], F.lit(0))
    clean = sum(seen[0 : 2 * FOLDS : 2], F.lit(0))
    some = F.greatest(toxic, *seen[2 * FOLDS :]) > 1
    counts = written(counts.where(some), "feature-counts")

    rows = train.groupBy("fold").agg(
        F.count_if(F.col("toxic") == 0).alias("clean"),
        F.count_if(F.col("toxic") == 1).alias("toxic"),
        *[F.sum(F.col("shams")[j]).alias(f"sham{j}") for j in range(SHAMS)],
    ).collect()
    n1, n0 = sum(r["toxic"] for r in rows), sum(r["clean"] for r in rows)
    of_fold = {r["fold"]: (r["toxic"], r["clean"]) for r in rows}
    real = _ratio(toxic, clean, n1, n0)
    shams = []
    for j in range(SHAMS):
        m1 = sum(r[f"sham{j}"] for r in rows)
        a = seen[2 * FOLDS + j]
        shams.append(_ratio(a, toxic + clean - a, m1, n1 + n0 - m1))
    reach = counts.select(F.posexplode(F.array(real, *shams)).alias("kind", "ratio"))
    steps = (
        reach.where(F.col("ratio") >= LEAST_RATIO)
        .groupBy((F.col("kind") > 0).alias("sham"), F.floor(F.col("ratio") * _STEPS).alias("step"))
        .agg(F.count(F.lit(1)).alias("n")).collect()
    )
    least = _least_ratio({r["step"]: r["n"] for r in steps if not r["sham"]},
                         {r["step"]: r["n"] / SHAMS for r in steps if r["sham"]})

    sides = [(toxic, clean, n1, n0)]
    for i in range(FOLDS):
        own1, own0 = of_fold.get(i, (0, 0))
        sides.append((toxic - seen[2 * i + 1], clean - seen[2 * i], n1 - own1, n0 - own0))
    each = F.array(*[
        F.struct(_odds(*side).alias("odds"), _ratio(*side).alias("ratio"), (side[0] > 1).alias("some"))
        for side in sides
    ])
    order = Window.partitionBy("of").orderBy(F.desc("ratio"), "feature")
    best = (
        counts.select("feature", F.posexplode(each).alias("of", "x")).select("feature", "of", "x.*")
        .where(F.col("some") & (F.col("ratio") >= least))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FEATURES)
        .select("of", "feature", "odds").collect()
    )
    out: list[dict[str, float]] = [{} for _ in sides]
    for r in best:
        out[r["of"]][r["feature"]] = r["odds"]
    return out


def _least_ratio(real: dict[int, float], sham: dict[int, float]) -> float:
    """The lowest limit that few features reach by chance; the floor where none does."""
    found, least = [0.0, 0.0], None
    for step in sorted(real.keys() | sham.keys(), reverse=True):
        found[0] += real.get(step, 0)
        found[1] += sham.get(step, 0)
        if found[0] and found[1] <= CHANCE * found[0]:
            least = step
    return LEAST_RATIO if least is None else max(LEAST_RATIO, least / _STEPS)


def _odds(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Log-odds of a toxic document that holds the feature, above those of any document."""
    share = (n1 + 0.5) / (n1 + n0 + 1)
    return F.log((a + _USUAL * share) / (b + _USUAL * (1 - share))) - F.lit(np.log(share / (1 - share)))


def _ratio(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Likelihood ratio of a feature that is likelier in toxic documents, else 0."""
    n1, n0 = float(max(n1, 1)), float(max(n0, 1))

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    rate = (a + b) / (n1 + n0)
    ratio = 2 * (term(a, rate * n1) + term(b, rate * n0)
                 + term(n1 - a, (1 - rate) * n1) + term(n0 - b, (1 - rate) * n0))
    return F.when(_odds(a, b, n1, n0) > 0, ratio).otherwise(0.0)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch.column("text"), by_length=True):
            yield batch.take(pa.array(rows))


def _by_fold(batches: Iterator[pa.RecordBatch], models: list[Model]) -> Iterator[tuple]:
    """Parts of one fold each with the model that has not counted them."""
    for batch in batches:
        folds = batch.column("fold").to_numpy()
        for i in np.unique(folds):
            own = batch.take(pa.array(np.flatnonzero(folds == i)))
            for part in _parts([own]):
                yield part, models[i]


def _binned(rows: DataFrame, models: list[Model]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the chain's training tokens; one byte a token comes to the driver."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, model in _by_fold(batches, models):
            bins, offsets = tokens(part.column("text"), model)
            data = [bins[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("toxic"), pa.array(data, pa.binary())],
                ["key", "toxic", "bins"],
            )

    found = rows.select("text", "key", "toxic", "fold").mapInArrow(
        encoded, "key long, toxic int, bins binary"
    ).collect()
    found.sort(key=lambda r: (r["key"], bytes(r["bins"])))
    parts = [np.frombuffer(bytes(r["bins"]), dtype=np.int8) for r in found]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int8)
    return flat, offsets, np.array([r["toxic"] for r in found], dtype=np.int64)


def _fitted_curve(rows: DataFrame, models: list[Model]) -> np.ndarray:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, model in _by_fold(batches, models):
            bins, offsets = tokens(part.column("text"), model)
            p = marginals(_potentials(bins, offsets, model.node), offsets, model.edge)[0]
            x = summary(p, offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("toxic"), *[pa.array(c) for c in x.T[1:]]],
                ["key", "toxic", "x1", "x2", "x3"],
            )

    found = rows.select("text", "key", "toxic", "fold").mapInArrow(
        summed, "key long, toxic int, x1 double, x2 double, x3 double"
    ).collect()
    found = sorted(map(tuple, found))
    x = np.array([[1.0, *r[2:]] for r in found]).reshape(len(found), 4)
    return fit_curve(x, np.array([r[1] for r in found], dtype=float))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` and ``toxic_spans`` (code points, end exclusive) to the documents."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    @F.arrow_udf("struct<score:double,spans:array<struct<start:int,end:int>>>")
    def scored(texts: pa.Array) -> pa.Array:
        out: list[dict | None] = [None] * len(texts)
        m = shared.value
        for rows in slices(texts, by_length=True):
            part = texts.take(pa.array(rows))
            bins, offsets = tokens(part, m)
            p = marginals(_potentials(bins, offsets, m.node), offsets, m.edge)[0]
            z = np.clip(summary(p, offsets) @ m.curve, -30, 30)
            scores = 1 / (1 + np.exp(-z))
            high = np.add.reduceat(np.append(p >= 0.5, False), offsets[:-1])
            for i, s in enumerate(scores):
                spans = []
                if offsets[i + 1] > offsets[i] and high[i]:
                    spans = _spans(part[i].as_py(), p[offsets[i]:offsets[i + 1]] >= 0.5)
                out[rows[i]] = {"score": float(s), "spans": spans}
        return pa.array(out, type=kind)

    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "toxic_spans")]
    found = docs.withColumn("__scored", scored(F.col(f"`{text}`")))
    return found.select(*names, F.col("__scored.score").alias("score"),
                        F.col("__scored.spans").alias("toxic_spans"))


def _spans(text: str, toxic: np.ndarray) -> list[dict[str, int]]:
    """Runs of toxic tokens as offsets."""
    out: list[dict[str, int]] = []
    last = -2
    for i, m in enumerate(_TOKEN.finditer(text)):
        if toxic[i]:
            if last == i - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = i
    return out


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score below ``least``."""
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                      F.col("text"))
    kept = score(own, fit(docs, labels)).where(F.col("score") < least)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
