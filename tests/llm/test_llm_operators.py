"""Each operator against a plain version of its contract, and on awkward and empty tables."""

import hashlib
import html
import re
import time

import numpy as np
import pytest
from compare import difference
from pyspark.sql import functions as F

from burnish.llm import (
    decontaminate,
    licenses,
    mixing,
    pii,
    token_counts,
    topk,
    toxicity,
    warc,
    wrappers,
)
from burnish.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), FOLDER, ORACLES[name]) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# 1: mixing


def test_mix_meets_its_targets(awkward):
    docs = mixing.mix(awkward)
    assert set(awkward.columns) <= set(docs.columns)
    rows = docs.collect()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
    by = {}
    for r in rows:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    for target, taken in by.values():
        assert target - 4 <= taken <= target
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(awkward).collect()))


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0


# 2: licences


def plain_licenses(text):
    words = re.findall(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    )
    places = [
        (i, t.label)
        for t in licenses.TEMPLATES if t.base
        for i in range(len(words))
        if words[i:i + len(t.text.split())] == t.text.split()
    ]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def test_licenses(spark, documents, awkward):
    notice = ("Permission is hereby granted, free of charge, to any person obtaining a copy of "
              "THIS software and associated documentation. ")
    more = spark.createDataFrame(
        [(100, notice * 3), (101, "MIT mit license cc BY-NC; GNU General  Public\nLicense mit"),
         (102, "Kelvin K ccé by cc by"), (103, "mit " * 500 + "license")],
        "doc_id long, text string",
    )
    for df in (documents, awkward, more):
        for r in licenses.scan_licenses(df).collect():
            got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
            assert got == plain_licenses(r["text"])
            assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
            assert 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(more).collect()}
    assert labels[100] == "mit" and labels[101] == "cc-by,cc-by-nc,gpl,mit"
    assert licenses.scan_licenses(documents.where("false")).count() == 0


def test_texts_that_begin_inside_a_template(spark):
    rows = [(1, "CC BY-NC 4.0 holds for this text"), (2, "CC BY-SA"), (3, "by nc and more"),
            (4, "free software: GNU General Public License as published by the Free Software"),
            (5, "General Public License as published by the Free Software Foundation")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()}
    assert labels == {1: "cc-by,cc-by-nc", 2: "cc-by,cc-by-sa", 3: "", 4: "gpl", 5: ""}


# 3: main text


def test_article_of_every_page(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    for r in wrappers.extract_main(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        inner = re.sub(r"</?(?:h1|p|br)\b[^>]*>", " ", inner)
        expected = " ".join(html.unescape(re.sub(r"<!--.*?-->|<[^>]+>", "", inner)).split())
        assert r["text"] == expected and r["n_chars"] == len(expected)


def test_template_is_learned_without_names(spark):
    """No element says what it is: only alignment tells the fixed lines from the varying ones."""
    page = ("<body><div>Our shop since 1900</div><div><h2>Title {0}</h2><p>Body &amp; soul {0}"
            "<p>More of {0}</div><div>Call us any time</div></body>")
    rows = [(i, "https://H.example/x", page.format(f"w{i} w{i * 7}")) for i in range(12)]
    rows += [(90, None, None), (91, "no host", ""), (92, "https://h.example/y", "<p>a<b>b</b> c"),
             (93, "https://h.example/z", "<div>" * 3000 + "deep" + "</div>" * 3000),
             (94, "https://h.example/z", "<p title='" + "x" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.withColumn("text", F.lit("own")).withColumn("template", F.lit("own"))
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main(df).collect()}
    for i in range(12):
        w = f"w{i} w{i * 7}"
        assert got[i] == f"Title {w} Body & soul {w} More of {w}"
    assert got[90] == got[91] == "" and got[92] == "ab c" and got[93] == "deep"
    assert wrappers.extract_main(df.where("false")).count() == 0


def aligned(page, other):
    tool, trees = wrappers.Aligner(), [wrappers.parse(page), wrappers.parse(other)]
    for t in trees:
        wrappers.measure(t, tool.keys)
    return tool.weight(*trees), [(a.text, b.text) for a, b in tool.pairs(*trees)]


def test_alignment_of_long_lists_is_the_one_of_short_ones(monkeypatch):
    rng = np.random.default_rng(4)

    def page(depth=0):
        out = ""
        for _ in range(rng.integers(1, 5 if depth else 30)):
            tag = ["p", "div", "b"][rng.integers(3)]
            deeper = depth < 2 and rng.random() < 0.5
            out += f"<{tag}>{page(depth + 1) if deeper else f'w{rng.integers(4)}'}</{tag}>"
        return out

    for _ in range(60):
        pair = [f"<body>{page()}</body>" for _ in range(2)]
        monkeypatch.setattr(wrappers, "SMALL_TABLE", 1 << 30)
        plain = aligned(*pair)
        monkeypatch.setattr(wrappers, "SMALL_TABLE", 0)
        assert aligned(*pair) == plain


def test_pages_of_many_paragraphs_align_fast():
    n = 20_000
    with_rules = "".join(f"<p>a{i}</p>" + "<hr>" * (i % 40 == 0) for i in range(n))
    plain = "".join(f"<p>b{i}</p>" for i in range(n))
    began = time.perf_counter()
    for page in (plain, plain + "<ul><li>x</ul>"):
        _, pairs = aligned(f"<body>{page}</body>", f"<body>{plain}</body>")
        assert len(pairs) == n
    assert time.perf_counter() - began < 10
    _, pairs = aligned(f"<body>{with_rules}</body>", f"<body>{plain}</body>")
    assert len(pairs) == n and time.perf_counter() - began < 60


def test_named_parts_are_left_out(spark):
    page = ("<html><head><title>t</title></head><body><header>h</header><nav>n</nav>"
            "<main><h1>A&nbsp;B</h1><p>c&lt;d<br>e</p><ul><li>f<li>g</ul><form>q</form>"
            "<aside>s</aside><div class='cookie-notice'>k</div><section id=comments>u</section>"
            "<script>var x='</main>';</script><div class='headline'>i</div></main>"
            "<div class=\"sidebar\">v</div><footer>w</footer></body></html>")
    df = spark.createDataFrame([(1, "http://a.b/", page)], "page_id long, url string, html string")
    assert wrappers.extract_main(df).first()["text"] == "A B c<d e f g i"


def text_of(page):
    return wrappers.main_text(wrappers.parse(page), set())


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "no-sidebar", "has-sidebar", "sidebar",
                                  "market-share", "search-results"])
def test_wrappers_of_the_article_are_not_aside(name):
    page = f"<div class='{name}'><article><p>whole story</p></article></div><p>x</p>"
    assert text_of(page) == "whole story"
    assert text_of(f"<div id={name}><main>story</main></div><article>own</article>") == "story own"


def test_parts_of_the_article_named_like_asides():
    page = ("<article><h2 id='side-effects'>a</h2><section id='discussion'>b</section>"
            "<h3 id=related>c</h3><section id=related-work>d</section><div id=search>e</div>"
            "<section class='market-share'>f</section><div class='related'>x</div>"
            "<div class='ad-slot'>x</div><div class='share_buttons'>x</div></article>")
    assert text_of(page) == "a b c d e f"
    assert text_of("<main><h2 id=login>a</h2><section id=alert>b</section></main>") == "a b"
    # an article that is not the main text does not free what it stands in
    assert text_of("<article>a</article><div id=comments><article>b</article></div>") == "a"
    assert text_of("<div>main text</div><aside><article>b</article></aside>") == "main text"


def test_hidden_is_an_attribute_and_ends_may_be_missing():
    page = ("<article><a title='Our hidden past'>a</a><p data-x=\"a hidden gem\">b</p>"
            "<p data-x= hidden>c</p><p title='x class=ads '>d</p><p hidden>x</p>"
            "<p class=a HIDDEN=''>x</p><div hidden=until-found>x</div><svg><p>e</p>"
            "<template><p>f</p><noscript>g</article>")
    assert text_of(page) == "a b c d e f g"
    assert text_of("<p>a<svg><text>x</text></svg><script>x") == "a"
    assert text_of("<p>a" + "<svg>" * 200_000 + "b") == "ab"


def extracted(spark, pages):
    rows = [(i, "http://one.host/p", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: r["text"] for r in wrappers.extract_main(df).collect()}


def test_every_layout_learns_its_template(spark):
    """Two layouts, stubs and single pages of one host; nothing is named."""
    one = "<body><div class=x{0}>Shop since 1900</div><div><p>First {1} kind</p></div></body>"
    two = "<body><section>All rights are ours</section><section><h2>Second {0}</h2></section></body>"
    pages = [one.format(i, f"w{i * 7}") for i in range(9)]
    pages += [two.format(f"v{i * 3}") for i in range(6)]
    pages += ["<p>error", "<table><tr><td>stub", "<body><main>alone</main></body>"]
    got = extracted(spark, pages)
    assert [got[i] for i in range(9)] == [f"First w{i * 7} kind" for i in range(9)]
    assert [got[9 + i] for i in range(6)] == [f"Second v{i * 3}" for i in range(6)]
    assert [got[15], got[16], got[17]] == ["error", "stub", "alone"]


def test_layouts_ignore_what_the_article_holds():
    page = "<body><nav>n</nav><div class='p-{0}'><article>{1}</article></div><footer>f</footer>"
    same = {wrappers.layout_of(page.format(i, "<div class=a>" * i)) for i in range(4)}
    assert len(same) == 1 and wrappers.REST not in same
    assert wrappers.layout_of("<div class=a>") != wrappers.layout_of("<div class=b>")
    assert wrappers.layout_of("<" * 200_000 + "<a" * 200_000) is not None
    assert wrappers.layout_of("") is None


def test_captures_of_one_article_keep_it(spark):
    """Most pages show one article with another advert, menu line and date."""
    page = ("<body><article>{0}<p>{1}</p></article><div>line {2}</div><p>always here</p></body>")
    story = "A long story that stands in most of the captures of this host, word for word."
    pages = [page.format("", story, i) for i in range(30)]
    pages += [page.format("<p>Day {0}</p>".replace("{0}", str(i)), story, i) for i in range(30)]
    got = extracted(spark, pages)
    assert [got[i] for i in range(30)] == [story] * 30
    assert [got[30 + i] for i in range(30)] == [f"Day {i} {story}" for i in range(30)]


def test_repeated_main_texts_vote_once(spark):
    """Many captures of a second article share the first one's author, four others do not."""
    page = "<body><article><h1>{0}</h1><p>{1}</p><p>more of {0}</p></article><i>{2}</i></body>"
    pages = [page.format("first", "by Ann", i) for i in range(40)]
    pages += [page.format("second", "by Ann", i) for i in range(40)]
    pages += [page.format(f"next{i}", f"by Bob{i}", i) for i in range(4)]
    got = extracted(spark, pages)
    assert got[0] == "first by Ann more of first" and got[40] == "second by Ann more of second"
    assert got[81] == "next1 by Bob1 more of next1"


# 4: top k


def test_top_k_with_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)] + [(0, rows[0][1]), (7, [9.0, 1.0])]
    rows += [(2000, None), (None, [0.1] * 6), (2050, [float("nan")] * 6), (2100, [None] * 6),
             (2150, [0.25, 1.0]), (2200, [1e6] * 6), (2250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.withColumn("score", F.lit("own"))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    asked = {(i, tuple(v)) for i, v in good if i % 50 == 0}
    for i, v in asked:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good
                        if j != i and len(w) == len(v) and len(v))
        expected += [(i, n, j, -s) for n, (s, j) in enumerate(scores[:5], 1)]
    assert got == sorted(expected)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_vectors_that_overflow(spark):
    """Scores beyond 64 bits count as the ends of the range; all others stay exact."""
    end = (1 << 63) - 1
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 4)]) for i in range(60)]
    rows += [(100, [1e7, 3e6, -2e6, 1e6]), (101, [1e7, 1e6, 3.0, 2e6]), (102, [-3e12, 1.0, 0.0, 0.0]),
             (150, [2e12, 0.0, 0.0, 5.0]), (103, [-1e300, 1e300, 1.0, 1.0]), (104, [2e12, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    whole = {i: [max(-end, min(end, int(np.floor(256 * x)) if abs(x) < 1e16 else int(x)))
                 for x in v] for i, v in rows}
    expected = []
    for i in (0, 50, 100, 150):
        scores = sorted((-max(-end, min(end, sum(a * b for a, b in zip(whole[i], w)))), j)
                        for j, w in whole.items() if j != i)
        expected += [(i, n, j, -s) for n, (s, j) in enumerate(scores[:5], 1)]
    assert got == sorted(expected)


# 5: toxicity


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    odds, edge = rng.normal(size=9), rng.normal(size=(2, 2))
    offsets = np.array([0, 4, 4, 5, 9])
    p = toxicity.marginals(odds, offsets, edge)[0]
    for a, b in zip(offsets[:-1], offsets[1:]):
        n = b - a
        total, on = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(odds[a + i] * y[i] for i in range(n))
                       + sum(edge[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            on += w * np.array(y)
        if n:
            assert np.allclose(p[a:b], on / total)


def test_toxic_documents_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).join(labels, "doc_id")
    rows = found.where(toxicity.held_out(F.col("doc_id"))).collect()
    right = sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows)
    assert right / len(rows) > 0.93
    for r in rows:
        for s in r["toxic_spans"]:
            assert 0 <= s["start"] < s["end"] <= len(r["text"])


def test_toxicity_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (None, 1), (6, None), (7, 5), (1, 0)], "doc_id long, toxic int"
    )
    model = toxicity.fit(awkward, labels)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.keep_clean(empty, labels.where("false")).count() == 0
    assert toxicity.keep_clean(awkward, labels).columns == awkward.columns


def test_toxicity_learns_one_text_of_a_repeated_id(spark):
    """Thousands of rows of one labelled id weigh like one; the fold of a null id is false."""
    rows = [(i, "vile scum words " * 3 if i % 2 else "kind calm words " * 3) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    more = spark.createDataFrame(rows + [(1, rows[1][1])] * 2_000, "doc_id long, text string")
    a, b = toxicity.fit(once, labels), toxicity.fit(more, labels)
    assert a.lexicon == b.lexicon
    assert np.allclose(a.node, b.node) and np.allclose(a.curve, b.curve)
    ids = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert all(r[0] is not None for r in ids.select(toxicity.held_out(F.col("doc_id"))).collect())


def test_few_labels_rank_toxic_documents(spark):
    """Sixty labels are enough for words that toxic documents share; slopes are never negative."""
    rng = np.random.default_rng(5)
    words = np.array([f"wort{i}" for i in range(400)])
    bad = np.array(["vile", "scum", "filth", "swine"])
    rows = []
    for i in range(300):
        text = rng.choice(words, 60).tolist()
        if i % 6 == 0:
            text[5:5] = rng.choice(bad, 3, replace=False).tolist()
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    known = labels.where(~toxicity.held_out(F.col("doc_id"))).orderBy("doc_id").limit(60)
    model = toxicity.fit(docs, known)
    assert {"=vile", "=scum", "=filth", "=swine"} & model.lexicon.keys()
    assert (model.curve[1:] >= 0).all()
    held = toxicity.score(docs, model).where(toxicity.held_out(F.col("doc_id"))).collect()
    high = [r["score"] for r in held if r["doc_id"] % 6 == 0]
    low = [r["score"] for r in held if r["doc_id"] % 6]
    assert np.mean([a > b for a in high for b in low]) > 0.9


# 6: decontamination


def distance(item, text):
    """Smallest edit distance of the item to a stretch of the text, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row = row, [0]
        for i, x in enumerate(item, 1):
            row.append(min(last[i - 1] + (x != c), last[i] + 1, row[i - 1] + 1))
        best = min(best, row[-1])
    return best


def test_edited_items_are_found(spark):
    rng = np.random.default_rng(4)
    letters = "abcdefgh "
    items = ["".join(letters[i] for i in rng.integers(0, 9, 90)).strip() for _ in range(6)]
    texts = []
    for n in range(40):
        body = list(items[n % 6])
        for _ in range(n // 3):
            at = int(rng.integers(0, len(body)))
            body[at:at + int(rng.integers(0, 2))] = letters[int(rng.integers(0, 9))]
        noise = "".join(letters[i] for i in rng.integers(0, 9, 120))
        texts.append(noise[:60] + ", " + "".join(body).upper() + "! " + noise[60:])
    matcher = decontaminate.Matcher(list(enumerate(items)), decontaminate.RATE)
    for text in texts:
        body = decontaminate.plain(text)
        got = {i: d for i, d, _, _ in matcher.find(text)}
        for i, item in enumerate(map(decontaminate.plain, items)):
            d = distance(item, body)
            assert got.get(i) == (d if d <= int(len(item) * decontaminate.RATE) else None)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for r in decontaminate.find_items(docs, bench).collect():
        assert [tuple(m) for m in r["matches"]] == matcher.find(r["text"])


def test_short_items_with_other_words_are_found():
    """Copies of an item of 80 characters with one or two whole words gone, added or replaced."""
    item = ("which extraordinarily large animal lives near uncharacteristically warm water "
            "in our seas")
    words = item.split()
    longest = sorted(range(len(words)), key=lambda i: -len(words[i]))[:2]
    assert sum(len(words[i]) + 1 for i in longest) > int(len(item) * decontaminate.RATE)
    matcher = decontaminate.Matcher([(7, item)], decontaminate.RATE)
    for change in ("", "somethingdifferentandlong"):
        for gone in ([longest[0]], [longest[1]], longest):
            copy = " ".join(change if i in gone else w for i, w in enumerate(words))
            text = f"Before it. {copy.upper()}! And after it."
            ((found, _, a, b),) = matcher.find(text)
            assert found == 7 and text[a:b].split()[0] == "WHICH" and text[a:b].endswith("SEAS")
    assert matcher.find(item.replace("large", "large and rather")) != []
    assert matcher.find(item.replace("large", "x").replace("warm", "y").replace("our", "z")
                        .replace("extraordinarily", "").replace("near", "")) == []


def test_decontaminate_awkward_rows(spark, awkward, empty):
    bench = spark.createDataFrame(
        [(1, None), (2, ""), (3, "..."), (4, "the same few words stand"), (4, "few words stand here"),
         (None, "wort5x5 wort6x6 wort7x7")], "item_id long, text string"
    )
    kept = decontaminate.decontaminate(awkward, bench)
    assert kept.columns == awkward.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, 3, 4, 5, 8, 9, 10}
    assert decontaminate.decontaminate(awkward, bench.where("false")).count() == awkward.count()
    assert decontaminate.decontaminate(empty, bench).count() == 0


# 7: token counts


def test_length_histogram(spark, documents, awkward):
    for df in (documents, awkward):
        lengths = [r[0] for r in token_counts.token_counts(df).select("n_tokens").collect()]
        rows = token_counts.length_histogram(df).collect()
        assert sorted(r["n_tokens"] for r in rows) == sorted(set(lengths))
        for r in rows:
            n = r["n_tokens"]
            assert r["n_docs"] == lengths.count(n)
            assert r["docs_ge"] == sum(x >= n for x in lengths)
            assert r["tokens_ge"] == sum(x for x in lengths if x >= n)
            assert r["docs_cut"] == sum(x > n for x in lengths)
            assert r["tokens_kept"] == sum(min(x, n) for x in lengths)
            assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    assert token_counts.length_histogram(documents.where("false")).count() == 0


def test_any_context_limit_is_answered(spark, awkward):
    lengths = [r[0] for r in token_counts.token_counts(awkward).select("n_tokens").collect()]
    hist = token_counts.length_histogram(awkward)
    limits = {0, 1, 3, 2048, *lengths, max(lengths) - 1, max(lengths) + 5}
    rows = {r["n_tokens"]: r for r in token_counts.at_limits(hist, limits).collect()}
    assert rows.keys() == limits and not limits <= set(lengths)
    for n, r in rows.items():
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_ge"] == sum(x >= n for x in lengths)
        assert r["tokens_ge"] == sum(x for x in lengths if x >= n)
        assert r["docs_cut"] == sum(x > n for x in lengths)
        assert r["tokens_kept"] == sum(min(x, n) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    (none,) = token_counts.at_limits(hist.where("false"), [5]).collect()
    assert tuple(none) == (5, 0, 0, 0, 0, 0, None)


def test_lengths_against_the_other_library(documents):
    from tokenizers import Tokenizer

    path = token_counts.VOCABULARY.replace(".tiktoken", ".json")
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    for r in token_counts.token_counts(documents.limit(50)).collect():
        assert r["n_tokens"] == len(tool.encode(r["text"], add_special_tokens=False).ids)


# 8: personal data


def luhn(digits):
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def plain_pii(text):
    def digits(m):
        return re.sub("[^0-9]", "", m)

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
               lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+",
                 lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    out = []
    for rank, (kind, (pattern, good)) in enumerate(rules.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "")
                if good(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_personal_data(spark, documents, awkward):
    rng = np.random.default_rng(6)
    alphabet = "a.b@1 2+3(4)-5_é\U0001f600" + "0123456789.."
    rows = [(i, "".join(alphabet[j] for j in rng.integers(0, len(alphabet), 80)))
            for i in range(1500)]
    rows += [(5000, "x a@b.c_d@e.f 4111-1111 1111 1111 1.2.3.4.5.6.7.8 +49 (30) 123456-7 "),
             (5001, "pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, "
                    "not DE88370400440532013000")]
    noise = spark.createDataFrame(rows, "doc_id long, text string")
    # the plain patterns need quadratic time on the long runs of rows 9 and 10
    short = awkward.where("doc_id is null or doc_id not in (9, 10)")
    for df in (documents, short, noise):
        for r in pii.find_pii(df).collect():
            base = [s for s in r["spans"] if s["kind"] in pii.BASE]
            assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base) == plain_pii(
                r["text"]
            )
            assert all((r["text"])[s["start"]:s["end"]] == s["value"] for s in r["spans"])
    found = pii.find_pii(noise.where("doc_id = 5001")).first()["spans"]
    assert [s["value"] for s in found if s["kind"] == "iban"] == [
        "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    runs = pii.find_pii(awkward.where("doc_id in (9, 10)")).collect()
    assert {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in runs} == {9: set(), 10: {"ip"}}


def test_redaction(awkward, empty):
    got = pii.redact(awkward)
    assert got.columns == awkward.columns and got.count() == awkward.count()
    row = got.where("doc_id = 8").first()
    # the runs of digits that hold the phone and the card are too long for either
    assert row["text"] == "<EMAIL> +1 (555) 123-4567 4111 1111 1111 1111 <IP> 1 2"
    assert row["spans"] == "own spans"
    assert got.where("doc_id = 3").first()["text"] is None
    assert pii.redact(empty).count() == 0


def plain_redaction(text, spans):
    out, at = "", 0
    for s in spans:
        if s["start"] >= at:
            out += text[at:s["start"]] + f"<{s['kind'].upper()}>"
        at = max(at, s["end"])
    return out + text[at:]


def test_redaction_against_a_plain_version(spark, documents, awkward):
    rng = np.random.default_rng(8)
    signs = ["a@b.co ", "1.2.3.4", "+49 30 1234567", "4111 1111 1111 1111", "é\U0001f600", " ",
             "x" * 700, "\n", "GB82WEST12345698765432 ", "12"]
    rows = [(i, "".join(signs[j] for j in rng.integers(0, len(signs), 60))) for i in range(300)]
    noise = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (documents, awkward, noise):
        found = pii.find_pii(df.select("text"))
        both = pii.redact(found.withColumn("whole", F.col("text")).select("whole", "spans", "text"))
        for r in both.collect():
            whole = r["whole"]
            assert r["text"] == (whole if whole is None else plain_redaction(whole, r["spans"]))


def test_personal_data_of_long_texts(spark):
    """Work grows with the number of matches: tens of thousands in one text."""
    texts = [" ".join(str(10 + i % 89) for i in range(60_000)), ", ".join(["12"] * 60_000),
             " ".join(f"user{i}@host{i % 7}.example" for i in range(20_000)),
             "4111 1111 1111 1111, " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pii.redact(df.limit(1)).collect()
    began = time.perf_counter()
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(df.repartition(1)).collect()}
    whole = {r["doc_id"]: r["text"] for r in pii.redact(df.repartition(1)).collect()}
    assert time.perf_counter() - began < 40
    assert [len(spans[i]) for i in range(4)] == [0, 0, 20_000, 20_000]
    for i in (2, 3):
        assert all(texts[i][s["start"]:s["end"]] == s["value"] for s in spans[i])
    assert whole == {i: plain_redaction(t, spans[i]) for i, t in enumerate(texts)}


# 9: archives


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "payload " * 40
    rows = [(1, "http://a/", big), (2, "http://b/", big), (2, "http://b/", big), (3, None, None),
            (4, "http://c/\r\nx%0A", ""), (5, "http://d/", "short"), (6, "http://e/", "short"),
            (None, "http://f/", big), (7, "http://g/", "é\0\r\n\r\n" + "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.withColumn("payload", F.lit("own")).withColumn("digest", F.lit("own"))
    folder = str(tmp_path / "warc")
    warc.write_archives(df, folder)
    back = warc.read_archives(spark, folder).collect()
    assert len(back) == len(rows) and all(r["fault"] is None for r in back)
    given = {(i, u): (h or "").encode() for i, u, h in rows}
    for r in back:
        payload = given[r["page_id"], r["url"]]
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == hashlib.sha256(payload).hexdigest()
        again = payload == big.encode() and r["page_id"] != 1
        assert r["refers_to"] == (1 if again else None)
        assert r["record_type"] == ("revisit" if again else "response")
        assert r["payload"] == (None if again else payload)
    assert warc.round_trip(df.where("false")).count() == 0


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    rows = [(i // 2, "http://a/", f"{i % 3}" * 1_000) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "warc"))
    files = [p for p in (tmp_path / "warc").iterdir() if p.name.startswith("part-")]
    held = [len(list(warc.frames(p.read_bytes()))) for p in files]
    assert len(held) == 8 and sum(held) == 400 and max(held) <= 75
    assert warc.read_archives(spark, str(tmp_path / "warc")).where("fault is null").count() == 400


def test_archives_use_a_dictionary_and_show_damage(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    folder = str(tmp_path / "pages")
    warc.write_archives(pages.coalesce(1), folder)
    (file,) = [p for p in (tmp_path / "pages").iterdir() if p.name.startswith("part-")]
    content = file.read_bytes()
    assert content[:4] == b"\x5d\x2a\x4d\x18" and int.from_bytes(content[4:8], "little") > 1000
    records = list(warc.frames(content))
    assert len(records) == pages.count()
    for raw, fault in (
        (records[0][:-5], "record length"),
        (records[0].replace(b"WARC/1.1", b"WARC/9.9", 1), "version"),
        (records[0].replace(b"WARC-Date", b"WARC-Dated", 1), "missing field"),
        (records[0].replace(b"<article>", b"<Article>", 1), "payload digest"),
        (b"", "version"),
    ):
        assert warc.parse(raw)[-1] == fault
    with pytest.raises(ValueError):
        list(warc.frames(content[8:]))
    with pytest.raises(Exception):
        list(warc.frames(content[:-40]))
