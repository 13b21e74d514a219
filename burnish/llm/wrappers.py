"""Main text of web pages by wrapper induction.

Pages of one layout of a host share a template. A layout is the set of structural and named
elements outside the article; layouts of too few pages to learn from are taken together. One
typical page of each is its reference; every other page's DOM tree is aligned with it, and with
the reference of the host's commonest layout, by simple tree matching. A text node of a reference
that stands unchanged in nearly all aligned pages is template; nodes that vary are slots, and
slots hold content. Pages with the reference's own main text have no vote, and pages with one and
the same other main text have one vote together, so captures of an article do not make it template. The text of a page is what its slots and unaligned nodes hold inside the main
region: the article if there is one, else the element that holds most of the text. Elements that
say what they are (navigation, footers, forms, adverts and the like) are template in any case.

References and templates are one row per host and layout. They are broadcast while all of them
together are small, else joined by both, with the few columns of ``pages``; a host with a third of
the pages is a few rows on their side. References are chosen from rows without the html.
Votes are joined per task, then by host, layout and main text; they are counted by host, layout
and node. No group of pages meets in one task.

Defined results: a null html is an empty page with empty text; a page without a host belongs to
the host ``''``; damaged markup is read as far as it goes; repeated pages give repeated rows and
count as support only if their text differs from the reference's; an empty table gives an empty
result; other columns are kept, those named like an added one replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import written
from burnish.plans.shipping import ship

#: Aligned pages a node needs to become template, and the share in which it is unchanged. Up to
#: 9 pages the share asks for all of them; 4 tell a fixed line from one that two pages share.
SUPPORT, CONSTANT = 4, 0.9
#: A page that has this share of its main text from the reference is another capture of it.
CAPTURE = 0.8
#: Layout number of a host's pages whose own layout has too few pages.
REST = 0
#: Layouts and references are joined by broadcast up to so many rows.
MOST_ROWS = 500_000
#: Cells of an alignment from which its rows are worked out whole.
SMALL_TABLE = 256
#: All references together are broadcast up to this many bytes.
MOST_BROADCAST = 64 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)"
    r"([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+"""
)
_LAYOUT = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|textarea|title|noscript|template|svg|iframe)\b[^<>]*+>"
    r".*?(?:</\1\s*>|$)|<([a-zA-Z][^\s/<>]*+)([^<>]*+)>",
    re.S | re.I,
)
_ARTICLE = re.compile(r"<(/?)article\b", re.I)
_DIGITS = re.compile(r"[0-9]+")

# Fixed values of the markup language.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_RAW = frozenset("script style textarea title noscript template svg iframe".split())
_SKIPPED = frozenset("noscript template svg".split())  # without an end, only the tag is skipped
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var".split()
)
_CLOSES = {  # an opening tag ends these open elements
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_SCOPE = frozenset("article section div td th table body main aside ul ol dl form nav".split())
# Elements that shape a page also without a name.
_STRUCTURE = frozenset(
    "article aside body div footer form header main nav section table".split()
)
# Elements and names that say they are not the main text.
_ASIDE = frozenset("nav aside form footer button select dialog head menu".split())
_ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog menu menubar".split()
)
#: Whole class names and ids; ``_`` counts as ``-``.
_ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar side nav "
    "navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent notice notices "
    "alert banner popup modal newsletter subscribe comment comments replies discussion related "
    "recommended share sharing social toolbar login search pagination pager masthead "
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper left-sidebar right-sidebar "
    "sidebar-left sidebar-right sidebar-primary sidebar-secondary widget-area nav-bar nav-menu "
    "main-nav main-menu main-navigation site-nav site-navigation top-nav top-menu side-nav "
    "side-menu side-bar page-footer site-footer main-footer footer-links footer-nav footer-menu "
    "cookie-banner cookie-bar cookie-consent cookie-notice cookie-popup consent-banner "
    "newsletter-signup newsletter-form subscribe-form comment-list comment-form comments-area "
    "comments-section related-articles related-posts related-links recommended-articles "
    "recommended-posts share-buttons share-links share-bar social-links social-icons social-media "
    "social-share login-form search-form search-box search-bar page-navigation post-navigation "
    "menu-bar modal-dialog".split()
)
# Those that are also topics or notes: inside an article or main they name content, as ids all
# of them, as classes the second ones.
_TOPICS = frozenset(
    "ad ads advertising alert banner comment consent cookie cookies discussion login menu modal "
    "navigation newsletter notice notices promo recommended related replies search share sharing "
    "side social sponsor sponsored subscribe social-media".split()
)
_NOTES = frozenset("alert discussion login notice notices search side".split())
_SECTIONS = frozenset("h1 h2 h3 h4 h5 h6 section".split())
_BY_NAME, _HIDDEN = 1, 2  # kinds of aside


class Node:
    __slots__ = ("label", "tag", "aside", "children", "text", "size", "key")

    def __init__(self, label: str, tag: str, aside: int):
        self.label, self.tag, self.aside = label, tag, aside
        self.children: list = []
        self.text: str | None = None
        self.size = 0  # nodes of the subtree
        self.key = 0  # equal for subtrees of equal labels


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag by lower-cased name, the first of each; values as they are written."""
    names: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        names.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return names


def _named_aside(tag: str, classes: str, own_id: str, articles: int, mains: int) -> bool:
    """Whether a class or the id says that the element is not main text."""
    if tag in ("html", "body", "article", "main"):
        return False
    inside = articles or mains
    for name in classes.lower().replace("_", "-").split():
        if name in _ASIDE_NAMES and not (inside and name in _NOTES):
            return True
    name = own_id.strip().lower().replace("_", "-")
    if name not in _ASIDE_NAMES or tag in _SECTIONS and (articles or tag != "section"):
        return False
    return not (inside and name in _TOPICS)


def _element(tag: str, attributes: str, articles: int, mains: int) -> Node:
    names = _attributes(attributes) if attributes else {}
    for name in ("class", "id", "role"):
        if "&" in names.get(name, ""):
            names[name] = entities.unescape(names[name])
    marks = f"{names.get('class', '')} {names.get('id', '')}".strip()
    aside = (
        tag in _ASIDE
        or tag in _RAW
        or (tag == "header" and not (articles or mains))
        or names.get("role", "").lower() in _ASIDE_ROLES
        or bool(marks and _named_aside(tag, names.get("class", ""), names.get("id", ""),
                                       articles, mains))
    )
    label = f"{tag} {_DIGITS.sub('0', marks.split()[0].lower())}" if marks else tag
    return Node(label, tag, _HIDDEN if "hidden" in names else _BY_NAME if aside else 0)


def _shown(node: Node) -> int:
    """Characters of text outside what stands aside."""
    total, stack = 0, [node]
    while stack:
        x = stack.pop()
        if x.text is not None:
            total += len(x.text.strip())
        stack.extend(c for c in x.children if not c.aside)
    return total


def _release(root: Node, held: list[tuple[Node, list[Node]]], free: bool) -> None:
    """Elements that hold the main text are not aside, whatever their names say.

    ``held`` are the articles and mains inside aside elements, with these. A main always frees
    them. Articles do so if none stands ``free`` and they hold more text than the rest of the page;
    else they are teasers or comments.
    """
    articles = [x for x in held if x[0].tag == "article"]
    chosen = {id(a) for a, _ in articles}
    if free or sum(_shown(a) for a, _ in articles) <= _shown(root):
        chosen = set()
    for region, around in held:
        if region.tag == "main" or id(region) in chosen:
            for x in around:
                if x.aside == _BY_NAME:
                    x.aside = 0


def parse(page: str) -> Node:
    """The page's elements and text; comments, scripts and styles are left out."""
    root = Node("#page", "#page", 0)
    stack = [root]
    articles = mains = 0
    held, free = [], False
    unclosed: set[str] = set()  # tags without an end from here on
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[:1] == "<" and len(piece) > 1:
                continue
            top = stack[-1].children
            if top and top[-1].text is not None:
                top[-1].text += piece
            else:
                leaf = Node("#text", "#text", 0)
                leaf.text = piece
                top.append(leaf)
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    articles -= sum(x.tag == "article" for x in stack[i:])
                    mains -= sum(x.tag == "main" for x in stack[i:])
                    del stack[i:]
                    break
            continue
        if tag in _RAW:
            if not m[3].endswith("/"):
                end = None
                if tag not in unclosed:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in _SKIPPED:
                    unclosed.add(tag)
                else:
                    at = n
            continue
        closes = {"p"} if tag in _ENDS_P else _CLOSES.get(tag)
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE and not (tag in _CLOSES and stack[i].tag in ("td", "th")):
                    break
        node = _element(tag, m[3], articles, mains)
        stack[-1].children.append(node)
        if tag not in _VOID and not m[3].endswith("/"):
            if tag in ("article", "main") and not node.aside:
                around = [x for x in stack if x.aside]
                if around:
                    held.append((node, around))
                free = free or not around
            stack.append(node)
            articles += tag == "article"
            mains += tag == "main"
    if held:
        _release(root, held, free)
    return root


def measure(root: Node, keys: dict) -> list[Node]:
    """Set sizes and structure keys bottom-up; text nodes in page order."""
    texts, stack = [], [(root, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            if node.text is not None:
                texts.append(node)
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
            continue
        node.size = 1 + sum(c.size for c in node.children)
        shape = (node.label, *[c.key for c in node.children])
        node.key = keys.setdefault(shape, len(keys))
    return texts


class Aligner:
    """Simple tree matching, remembered by the shapes of the subtrees."""

    def __init__(self):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))  # trees may be deep
        self.keys: dict = {}
        self.known: dict[tuple[int, int], int] = {}

    def weight(self, a: Node, b: Node) -> int:
        """Nodes of the largest order- and level-preserving match of the two trees."""
        if a.label != b.label:
            return 0
        if a.key == b.key:
            return a.size
        key = (a.key, b.key)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = 1 + self._total(a.children, b.children)
        return found

    def _total(self, xs: list[Node], ys: list[Node]) -> int:
        head, tail = _common_ends(xs, ys)
        total = sum(x.size for x in xs[:head]) + sum(x.size for x in xs[len(xs) - tail:])
        xs, ys = xs[head:len(xs) - tail], ys[head:len(ys) - tail]
        if not xs or not ys:
            return total
        last = None
        for last, _ in self._rows(xs, ys):
            pass
        return total + int(last[-1])

    def _rows(self, xs: list[Node], ys: list[Node]) -> Iterator[tuple]:
        """Rows of the alignment table, each with the weights of its node.

        Nodes of one shape weigh the same, so the trees below are matched once per pair of shapes.
        Long rows are worked out whole: the running maximum of what comes from above.
        """
        if len(xs) * len(ys) < SMALL_TABLE:
            row = [0] * (len(ys) + 1)
            for x in xs:
                last, row = row, [0]
                weights = [self.weight(x, y) for y in ys]
                for j, w in enumerate(weights):
                    row.append(max(last[j] + w, row[j], last[j + 1]))
                yield row, weights
            return
        shapes = {y.key: y for y in ys}
        at = {key: i for i, key in enumerate(shapes)}
        column = np.array([at[y.key] for y in ys])
        weights_of: dict = {}
        row = np.zeros(len(ys) + 1, dtype=np.int64)
        for x in xs:
            weights = weights_of.get(x.key)
            if weights is None:
                each = np.array([self.weight(x, y) for y in shapes.values()], dtype=np.int64)
                weights = weights_of[x.key] = each[column]
            last, row = row, np.zeros(len(ys) + 1, dtype=np.int64)
            np.maximum(last[1:], last[:-1] + weights, out=row[1:])
            np.maximum.accumulate(row, out=row)
            yield row, weights

    def _matched(self, xs: list[Node], ys: list[Node]) -> Iterator[tuple[Node, Node]]:
        """The children that the best alignment puts together, last ones first."""
        head, tail = _common_ends(xs, ys)
        for k in range(1, tail + 1):
            yield xs[-k], ys[-k]
        mine, theirs = xs[head:len(xs) - tail], ys[head:len(ys) - tail]
        i, j = len(mine), len(theirs)
        if i and j:
            # two bits per cell: it ends a pair, and it is what stands above it
            joins, above, last = [], [], np.zeros(j + 1, dtype=np.int64)
            for row, weights in self._rows(mine, theirs):
                row, weights = np.asarray(row), np.asarray(weights)
                joins.append(np.packbits((weights > 0) & (row[1:] == last[:-1] + weights)))
                above.append(np.packbits(row[1:] == last[1:]))
                last = row
            while i and j:
                byte, bit = (j - 1) >> 3, 7 - ((j - 1) & 7)
                if joins[i - 1][byte] >> bit & 1:
                    yield mine[i - 1], theirs[j - 1]
                    i, j = i - 1, j - 1
                elif above[i - 1][byte] >> bit & 1:
                    i -= 1
                else:
                    j -= 1
        for k in range(head - 1, -1, -1):
            yield xs[k], ys[k]

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """Text nodes of the two trees that the match puts together."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if a.label != b.label:
                continue
            if a.text is not None:
                yield a, b
                continue
            if a.key == b.key:
                stack.extend(zip(a.children, b.children))
                continue
            stack.extend(self._matched(a.children, b.children))


def _common_ends(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
    """How many children of equal shape both lists begin and end with.

    No match of such a pair with others weighs more, so they are put together beforehand.
    """
    most, tail = min(len(xs), len(ys)), 0
    while tail < most and xs[-1 - tail].key == ys[-1 - tail].key:
        tail += 1
    head = 0
    while head < most - tail and xs[head].key == ys[head].key:
        head += 1
    return head, tail


class Reference:
    """A host's reference page, parsed once per worker."""

    def __init__(self, page: str):
        self.aligner = Aligner()
        self.root = parse(page)
        self.texts = measure(self.root, self.aligner.keys)
        self.number = {id(t): i for i, t in enumerate(self.texts)}
        self.body = [_plain(t.text) for t in self.texts]

    def align(self, page: str) -> tuple[Node, list[Node], dict[int, int]]:
        """The page's tree, its texts, and the reference's number of each aligned one."""
        if len(self.aligner.known) > 200_000:
            self.__init_memory()
        root = parse(page)
        texts = measure(root, self.aligner.keys)
        found = {id(y): self.number[id(x)] for x, y in self.aligner.pairs(self.root, root)}
        return root, texts, found

    def __init_memory(self) -> None:
        self.aligner = Aligner()
        measure(self.root, self.aligner.keys)


def _plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _main(root: Node) -> list[Node]:
    """The articles, or the element that holds most of the text outside what stands aside."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.aside:
            continue
        if node.tag in ("article", "main"):
            found.append(node)
            continue
        stack.extend(reversed(node.children))
    if found:
        return found
    sizes: dict[int, int] = {}

    def size(node: Node) -> int:
        order, stack = [], [node]
        while stack:
            x = stack.pop()
            order.append(x)
            if not x.aside:
                stack.extend(x.children)
        for x in reversed(order):
            own = len(x.text.strip()) if x.text is not None else 0
            sizes[id(x)] = 0 if x.aside else own + sum(sizes[id(c)] for c in x.children)
        return sizes[id(node)]

    size(root)
    node = root
    while True:
        inner = [c for c in node.children if c.text is None and not c.aside]
        best = max(inner, key=lambda c: sizes[id(c)], default=None)
        if best is None or best.tag == "p" or sizes[id(best)] < 0.7 * sizes[id(node)]:
            return [node]
        node = best


def main_text(root: Node, template: set[int]) -> str:
    """Text of the main region without aside elements and the given text nodes."""
    out: list[str] = []
    for region in _main(root):
        out.append(" ")
        stack: list = [region]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.text is not None:
                if id(node) not in template:
                    out.append(node.text)
            elif not node.aside:
                edge = "" if node.tag in _INLINE else " "
                out.append(edge)
                stack.append(edge)
                stack.extend(reversed(node.children))
        out.append(" ")
    return _plain("".join(out))


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(found)


def layout_of(page: str | None) -> int | None:
    """Hash of the page's structural and named elements outside the article; never ``REST``.

    Their number and order do not matter, nor do numbers in names. Null for an empty page.
    """
    if not page:
        return None
    edges = [(m.start(), m[1]) for m in _ARTICLE.finditer(page)]
    first = next((at for at, end in edges if not end), len(page))
    last = max((at for at, end in edges if end), default=len(page))
    parts = [page[:first], "<article>" * (first < len(page)), page[max(first, last):]]
    tags = {(m[2], m[3]) for part in parts for m in _LAYOUT.finditer(part) if m[2]}
    labels = set()
    for tag, attributes in tags:
        tag = tag.lower()
        names = _attributes(attributes) if "=" in attributes and tag not in _VOID else {}
        marks = f"{names.get('class', '')} {names.get('id', '')}".split()
        if marks and tag not in _INLINE:
            labels.add(f"{tag} {_DIGITS.sub('0', marks[0].lower())}")
        elif tag in _STRUCTURE:
            labels.add(tag)
    digest = hashlib.blake2b("\n".join(sorted(labels)).encode("utf-8", "replace"), digest_size=8)
    return int.from_bytes(digest.digest(), "big", signed=True) or 1


def _layouts(html: str) -> Column:
    @F.arrow_udf("long")
    def found(pages: pa.Array) -> pa.Array:
        return pa.array([layout_of(p.as_py()) for p in pages], pa.int64())

    return found(F.col(html))


def _joined(rows: DataFrame, few: DataFrame, keys: list[str], small: bool) -> DataFrame:
    return rows.join(F.broadcast(few) if small else few, keys, "left")


def _with_references(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``own`` and ``common`` to pages with ``host, html``: the rows of their layout and host.

    ``common`` is null where it is the page's own. Joins are by broadcast while the rows are small
    in all.
    """
    size = rows.agg(F.sum(F.octet_length("reference"))).first()[0] or 0
    small = size <= MOST_BROADCAST
    value = F.struct(*[c for c in rows.columns if c not in ("host", "common")]).alias("row")
    large = rows.where(F.col("layout") != REST).select("host", "layout", value)
    hosts = rows.groupBy("host").agg(
        F.max(F.when(F.col("layout") == REST, value)).alias("rest"),
        F.max(F.when(F.col("common"), value)).alias("most"),
    )
    found = _joined(pages.withColumn("layout", _layouts("html")),
                    large.withColumnRenamed("row", "mine"), ["host", "layout"], small)
    found = _joined(found, hosts, ["host"], small)
    own = F.coalesce("mine", "rest")
    other = ~F.col("most.layout").eqNullSafe(own["layout"])
    return found.withColumn("own", own).withColumn("common", F.when(other, F.col("most")))\
        .drop("layout", "mine", "rest", "most")


def _references(pages: DataFrame) -> DataFrame:
    """``host, layout, common, reference``: a page of about mean size per host and layout.

    ``common`` marks the host's layout with the most pages.
    """
    some = pages.where("html is not null and html != ''").withColumn(
        "hash", F.xxhash64("url", "page_id")
    )
    slim = written(
        some.select("host", "hash", "page_id", "url", F.length("html").alias("size"),
                    _layouts("html").alias("layout")),
        "layouts",
    )
    large = slim.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"))
    large = written(large.where(F.col("n") > SUPPORT).drop("n"), "large-layouts")
    slim = _joined(slim, large.withColumn("large", F.lit(True)), ["host", "layout"],
                   large.count() <= MOST_ROWS)
    slim = slim.withColumn("layout", F.when(F.col("large"), F.col("layout")).otherwise(F.lit(REST)))
    groups = slim.groupBy("host", "layout").agg(
        F.count(F.lit(1)).alias("n"),
        F.floor(F.sum("size") / F.count(F.lit(1))).alias("middle"),
    )
    groups = written(groups, "layout-sizes")
    small = groups.count() <= MOST_ROWS
    mark = F.struct(F.abs(F.col("size") - F.col("middle")).alias("off"), "hash", "page_id", "url")
    first = _joined(slim, groups, ["host", "layout"], small).groupBy("host", "layout").agg(
        F.min(mark).alias("first")
    )
    most = groups.groupBy("host").agg(F.max(F.struct("n", "layout")).alias("most"))
    first = first.join(most, "host").select(
        "host", "layout", (F.col("layout") == F.col("most.layout")).alias("common"),
        F.col("first.hash").alias("hash"), "first",
    )
    first = written(first, "reference-ids")
    found = some.join(F.broadcast(first) if small else first, ["host", "hash"]).where(
        F.col("first.page_id").eqNullSafe(some["page_id"])
        & F.col("first.url").eqNullSafe(some["url"])
    )
    found = found.groupBy("host", "layout", "common").agg(F.min("html").alias("reference"))
    return written(found, "references")


def _cached(cache: dict[str, Reference], page: str) -> Reference:
    found = cache.get(page)
    if found is None:
        if len(cache) >= 64:
            cache.clear()
        found = cache[page] = Reference(page)
    return found


def _own_text(root: Node, plain: dict[int, str], same: set[int]) -> tuple[float, bytes]:
    """Share of the main text that stands in the given nodes, and a digest of the other text."""
    rest, total, kept = [], 0, 0
    for region in _main(root):
        stack = [region]
        while stack:
            node = stack.pop()
            if node.text is not None:
                text = plain.get(id(node))
                text = _plain(node.text) if text is None else text
                total += len(text)
                if id(node) in same:
                    kept += len(text)
                elif text:
                    rest.append(text)
            elif not node.aside:
                stack.extend(reversed(node.children))
    digest = hashlib.blake2b("\n".join(rest).encode("utf-8", "replace"), digest_size=16)
    return kept / total if total else 0.0, digest.digest()


def _vote(ref: Reference, page: str) -> tuple[bytes, list[int]] | None:
    """A digest of the page's own main text, and per aligned node twice its number, plus 1 if equal.

    Null for captures of the reference: they say nothing about what varies.
    """
    root, texts, found = ref.align(page)
    plain = {id(t): _plain(t.text) for t in texts if id(t) in found}
    same = {t for t, i in found.items() if plain[t] == ref.body[i]}
    if len(same) == len(found):
        return None
    share, digest = _own_text(root, plain, same)
    if share >= CAPTURE:
        return None
    return digest, sorted(2 * i + (t in same) for t, i in found.items())


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host, layout and main text of the batch: the vote of the page of the smallest hash."""
    cache: dict[str, Reference] = {}
    for batch in batches:
        votes: dict[tuple, tuple[int, list[int]]] = {}
        names = ("host", "html", "hash", "own", "common")
        for name, page, mark, *both in zip(*[batch.column(c).to_pylist() for c in names]):
            for row in both:
                if not page or not row or page == row["reference"]:
                    continue
                vote = _vote(_cached(cache, row["reference"]), page)
                if vote:
                    key = name, row["layout"], vote[0]
                    votes[key] = min(votes.get(key, (mark, vote[1])), (mark, vote[1]))
        if votes:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in votes]), pa.array([k[1] for k in votes], pa.int64()),
                 pa.array([k[2] for k in votes], pa.binary()),
                 pa.array([v[0] for v in votes.values()], pa.int64()),
                 pa.array([v[1] for v in votes.values()], pa.list_(pa.int32()))],
                ["host", "layout", "digest", "hash", "marks"],
            )


def induce(pages: DataFrame) -> DataFrame:
    """``host, layout, common, reference, template``: numbers of each reference's template nodes.

    ``pages`` has ``host, page_id, url, html``.
    """
    references = _references(pages)
    voters = pages.select("host", "html", F.xxhash64("url", "html").alias("hash"))
    votes = _with_references(voters, references).mapInArrow(
        _votes, "host string, layout long, digest binary, hash long, marks array<int>"
    )
    texts = votes.groupBy("host", "layout", "digest").agg(
        F.min(F.struct("hash", "marks")).alias("vote")
    )
    marks = texts.select("host", "layout", F.explode("vote.marks").alias("mark"))
    constant = (
        marks.groupBy("host", "layout", F.floor(F.col("mark") / 2).cast("int").alias("node"))
        .agg(F.count(F.lit(1)).alias("seen"), F.sum(F.col("mark") % 2).alias("same"))
        .where((F.col("seen") >= SUPPORT) & (F.col("same") >= CONSTANT * F.col("seen")))
    )
    nodes = constant.groupBy("host", "layout").agg(
        F.sort_array(F.collect_list("node")).alias("template")
    )
    return written(references.join(nodes, ["host", "layout"], "left"), "templates")


def _without(page: str, rows: list[dict], cache: dict[str, Reference]) -> str:
    """The page's main text without the template nodes of all the given references."""
    fixed: set[int] = set()
    for row in rows:
        root, texts, found = _cached(cache, row["reference"]).align(page)
        nodes = set(row["template"])
        fixed.update(k for k, t in enumerate(texts) if found.get(id(t)) in nodes)
    return main_text(root, {id(texts[k]) for k in fixed})


def extract_main(pages: DataFrame) -> DataFrame:
    """Add ``text`` and ``n_chars`` to pages that have ``page_id, url, html``."""
    ship(pages.sparkSession)
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    plain = pages.select(host(F.col("url")).alias("host"), "page_id", "url", "html")
    templates = induce(plain)
    state: dict[str, dict[str, Reference]] = {"cache": {}}

    @F.arrow_udf("string")
    def text(htmls: pa.Array, *rows: pa.Array) -> pa.Array:
        out = []
        for page, *both in zip(htmls, *rows):
            page = page.as_py()
            both = [r for r in (x.as_py() for x in both) if r and r["template"]]
            if not page:
                out.append("")
            elif not both:
                out.append(main_text(parse(page), set()))
            else:
                out.append(_without(page, both, state["cache"]))
        return pa.array(out, pa.string())

    own = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                       host(F.col("url")).alias("host"), F.col("html"))
    found = _with_references(own, templates).withColumn(
        "__text", text(F.col("html"), F.col("own"), F.col("common"))
    )
    return found.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
        F.col("__text").alias("text"),
        F.length("__text").cast("long").alias("n_chars"),
    )
