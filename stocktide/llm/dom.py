"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of its block elements. Each has features: depth, text and its density over the
tags of the subtree, links, list items and form controls in it, place and weight among its siblings,
tag groups, and groups of words in its class, id and role, its own and those of its ancestors. Gradient
boosted trees, fitted on a bounded sample, give the odds that a node belongs to the article. Decoding
finds the best labelling of the whole tree in which every path goes from outside over article to
left out (a notice, advert or comment inside the article), each at most once.

Training rows need no labels: pages that mark their article are teachers, as they are and in variants
with the marks moved into class names or taken away, and with menus, notices, adverts, forms, sidebars and comments
added from the page's own words.

Cases: a null, empty or textless page gives an empty text; unclosed, stray and unknown tags are
repaired as browsers do for the common cases; repeated rows keep a row each; other columns are
ignored; an empty table gives an empty result; if no page marks its article, nodes are judged by
their tags alone. A page needs the memory of its own tree in one task.
"""

from __future__ import annotations

import collections
import html
import random
import re
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEACHERS = 150  # pages in the training sample, in expectation
TREES, DEPTH = 16, 5
TAUGHT = "data-taught-main"  # marks the article for the labels, never for the features

_MARK = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?]")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

# Elements of HTML by kind (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title head object".split())
CONTROLS = frozenset("input select button option".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TAG_GROUPS = (
    frozenset("article main".split()), frozenset("p blockquote pre figure figcaption".split()), frozenset("h1 h2 h3 h4 h5 h6".split()),
    frozenset("nav menu".split()), frozenset("header".split()), frozenset("footer".split()), frozenset("aside".split()),
    frozenset("form button select fieldset dialog".split()), frozenset("ul ol li dl dt dd".split()), frozenset("html body".split()), frozenset("div section".split()),
)
# Words of class names by meaning.
WORD_GROUPS = (
    frozenset("article content main post entry story body text".split()),
    frozenset("nav navbar navigation menu topnav breadcrumb breadcrumbs tabs pagination skip".split()),
    frozenset("ad ads advert advertisement adverts banner sponsor sponsored promo promotion".split()),
    frozenset("header masthead topbar footer bottom copyright colophon".split()),
    frozenset("sidebar aside related recommended widget rail share social tags".split()),
    frozenset("comment comments disqus reply replies discussion respondent".split()),
    frozenset("notice cookie consent gdpr alert popup modal banner newsletter subscribe signup login search form".split()),
)
NAMES = (
    ["depth", "text", "link_share", "density", "stops", "share", "siblings", "place", "sibling_weight", "start", "controls", "items", "ancestor_good", "ancestor_bad"]
    + [f"tag_{i}" for i in range(len(TAG_GROUPS))] + [f"word_{i}" for i in range(len(WORD_GROUPS))] + [f"parent_word_{i}" for i in range(len(WORD_GROUPS))]
)
_GOOD_TAGS, _BAD_TAGS = TAG_GROUPS[0], TAG_GROUPS[3] | TAG_GROUPS[4] | TAG_GROUPS[5] | TAG_GROUPS[6] | TAG_GROUPS[7]


_RAW_ENDS = {name: re.compile(f"</{name}\\s*>", re.I) for name in RAW}


def tag_end(source: str, m: re.Match) -> int | None:
    """Where a mark that begins at `m` ends, or None if no mark-up ends behind it.

    A comment without an end takes the rest. A `>` in quotes belongs to the tag; a quotation mark that
    is never closed counts as an ordinary character. Each character is looked at once.
    """
    if m[0] == "<!--":
        at = source.find("-->", m.end())
        return at + 3 if at >= 0 else len(source)
    if m[2] is None:
        at = source.find(">", m.end())
        return at + 1 if at >= 0 else None
    at, single = m.end(), set()
    while True:
        at = _PLAIN.match(source, at).end()
        if at == len(source):
            return None
        c = source[at]
        if c == ">":
            return at + 1
        close = source.find(c, at + 1) if c not in single else -1
        single |= {c} if close < 0 else set()
        at = close + 1 if close >= 0 else at + 1


class Page:
    """Block elements in page order: parent, tag, word groups, and the stretches of text each owns."""

    def __init__(self, source: str):
        self.parent, self.tag, self.groups, self.taught = [-1], ["#root"], [0], [False]
        self.texts: list[tuple[int, str]] = []  # (owner, text); a block border lies between two owners
        self.counts = np.zeros((1, 4))
        tags, links, controls = [0], [0], [0]
        # Open elements: name, the block each belongs to, and the places of the p and the li that a new block would close.
        stack: list[tuple] = [("#root", 0, None, None)]
        opened: collections.Counter = collections.Counter()
        open_links, at, n = 0, 0, len(source)

        def add(raw: str) -> None:
            if raw:
                text = html.unescape(raw) if "&" in raw else raw
                owner = stack[-1][1]
                self.texts.append((owner, text))
                if open_links:
                    links[owner] += len(text)

        def push(name: str, node: int) -> None:
            _, _, p, li = stack[-1]
            here, inline = len(stack), name in INLINE
            stack.append((name, node, here if name == "p" else p if inline else None, here if name == "li" else li if inline or name == "p" else None))
            opened[name] += 1

        def close(i: int) -> None:
            nonlocal open_links
            for gone, *_ in stack[i:]:
                opened[gone] -= 1
                open_links -= gone == "a"
            del stack[i:]

        while at < n:
            m = _MARK.search(source, at)
            if m is None:
                add(source[at:])
                break
            end = tag_end(source, m)
            if end is None:  # no mark-up can follow
                add(source[at:])
                break
            add(source[at:m.start()])
            at = end
            name = m[2].lower() if m[2] else None
            if name is None:
                continue
            if m[1]:
                if opened[name]:
                    i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name)
                    if name not in INLINE:
                        self.texts.append((stack[i][1], " "))
                    close(i)
                continue
            inside = source[m.end():end - 1]
            if name in RAW and name != "head":
                over = _RAW_ENDS[name].search(source, at) if not inside.rstrip().endswith("/") else None
                at = at if inside.rstrip().endswith("/") else over.end() if over else n
                continue
            if name in VOID:
                tags[stack[-1][1]] += 1
                controls[stack[-1][1]] += name in CONTROLS
                if name in ("br", "hr"):
                    self.texts.append((stack[-1][1], " "))
                continue
            closing = stack[-1][2] if name in CLOSES_P else stack[-1][3] if name == "li" else None
            if closing:
                self.texts.append((stack[closing][1], " "))
                close(closing)
            owner = stack[-1][1]
            if name in INLINE:
                tags[owner] += 1
                open_links += name == "a"
                push(name, owner)
                continue
            words = {w.lower() for found in _ATTR.findall(inside) for w in _TOKEN.findall("".join(found))} if inside else set()
            self.texts.append((owner, " "))
            node = len(self.parent)
            self.parent.append(owner)
            self.tag.append(name)
            self.taught.append(TAUGHT in inside)
            self.groups.append(sum(1 << i for i, g in enumerate(WORD_GROUPS) if words & g))
            for column, value in zip((tags, links, controls), (1, 0, int(name in CONTROLS))):
                column.append(value)
            push(name, node)
        own = np.zeros(len(self.parent))
        stops = np.zeros(len(self.parent))
        for owner, text in self.texts:
            own[owner] += len(text.strip())
            stops[owner] += text.count(".") + text.count(",")
        self.own = np.column_stack([own, links, tags, stops, controls, [t == "li" for t in self.tag]]).astype(float)

    def features(self) -> np.ndarray:
        n = len(self.parent)
        parent = self.parent
        total, depth, good, bad = self.own.copy(), np.zeros(n), np.zeros(n), np.zeros(n)
        before = np.concatenate([[0], np.cumsum(self.own[:, 0])[:-1]])
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            p = parent[i]
            children[p].append(i)
            depth[i] = depth[p] + 1
            good[i] = good[p] + (self.tag[p] in _GOOD_TAGS or bool(self.groups[p] & 1))
            bad[i] = bad[p] + (self.tag[p] in _BAD_TAGS or bool(self.groups[p] & ~1))
        for i in range(n - 1, 0, -1):
            total[parent[i]] += total[i]
        siblings, place, weight = np.ones(n), np.zeros(n), np.ones(n)
        for inner in children:
            if inner:
                mass = total[inner, 0]
                siblings[inner], place[inner] = len(inner), np.arange(len(inner)) / len(inner)
                weight[inner] = (mass + 1) / (mass.mean() + 1)
        text = total[:, 0]
        page = max(1.0, text[0])
        groups = np.array(self.groups)
        above = groups[np.maximum(0, np.array(parent))]
        bits = np.arange(len(WORD_GROUPS))
        flags = np.array([[t in g for g in TAG_GROUPS] for t in self.tag], dtype=float)
        return np.column_stack([
            depth, np.log1p(text), total[:, 1] / np.maximum(1, text), text / (1 + total[:, 2]), total[:, 3] / np.maximum(1, text), text / page, np.log(siblings), place,
            weight, before / page, np.log1p(total[:, 4]), total[:, 5] / (1 + total[:, 2]), good, bad, flags, groups[:, None] >> bits & 1, above[:, None] >> bits & 1])

    def labels(self) -> np.ndarray:
        """Marked article without what is marked as something else inside it."""
        out = np.zeros(len(self.parent), dtype=bool)
        gone = np.zeros(len(self.parent), dtype=bool)
        for i in range(1, len(out)):
            p = self.parent[i]
            gone[i] = gone[p] or self.tag[i] in _BAD_TAGS or bool(self.groups[i] & ~1)
            out[i] = not gone[i] and (out[p] or self.taught[i] or self.tag[i] in _GOOD_TAGS or self.tag[i] == "div" and bool(self.groups[i] & 1))
        return out

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Nodes in the article under the best labelling outside <= article <= left out along every path."""
        n = len(self.parent)
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        best = np.column_stack([no, yes, no])
        for i in range(n - 1, 0, -1):
            outside, inside, left = best[i]
            best[self.parent[i]] += max(outside, inside), max(inside, left), left
        state = np.zeros(n, dtype=np.int64)
        for i in range(1, n):
            p = state[self.parent[i]]
            state[i] = 2 if p == 2 else (p if best[i, p] >= best[i, p + 1] else p + 1)
        return state == 1

    def text(self, chosen: np.ndarray) -> str:
        return _SPACE.sub(" ", "".join(t if chosen[o] else " " for o, t in self.texts)).strip()


def variants(source: str, seed: int) -> list[str]:
    """The page with its marks moved into class names, and with clutter made of its own words added."""
    rng = random.Random(seed)
    words = re.sub(r"<[^>]*>", " ", source).split()[:2000] or ["text"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(2, n)))
    name = lambda i: rng.choice(sorted(WORD_GROUPS[i]))

    def clutter() -> str:
        kind = rng.randrange(6)
        if kind == 0:
            return f'<aside class="{name(4)}"><h3>{line(4)}</h3><ul>' + "".join(f'<li><a href="#">{line(6)}</a></li>' for _ in range(4)) + "</ul></aside>"
        if kind == 1:
            return f'<div class="{name(6)}"><p>{line(20)}</p><button>{line(2)}</button></div>'
        if kind == 2:
            return f'<div class="{name(2)}"><p>{line(12)}</p></div>'
        if kind == 3:
            return f"<form><label>{line(3)}</label><input><button>{line(2)}</button></form>"
        if kind == 4:
            return f'<section class="{name(5)}"><h2>{line(3)}</h2>' + "".join(f'<div class="{name(5)}"><p>{line(30)}</p></div>' for _ in range(3)) + "</section>"
        return f'<header class="{name(3)}"><a href="/">{line(3)}</a> {line(5)}</header>'

    def recast(s: str, tag: str, group: int) -> str:
        return re.sub(rf"<{tag}\b[^>]*>", f'<div class="{name(group)}">', re.sub(rf"</{tag}>", "</div>", s))

    def crowded(s: str) -> str:
        s = re.sub(r"(<body[^>]*>)", lambda m: m[0] + clutter() + clutter(), s, count=1)
        s = re.sub(r"</article>", lambda m: (clutter() if rng.random() < 0.5 else "") + m[0] + clutter() + clutter(), s)
        ends = [m.end() for m in re.finditer(r"</p>", s)]
        if ends:
            at = rng.choice(ends)
            s = s[:at] + clutter() + s[at:]
        return s

    def thinned(s: str) -> str:
        """At times only the first paragraphs, so that short articles are learned too."""
        ends = [m.end() for m in re.finditer(r"</p>", s)]
        keep = rng.choice((1, 2, 3, 5, 1000))
        if len(ends) <= keep:
            return s
        close = s.find("</article>", ends[keep - 1])
        return s if close < 0 else s[:ends[keep - 1]] + s[close:]

    plain = crowded(thinned(source))
    for tag, group in (("nav", 1), ("header", 3), ("footer", 3), ("aside", 4)):
        plain = recast(plain, tag, group)
    bare = re.sub(r"<(article|main)\b[^>]*>", f'<div class="{rng.choice(("col", "left", "inner", "x1", ""))}" {TAUGHT}>', re.sub(r"</(article|main)>", "</div>", plain))
    return [source, crowded(source), recast(recast(plain, "article", 0), "main", 0), bare]


def training_rows(pages: DataFrame, html_col: str = "html", teachers: int = TEACHERS) -> DataFrame:
    """Features and label of the nodes of a bounded sample of pages that mark their article, with their variants."""
    marked = pages.select(F.col(html_col).cast("string").alias("html")).where(F.lower("html").rlike("<(article|main)[\\s>]"))
    share = min(1.0, teachers / max(1, marked.select(F.xxhash64("html")).distinct().count()))
    # A page that repeats teaches once, however many rows it holds.
    sample = marked.where(F.pmod(F.xxhash64("html", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000).distinct()

    def make():
        def step(batch):
            rows = []
            for source in batch.column(0).to_pylist():
                for variant in variants(source, len(source)):
                    page = Page(variant)
                    rows.append(np.column_stack([page.labels()[1:], page.features()[1:]]))
            return tuple(np.concatenate(rows).T.astype(float)) if rows else None
        return step

    return map_batches(sample, make, ", ".join(f"{c} double" for c in ["label", *NAMES]))


class Model:
    """Boosted trees as arrays; all nodes of many pages go down each tree together."""

    def __init__(self, trees: list[np.ndarray], weights: list[float]):
        self.trees, self.weights = trees, weights

    def odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for table, weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH + 1):
                feature = table[at, 0].astype(np.int64)
                inner = feature >= 0
                if not inner.any():
                    break
                left = x[rows, np.maximum(feature, 0)] <= table[at, 1]
                at = np.where(inner, np.where(left, table[at, 2], table[at, 3]).astype(np.int64), at)
            total += weight * table[at, 4]
        return 2 * total


def fit(pages: DataFrame, html_col: str = "html", teachers: int = TEACHERS) -> Model | None:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from stocktide.session import enable_checkpoints, materialize

    rows = materialize(training_rows(pages, html_col, teachers), "nodes")
    kinds = rows.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    if kinds["low"] is None or kinds["low"] == kinds["high"]:
        return None
    enable_checkpoints(pages.sparkSession)
    data = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows).select("label", "features").coalesce(2)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3, maxBins=32).fit(data)
    return Model([_table(t) for t in model.trees], [float(w) for w in model.treeWeights])


def _table(tree) -> np.ndarray:
    """(feature or -1, threshold, left, right, value) of each node, from the printed form of a small tree."""
    rows: list[list[float]] = []
    lines = [x for x in tree.toDebugString.split("\n")[1:] if x.strip()]
    if_ = re.compile(r"\s*If \(feature (\d+) <= (\S+)\)")
    value = re.compile(r"\s*Predict: (\S+)")

    def node(at: int) -> tuple[int, int]:
        """(row, next line)"""
        row = len(rows)
        rows.append([-1.0, 0.0, 0.0, 0.0, 0.0])
        found = if_.match(lines[at])
        if not found:
            rows[row][4] = float(value.match(lines[at])[1])
            return row, at + 1
        left, at = node(at + 1)
        right, at = node(at + 1)  # after the line of Else
        rows[row][:4] = [float(found[1]), float(found[2]), float(left), float(right)]
        return row, at

    node(0)
    return np.array(rows)


def _by_tags(page: Page) -> np.ndarray:
    return np.where(page.labels(), 4.0, -4.0)


def extract(pages: DataFrame, model: Model | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; narrow, no shuffle."""
    # Plain arrays: an executor need not know the class.
    shared = pages.sparkSession.sparkContext.broadcast((model.trees, model.weights) if model else None)

    def make():
        model = Model(*shared.value) if shared.value else None

        def step(batch):
            texts = []
            sources = batch.column(2).to_pylist()
            for at in range(0, len(sources), 100):
                trees = [Page(s or "") for s in sources[at:at + 100]]
                sizes = np.cumsum([0, *(len(p.parent) for p in trees)])
                odds = model.odds(np.concatenate([p.features() for p in trees])) if model else np.concatenate([_by_tags(p) for p in trees])
                texts += [p.text(p.decode(odds[a:b])) for p, a, b in zip(trees, sizes, sizes[1:])]
            return batch.column(0), batch.column(1), texts, [len(t) for t in texts]

        return step

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_batches(rows, make, "page_id long, url string, text string, n_chars long")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
