"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements and text runs.  Each node has features: text and link
density of its subtree, length, depth, attribute tokens and tags of itself and of its ancestors, and what its
siblings are like.  Boosted trees give the chance that a node belongs to the article.  A decoding
over the tree then picks the most likely choice in which nothing below a dropped node is kept.

The trees are fitted on a bounded sample of pages (``SAMPLE_PAGES``, the first in the order of a
hash), labelled by what their markup says: tags and attribute tokens that name boilerplate against
articles and main parts.  In half of the sample pages the trees do not see that a node is in an article,
so that they also learn from density and links.

Defined results: null and empty pages and pages without text give an empty text.  Pages cut off anywhere are
closed at their end.  A head without an end tag ends at the first tag or text that cannot stand in it, and another
hidden element without one where an element around it ends.  Repeated rows get equal results.  Trees of any depth are walked without
recursion.  An empty table gives no rows.  Columns other than id, url and html are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query

#: bound of the training sample; rounds, depth and step of the boosting; bins of a feature
SAMPLE_PAGES, ROUNDS, TREE_DEPTH, RATE, BINS = 400, 40, 3, 0.3, 24
#: pages whose nodes are judged at once
GROUP_PAGES = 64

# fixed values: elements of HTML and the words that pages use to name their parts
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "label"}
HIDDEN = {"head", "noscript", "script", "style", "template", "svg", "iframe", "object", "canvas", "title"}
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog"}
CONTENT_TAGS = {"article", "main"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "#root"}
BOILER_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "reader", "related", "reply", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
CONTENT_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text"}

_TOKEN = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")


class _Dom(HTMLParser):
    """Block elements and text runs as flat lists; parents come before their children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.words = [-1], ["#root"], [frozenset()]
        self.texts: list[str] = [""]
        self.linked: list[int] = [0]
        self.stack = [0]
        self.run: list[str] = []
        self.links = self.in_run = 0
        #: the hidden element and the elements open in it
        self.hidden: list[str] = []

    def _node(self, tag: str, words: frozenset = frozenset(), text: str = "", linked: int = 0) -> int:
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.words.append(words)
        self.texts.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def flush(self) -> None:
        text = _SPACES.sub(" ", "".join(self.run)).strip()
        if text:
            self._node("#text", text=text, linked=self.in_run)
        self.run, self.in_run = [], 0

    def _pop(self, tags: set[str]) -> None:
        """Close the nearest open element of these, unless a scope lies between."""
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[i]]
            if name in tags:
                self.flush()
                del self.stack[i:]
                return
            if name in SCOPES:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        # a head ends at the first tag that cannot stand in it, everything hidden at the body
        if self.hidden == ["head"] and tag not in IN_HEAD or self.hidden and tag == "body" and "body" not in self.tag:
            self.hidden = []
        if self.hidden or tag in HIDDEN:
            if tag not in VOID and (not self.hidden or tag not in ("html", "head", "body")):
                self.hidden.append(tag)
            return
        if tag == "br":
            self.run.append(" ")
        if tag == "a":
            self.links += 1
        found = frozenset(w for k, v in attrs if k in ("class", "id", "role") and v for w in _TOKEN.findall(v.lower())) if attrs else frozenset()
        if tag in VOID and tag != "hr" or tag in INLINE and not found & BOILER_WORDS:
            return
        if tag == "body" and "body" in self.tag:
            return
        if tag in CLOSES_P:
            self._pop({"p"})
        if tag in SELF_CLOSING:
            self._pop(SELF_CLOSING[tag])
        self.flush()
        if tag not in VOID:
            self.stack.append(self._node(tag, found))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag):]
            return
        if self.hidden and not any(self.tag[i] == tag for i in self.stack[1:]):
            return
        # the end of an element around it ends what is hidden
        self.hidden = []
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag == "p" or tag not in VOID:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.tag[self.stack[i]] == tag:
                    self.flush()
                    del self.stack[i:]
                    break

    def handle_data(self, data: str) -> None:
        if self.hidden == ["head"] and data.strip():
            self.hidden = []
        if self.hidden:
            return
        self.run.append(data)
        if self.links:
            self.in_run += len(data.strip())


FEATURES = ("chars", "link_share", "density", "depth", "boiler_tag", "boiler_word", "boiler_above", "content_word", "content_above", "siblings", "place", "alike", "around", "sentences", "is_text")
_LOGS = [FEATURES.index(f) for f in ("chars", "density", "around", "sentences")]


def dom(html: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(parents, texts, features, label): label is 1 for content, 0 for boilerplate, by the markup."""
    parser = _Dom()
    parser.feed(html)
    parser.close()
    parser.flush()
    n = len(parser.tag)
    parent, texts = parser.parent, parser.texts
    chars = [len(t) for t in texts]
    links = [min(a, b) for a, b in zip(parser.linked, chars, strict=True)]
    stops = [t.count(". ") + t.endswith((".", "!", "?")) for t in texts]
    count, kids, seen = [1] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        stops[p] += stops[i]
        count[p] += count[i]
        kids[p] += 1
    same: dict[tuple[int, str], int] = {}
    for key in zip(parent, parser.tag, strict=True):
        same[key] = same.get(key, 0) + 1
    depth, bad, good = [0] * n, [0] * n, [False] * n
    rows: list[tuple] = [(0,) * len(FEATURES)]
    label = np.zeros(n)
    parts = "article" in parser.tag or "main" in parser.tag
    for i in range(1, n):
        p, tag, words = parent[i], parser.tag[i], parser.words[i]
        seen[p] += 1
        depth[i] = depth[p] + 1
        # an article's own header is part of it
        boiler_tag = tag in BOILER_TAGS and not (tag == "header" and good[p])
        boiler_word = bool(words and words & BOILER_WORDS) and tag not in ("body", "html", "article", "main")
        bad[i], good[i] = bad[p] + boiler_tag + boiler_word, good[p] or tag in CONTENT_TAGS
        rows.append((
            chars[i], links[i] / max(1, chars[i]), chars[i] / count[i], min(depth[i], 32), boiler_tag, boiler_word, bad[p] > 0,
            bool(words and words & CONTENT_WORDS), good[i], min(kids[p], 64), seen[p] / kids[p], same[p, tag] / kids[p],
            chars[p] - chars[i], stops[i], tag == "#text",
        ))
        inside = tag in ("html", "body")
        label[i] = not bad[i] and (inside or good[i] or not parts and (chars[i] > 80 and links[i] < 0.3 * chars[i] or tag in ("h1", "h2", "h3")))
    x = np.array(rows, float)
    x[:, _LOGS] = np.log1p(x[:, _LOGS])
    return np.array(parent), texts, x, label


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(prior, trees): complete trees of TREE_DEPTH levels (feature, threshold, leaf values), Newton steps on the logistic loss."""
    if not len(y) or y.min() == y.max():
        return (4.0 if len(y) and y.max() else 0.0), []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    prior = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(len(y), prior)
    trees = []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.ones(len(y), int)
        feature, cut = np.zeros(1 << TREE_DEPTH, int), np.full(1 << TREE_DEPTH, np.inf)
        for at in range(1, 1 << TREE_DEPTH):
            rows = np.flatnonzero(node == at)
            best = 1e-6
            total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for j, e in enumerate(edges):
                if not len(rows) or not len(e):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))
                hs = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - total
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, feature[at], cut[at] = gain[k], j, e[k]
            node[rows] = 2 * at + (x[rows, feature[at]] > cut[at])
        leaf = node - (1 << TREE_DEPTH)
        value = RATE * np.bincount(leaf, g, 1 << TREE_DEPTH) / (np.bincount(leaf, h, 1 << TREE_DEPTH) + 1)
        f = f + value[leaf]
        trees.append((feature, cut, value))
    return prior, trees


def chances(x: np.ndarray, model) -> np.ndarray:
    """Log odds of content for each node."""
    prior, trees = model
    f = np.full(len(x), prior)
    rows = np.arange(len(x))
    for feature, cut, value in trees:
        node = np.ones(len(x), int)
        for _ in range(TREE_DEPTH):
            node = 2 * node + (x[rows, feature[node]] > cut[node])
        f += value[node - (1 << TREE_DEPTH)]
    return f


def decode(parent: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The most likely kept set in which every kept node has a kept parent; the root is kept."""
    yes, no = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
    above = parent.tolist()
    keep, drop = yes, no
    for i in range(len(above) - 1, 0, -1):
        keep[above[i]] += max(keep[i], drop[i])
        drop[above[i]] += drop[i]
    kept = [True] * len(above)
    for i in range(1, len(above)):
        kept[i] = kept[above[i]] and keep[i] >= drop[i]
    return np.array(kept)


def fit(pages: DataFrame, html_column: str = "html"):
    """The model from a bounded sample of pages."""
    text = F.col(html_column).cast("string")
    sample = pages.where(text.isNotNull()).select(text.alias("html")).orderBy(F.xxhash64("html"), "html").limit(SAMPLE_PAGES).collect()
    xs, ys = [np.zeros((0, len(FEATURES)))], [np.zeros(0)]
    for k, (html,) in enumerate(sample):
        _, _, x, y = dom(html)
        if k % 2:
            x[:, FEATURES.index("content_above")] = 0
        xs.append(x[1:])
        ys.append(y[1:])
    return boost(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, model, html_column: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text``: kept blocks in page order, joined by a newline; ``model`` is a broadcast."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, out = batch.column(batch.num_columns - 1), []
            for at in range(0, len(html), GROUP_PAGES):
                trees = [dom(h or "") for h in html.slice(at, GROUP_PAGES).to_pylist()]
                odds = chances(np.concatenate([t[2] for t in trees]), model.value)
                for part, (parent, texts, _, _) in zip(np.split(odds, np.cumsum([len(t[0]) for t in trees])[:-1]), trees, strict=True):
                    kept = decode(parent, part)
                    out.append("\n".join(t for t, k in zip(texts, kept.tolist(), strict=True) if k and t))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "_main_text"])

    rest = [c for c in pages.columns if c != html_column]
    shape = T.StructType([*[f for f in pages.schema.fields if f.name in rest], T.StructField("_main_text", T.StringType())])
    out = pages.select(*rest, F.col(html_column).cast("string").alias("_html")).mapInArrow(run, shape)
    return out.withColumnRenamed("_main_text", "text" if "text" not in {c.lower() for c in rest} else "main_text")


@query("op4_domtrees")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    model = spark.sparkContext.broadcast(fit(pages))  # a few trees
    return extract(pages, model).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
