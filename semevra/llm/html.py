"""HTML extraction: gradient-boosted trees over DOM-node features, decoded over the tree.

Each page is parsed to a DOM. Nodes get features of text, tags and links in their subtree (densities), tag and attribute
tokens, depth, and their place among siblings. Boosted trees, fitted to a bounded, hash-ordered sample of pages whose own
semantic elements supply the labels, score every node. What lies inside article or main is content; what lies outside them, on a
page that has one, and nav, footer, aside and header are not. The names of those elements are no features, and the tokens of
class and id, which are features, take no part in the labels. Decoding takes the best of keeping a subtree whole, dropping it whole, or deciding child by child, so a
node is never kept under a dropped ancestor or dropped under a kept one.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semevra.llm import text as T
from semevra.session import bounded_batches

MAX_PAGES = 1500
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.2
TAG_BUCKETS, ATTR_BUCKETS = 16, 16
SPLIT_COST = 0.5

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
#: A text and a tag whose attributes hold no angle brackets and no open quote.
_PLAIN = re.compile(r"""([^<]*+)(?:<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+)>)?""")
_SPECIAL = re.compile(r"[>\"']")
#: A name without a value is taken too, so that no attribute is looked at twice.
_ATTR = re.compile(r"""([A-Za-z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "template", "noscript", "svg", "head"))
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var wbr br".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_GOOD, _BAD = frozenset(("article", "main")), frozenset(("nav", "footer", "aside", "header"))
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


class _Ahead:
    """The next place of a pattern at or behind a position, in time linear in the text over all calls with rising positions."""

    __slots__ = ("find", "low", "high")

    def __init__(self, find: Callable[[int], int]) -> None:
        self.find, self.low, self.high = find, 0, -1

    def __call__(self, at: int) -> int:
        if not self.low <= at <= self.high:
            self.low, self.high = at, self.find(at)
        return self.high


def pieces(source: str) -> Iterator[tuple[str | None, bool, str]]:
    """(tag name or None, closing, attributes or text) in one pass: a text is given as (None, False, text).

    A tag ends at the first > outside quotes, or at the first > of all if a quote stays open; a < without a > behind it, or
    without a name, is text. Comments, declarations and processing instructions are left out. No part is scanned again and
    again, so the time is linear in the length of the page, however broken.
    """
    n = len(source)

    def behind(x: str) -> Callable[[int], int]:
        return lambda at: (k if (k := source.find(x, at)) >= 0 else n)

    end, quote = _Ahead(behind(">")), {q: _Ahead(behind(q)) for q in "\"'"}
    special = _Ahead(lambda at: (m.start() if (m := _SPECIAL.search(source, at)) else n))
    unclosed: set[int] = set()  # quotes from which no end of a tag is reached
    at = 0
    while at < n:
        plain = _PLAIN.match(source, at)
        text, slash, tag, attrs = plain.groups()
        if text:
            yield None, False, text
        if tag:
            yield tag.lower(), slash == "/", attrs
            at = plain.end()
            continue
        lt = at + len(text)
        if lt >= n:
            return
        if source.startswith("<!--", lt):
            stop = source.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
            continue
        head = source[lt + 1 : lt + 2]
        if head in ("!", "?"):
            gt = end(lt)
            if gt < n:
                at = gt + 1
                continue
        closing = head == "/"
        name = _NAME.match(source, lt + 1 + closing)
        if name is None or end(lt) >= n:
            step = 1 if name or head in ("", "/", "!", "?", "<") else 2
            yield None, False, source[lt : lt + step]
            at = lt + step
            continue
        k, seen = name.end(), []
        while (k := special(k)) < n and source[k] != ">":
            if k in unclosed:
                k = n
                break
            seen.append(k)
            shut = quote[source[k]](k + 1)
            if shut >= n:
                k = n
                break
            k = shut + 1
        if k >= n:
            unclosed.update(seen)
            k = source.find(">", name.end())
        yield name.group().lower(), closing, source[name.end() : k]
        at = k + 1


class Page:
    """Arrays over the elements of a page in document order; element 0 is the root. runs: (element, text)."""

    __slots__ = ("tag", "attrs", "parent", "last", "runs")

    def __init__(self, source: str) -> None:
        self.tag, self.attrs, self.parent = ["#root"], [""], [-1]
        self.runs: list[tuple[int, str]] = []
        stack, raw = [0], None
        block = [0]  # of each place in the stack: the nearest place, itself or below, that is no inline element
        held: Counter[str] = Counter()

        def shorten(to: int) -> None:
            for e in stack[to:]:
                held[self.tag[e]] -= 1
            del stack[to:], block[to:]

        for name, closing, attrs in pieces(source):
            if name is None:
                if raw is None:
                    if attrs.strip():
                        self.runs.append((stack[-1], _html.unescape(attrs)))
                    elif self.runs and self.runs[-1][0] == stack[-1]:
                        self.runs.append((stack[-1], " "))
                continue
            if raw is not None:
                if closing and name == raw:
                    raw = None
                elif raw == "head" and name == "body":
                    raw = None
                else:
                    continue
                if closing:
                    continue
            if closing:
                if held[name] > 0:
                    k = len(stack) - 1
                    while self.tag[stack[k]] != name:
                        k -= 1
                    shorten(k)
                continue
            if name in _RAW and not attrs.rstrip().endswith("/"):
                raw = name
                continue
            if name in _CLOSES_P or name in _SAME:
                k = block[-1]
                if k > 0 and self.tag[stack[k]] in _SAME.get(name, ("p",)):
                    shorten(k)
            self.tag.append(name)
            self.attrs.append(attrs)
            self.parent.append(stack[-1])
            if name not in _VOID and not attrs.rstrip().endswith("/"):
                block.append(block[-1] if name in _INLINE else len(stack))
                stack.append(len(self.tag) - 1)
                held[name] += 1
        n = len(self.tag)
        self.last = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if self.last[i] > self.last[p]:
                self.last[p] = self.last[i]


def _tokens(attrs: str) -> list[str]:
    out = []
    for k, a, b, c in _ATTR.findall(attrs):
        if k.lower() in ("class", "id", "role", "itemprop"):
            out += re.findall(r"[a-z]+", (a or b or c).lower())
    return out


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(features, own text length) of the elements of a page."""
    n = len(page.tag)
    own = np.zeros(n)
    sentences = np.zeros(n)
    for e, t in page.runs:
        own[e] += len(t.strip())
        sentences[e] += len(_SENTENCE.findall(t))
    parent = np.array(page.parent)
    last = np.array(page.last)
    link = np.zeros(n)
    inside = np.zeros(n, bool)
    depth = np.zeros(n)
    index, count, position = np.zeros(n), np.zeros(n), [0] * n
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        inside[i] = inside[p] or page.tag[i] == "a"
        index[i] = position[p]
        position[p] += 1
    count = np.array(position, float)
    link[inside] = own[inside]
    total = lambda x: (c := np.r_[0.0, np.cumsum(x)])[last + 1] - c[np.arange(n)]
    text, links, tags, sents = total(own), total(link), total(np.ones(n)), total(sentences)
    anchors = total(np.array([t == "a" for t in page.tag], float))
    paras = total(np.array([t == "p" for t in page.tag], float))
    all_text = max(text[0], 1.0)
    up = np.maximum(parent, 0)
    sib_text = np.maximum(text[up] - text, 0)
    cols = [
        np.log1p(own), np.log1p(text), text / all_text, links / np.maximum(text, 1), text / tags, np.log1p(tags), anchors / tags, paras / tags,
        sents / np.maximum(text, 1) * 100, np.log1p(sents), depth, index, count[up], index / np.maximum(count[up], 1), np.log1p(sib_text), text / np.maximum(text[up], 1),
        np.log1p(text[up]), links[up] / np.maximum(text[up], 1), np.arange(n) / n, np.log1p(count),
    ]
    hashed = np.zeros((n, TAG_BUCKETS + ATTR_BUCKETS))
    skip = _GOOD | _BAD
    for i, (t, a) in enumerate(zip(page.tag, page.attrs)):
        if t not in skip:
            hashed[i, zlib.crc32(t.encode()) % TAG_BUCKETS] = 1
        if a:
            for w in _tokens(a):
                hashed[i, TAG_BUCKETS + zlib.crc32(w.encode()) % ATTR_BUCKETS] = 1
    return np.c_[np.array(cols).T, hashed], own


def labels(page: Page) -> np.ndarray:
    """1 in content, 0 in boilerplate, -1 unknown, by the semantic elements of the page alone."""
    n = len(page.tag)
    out = np.full(n, -1)
    around = [False] * n  # holds an article or main
    for i in range(n - 1, 0, -1):
        if around[i] or page.tag[i] in _GOOD:
            around[page.parent[i]] = True
    for i in range(1, n):
        v, t = out[page.parent[i]], page.tag[i]
        if t in _BAD and v != 1 or v == -1 and around[0] and not around[i] and t not in _GOOD:
            v = 0
        elif t in _GOOD and v != 0:
            v = 1
        out[i] = v
    return out


class Boosted:
    """Histogram gradient boosting for the logistic loss: complete trees of one depth, as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
        b = self._bin(x)
        base = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
        self.base = float(np.log(base / (1 - base)))
        score = np.full(n, self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES if n and 0 < y.mean() < 1 else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feats, cuts = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, BINS, np.int64)
            for d in range(DEPTH):
                w, first = 1 << d, (1 << d) - 1
                best = np.full(w, 1e-9)
                for j in range(m):
                    key = node * (BINS + 1) + b[:, j]
                    gs = np.bincount(key, g, w * (BINS + 1)).reshape(w, -1)
                    hs = np.bincount(key, h, w * (BINS + 1)).reshape(w, -1)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    c = gain.argmax(1)
                    top = gain[np.arange(w), c]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    feats[first:][:w][better] = j
                    cuts[first:][:w][better] = c[better]
                at = first + node
                node = node * 2 + (b[np.arange(n), feats[at]] > cuts[at])
            leaf = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
            score += leaf[node]
            self.trees.append((feats, cuts, leaf))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)]) if len(self.cuts) else np.zeros((len(x), 0), int)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self._bin(x), np.full(len(x), self.base), np.arange(len(x))
        for feats, cuts, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for d in range(DEPTH):
                at = (1 << d) - 1 + node
                node = node * 2 + (b[rows, feats[at]] > cuts[at])
            out += leaf[node]
        return out


def decode(page: Page, score: np.ndarray, own: np.ndarray) -> np.ndarray:
    """True for the elements kept. A subtree is kept whole (its summed score), dropped whole (minus that), or decided child by child, at SPLIT_COST."""
    n = len(page.tag)
    gain = np.clip(score, -6, 6) * np.log1p(own)
    last = np.array(page.last)
    c = np.r_[0.0, np.cumsum(gain)]
    whole = c[last + 1] - c[np.arange(n)]
    split = np.abs(gain) - SPLIT_COST
    best = np.zeros(n)
    for i in range(n - 1, -1, -1):
        if page.last[i] == i:
            split[i] = -1e18
        best[i] = max(whole[i], -whole[i], split[i])
        if i:
            split[page.parent[i]] += best[i]
    keep = np.zeros(n, bool)
    i = 0
    while i < n:
        if whole[i] >= best[i] and whole[i] > 0:
            keep[i : last[i] + 1] = True
            i = page.last[i] + 1
        elif -whole[i] >= best[i]:
            i = page.last[i] + 1
        else:
            keep[i] = gain[i] > 0
            i += 1
    return keep


def render(page: Page, keep: np.ndarray | None = None) -> str:
    """Text of the kept elements; blocks end lines and white space is collapsed."""
    block = list(range(len(page.tag)))
    for i in range(1, len(block)):
        if page.tag[i] in _INLINE:
            block[i] = block[page.parent[i]]
    lines: list[list[str]] = []
    at = -1
    for e, t in page.runs:
        if keep is None or keep[e]:
            if block[e] != at:
                lines.append([])
                at = block[e]
            lines[-1].append(t)
    out = [_SPACE.sub(" ", "".join(x)).strip() for x in lines]
    return "\n".join(x for x in out if x)


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, id_col: str = "page_id", html_col: str = "html") -> Boosted:
    """A model of labelled elements with text, of at most ``max_pages`` pages in hash order. Without labels it keeps all."""
    bounded_batches(pages)
    rows = pages.select(F.col(html_col).cast("string").alias("h")).filter("h is not null").withColumn("o", F.xxhash64("h"))
    # The sort sees hashes only; the pages of the sample are fetched by them. Equal pages count once.
    chosen = rows.select("o").distinct().orderBy("o").limit(max_pages)
    sample = rows.join(F.broadcast(chosen), "o").dropDuplicates(["o"]).select("h")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = [], []
            for s in b.column("h").to_pylist():
                page = Page(s)
                x, own = features(page)
                y = labels(page)
                ok = (y >= 0) & (own > 0)
                xs.append(x[ok])
                ys.append(y[ok])
            if xs:
                x = np.concatenate(xs).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.concatenate(ys).astype(np.int32))], ["x", "y"])

    got = sample.mapInArrow(nodes, "x binary, y int").orderBy("y", "x").toArrow()
    width = len(features(Page(""))[0][0])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, width).astype(float)
    y = got.column("y").to_numpy().astype(float)
    model = Boosted(x, y)
    if not len(y):
        model.base = 5.0
    return model


def extract(pages: DataFrame, model: Boosted, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, nodes, kept_nodes) for every row.

    nodes counts the elements, without those of head, script and the like. Null and empty pages give the empty text.
    Broken HTML is parsed leniently (unclosed and misnested elements are closed as browsers mostly do). Very long pages are
    parsed whole, in time linear in their length, however broken. Repeated rows give repeated results; a null id stays null;
    other columns are not looked at. An empty table gives an empty result.
    """
    bounded_batches(pages)
    d = pages.select(F.col(id_col).alias("k"), F.col(html_col).cast("string").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b, "h"):
                parsed = [Page(h or "") for h in s.column("h").to_pylist()]
                feats = [features(p) for p in parsed]
                scores = model(np.concatenate([x for x, _ in feats]))
                at, texts, total, kept = 0, [], [], []
                for p, (x, own) in zip(parsed, feats):
                    keep = decode(p, scores[at : at + len(x)], own)
                    at += len(x)
                    texts.append(render(p, keep))
                    total.append(len(x) - 1)
                    kept.append(int(keep[1:].sum()))
                yield pa.RecordBatch.from_arrays(
                    [s.column("k"), pa.array(texts, pa.string()), pa.array(total, pa.int32()), pa.array(kept, pa.int32())], ["k", "text", "nodes", "kept_nodes"]
                )

    return d.mapInArrow(run, f"k {d.schema['k'].dataType.simpleString()}, text string, nodes int, kept_nodes int").withColumnRenamed("k", id_col)
