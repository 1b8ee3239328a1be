"""Operator 5: main text of HTML pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of elements. Each block element (and each element with a class, id or role) is a
node with features: its tag and its parent's, tokens of its attributes and of its ancestors', depth, place among its siblings and how they
are alike, and its subtree's length, link density, tag density, punctuation and paragraphs. Boosted trees give
each node the log-odds of holding main text; decoding takes the best labelling of the tree in which nothing under a
node without main text has any, so that ancestor and descendant can't contradict each other.

The trees are trained here, on pages generated from a fixed seed with known main text: no page of the input is
learnt from, the model is the same for every input, and a lost executor changes nothing.

Defined cases: null and empty pages give an empty text; a page without markup is one block; unclosed elements
end where their parent does; repeated rows give the same text; null ids are kept; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import collections
import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe select option datalist".split())
#: Of these, what runs to the end of the page if it isn't closed.
UNENDING = frozenset("script style textarea title iframe".split())
#: Drawings and formulas: their text is judged, and nothing in them is a block.
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
TAGS = "html body nav header footer aside article main section div p ul ol li form button table tr td h1 h2 h3 h4 blockquote pre figure figcaption a span details dialog head dl address".split()

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>\"']*<[^<>\"']*)>", re.S)
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]{2,}")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
BUCKETS = 96


class Node:
    __slots__ = ("block", "children", "chars", "depth", "foreign", "link_chars", "marks", "node", "parent", "tag", "tags", "tokens", "words")

    def __init__(self, tag: str, parent: Node | None, tokens: tuple[int, ...], block: bool):
        self.tag, self.parent, self.tokens, self.block = tag, parent, tokens, block
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.foreign = tag in FOREIGN or (parent is not None and parent.foreign and tag != "foreignobject")
        self.chars = self.link_chars = self.tags = self.marks = self.words = 0
        self.node = -1
        if parent:
            parent.children.append(self)


@functools.lru_cache(maxsize=20_000)
def attribute_tokens(attributes: str) -> tuple[int, ...]:
    """Buckets of the words in an element's class, id and role."""
    found = set()
    for m in _NAMED.finditer(attributes):
        for part in _PART.findall(_CAMEL.sub("-", m[1] or m[2] or m[3] or "").lower()):
            found.add(zlib.crc32(part.encode()) % BUCKETS)
    return tuple(sorted(found))


def parse(page: str) -> tuple[Node, list[tuple[Node, str | None]]]:
    """The root, and the page's pieces in order: (innermost element, text), with None for the edge of a block."""
    root = Node("html", None, (), True)
    now, pieces, at = root, [], 0

    def text(end: int) -> None:
        if end > at:
            pieces.append((now, page[at:end]))

    while m := _TOKEN.search(page, at):
        text(m.start())
        at = m.end()
        closing, name, attributes = m.groups()[:3] if m[2] else m.groups()[3:]
        if not name:
            continue
        tag = name.lower()
        if closing:
            node = now
            while node and node.tag != tag:
                node = node.parent
            if tag not in INLINE and not (now.foreign and (node is None or node.foreign)):
                pieces.append((now, None))
            if node and node.parent and not (tag in INLINE and _crosses_block(now, node)):
                now = node.parent
            continue
        if tag in RAW:
            if not attributes.endswith("/"):  # what is within is no markup: only its own closing tag ends it
                end = _CLOSING[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in UNENDING:
                    at = len(page)
            continue
        if tag == "br":
            pieces.append((now, " "))
        if tag in VOID:
            if tag == "hr":
                pieces.append((now, None))
            continue
        if tag in ENDS_P:
            now = _close(now, ("p",), ENDS_P - {"p"}) or now
        elif tag in SIBLINGS:
            now = _close(now, SIBLINGS[tag], {"ul", "ol", "dl", "table"}) or now
        block = tag not in INLINE and tag not in FOREIGN and not (now.foreign and tag != "foreignobject")
        if block:
            pieces.append((now, None))
        if tag == "html":
            continue
        tokens = attribute_tokens(attributes) if attributes else ()
        now = Node(tag, now, tokens, block)
        if attributes.endswith("/") and tag not in ("a", "p", "div"):
            now = now.parent
    text(len(page))
    return root, pieces


def _crosses_block(now: Node, upto: Node) -> bool:
    while now is not upto:
        if now.block:
            return True
        now = now.parent
    return False


def _close(now: Node, tags: tuple[str, ...], stop: frozenset[str] | set[str]) -> Node | None:
    """The parent of the nearest open element of the tags, looked for up to the stops."""
    node = now
    while node and node.tag not in stop:
        if node.tag in tags:
            return node.parent
        node = node.parent
    return None


_WIDTH = 3 * BUCKETS + 2 * (len(TAGS) + 1) + 14
_TAG = {t: i for i, t in enumerate(TAGS)}


def describe(root: Node, pieces: list[tuple[Node, str | None]]) -> tuple[list[Node], np.ndarray]:
    """The nodes to be labelled, parents first, and their features."""
    nodes: list[Node] = []
    stack = [root]
    order: list[Node] = []
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(reversed(n.children))
        if n.block or n.tokens:
            n.node = len(nodes)
            nodes.append(n)
    for n, t in pieces:
        if t is not None:
            k = len(t)
            n.chars += k
            n.words += t.count(" ") + 1
            n.marks += t.count(".") + t.count(",") + t.count(";") + t.count("?")
            if n.tag == "a" or (n.parent and n.parent.tag == "a"):
                n.link_chars += k
    paragraphs = {}
    for n in reversed(order):
        paragraphs[n] = paragraphs.get(n, 0) + (n.tag == "p")
        if n.parent:
            p = n.parent
            p.chars += n.chars
            p.words += n.words
            p.marks += n.marks
            p.link_chars += n.link_chars
            p.tags += n.tags + 1
            paragraphs[p] = paragraphs.get(p, 0) + paragraphs[n]
    x = np.zeros((len(nodes), _WIDTH), np.float32)
    total = max(1, root.chars)
    place: dict[Node, int] = {}
    alike: dict[Node, collections.Counter[str]] = {}
    for n in order:
        place.update(zip(n.children, range(len(n.children)), strict=True))
        alike[n] = collections.Counter(m.tag for m in n.children)
    above: dict[Node, frozenset[int]] = {}
    for i, n in enumerate(nodes):
        row, p = x[i], n.parent
        for t in n.tokens:
            row[t] = 1
        seen = above.get(p, frozenset()) | frozenset(p.tokens) if p else frozenset()
        above[n] = seen
        q = p
        while q and q.node < 0:  # inline elements pass on what is above them
            q = q.parent
        for t in above.get(q, frozenset()) | frozenset(q.tokens) if q else ():
            row[BUCKETS + t] = 1
        above[n] = (above.get(q, frozenset()) | frozenset(q.tokens)) if q else frozenset()
        mates = p.children if p else [n]
        k = place.get(n, 0)
        for m in (mates[k - 1] if k else None, mates[k + 1] if k + 1 < len(mates) else None):
            if m is not None:
                for t in m.tokens:
                    row[2 * BUCKETS + t] = 1
        o = 3 * BUCKETS
        row[o + _TAG.get(n.tag, len(TAGS))] = 1
        o += len(TAGS) + 1
        row[o + (_TAG.get(q.tag, len(TAGS)) if q else len(TAGS))] = 1
        o += len(TAGS) + 1
        chars = n.chars or 1
        row[o : o + 14] = (
            n.depth,
            len(mates),
            k / len(mates),
            alike[p][n.tag] / len(mates) if p else 1,
            np.log1p(n.chars),
            n.chars / total,
            n.link_chars / chars,
            n.tags / chars,
            n.marks / max(1, n.words),
            np.log1p(n.words),
            paragraphs[n],
            len(n.children),
            np.log1p(p.chars - n.chars) if p else 0,
            n.chars / max(1, n.tags + 1),
        )
    return nodes, x


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The labelling with the greatest sum of log-odds in which what is under a False node is False."""
    best = [max(-30.0, min(30.0, float(o))) for o in odds]
    none = [0.0] * len(nodes)
    up = []
    for n in nodes:
        p = n.parent
        while p and p.node < 0:
            p = p.parent
        up.append(p.node if p else -1)
    for i in range(len(nodes) - 1, 0, -1):
        if up[i] >= 0:
            best[up[i]] += max(best[i], none[i])
    keep = [False] * len(nodes)
    for i in range(len(nodes)):
        keep[i] = best[i] > 0 and (up[i] < 0 or keep[up[i]])
    return keep


def blocks(pieces: list[tuple[Node, str | None]], keep: list[bool]) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    inside: dict[Node, bool] = {}

    def flush() -> None:
        if held:
            done = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if done:
                out.append(done)

    for n, t in pieces:
        if t is None:
            flush()
            continue
        ok = inside.get(n)
        if ok is None:
            q = n
            while q.node < 0:
                q = q.parent
            ok = inside[n] = keep[q.node]
        if ok:
            held.append(t)
    flush()
    return out


class Boosted:
    """Boosted regression trees of a fixed depth: for each tree and inner place a feature and a threshold, for each leaf a value."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value
        self.depth = int(np.log2(value.shape[1]))

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (len(v) - 1)]
        return out

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.25, bins: int = 12, ridge: float = 2.0, part: float = 0.3, seed: int = 1) -> Boosted:
        """Newton boosting of the logistic loss, on histograms of a seeded part of the features in each round."""
        draw = np.random.default_rng(seed)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        cuts = [c if x[:, j].max() > 1 or len(c) > 1 else np.array([0.5]) for j, c in enumerate(cuts)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        width = bins + 1
        n = int(part * x.shape[1])
        base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        odds = np.full(len(y), base)
        features, thresholds, values = [], [], []
        for _ in range(rounds):
            some = np.sort(draw.choice(x.shape[1], n, replace=False))
            flat = binned[:, some] + np.arange(n) * width
            p = 1 / (1 + np.exp(-odds))
            g, h = y - p, p * (1 - p) + 1e-9
            at = np.zeros(len(y), np.int64)
            f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(at == node)
                    if len(rows) >= 8:
                        cells = flat[rows].ravel()
                        gl = np.bincount(cells, np.repeat(g[rows], n), n * width).reshape(n, width).cumsum(1)[:, :-1]
                        hl = np.bincount(cells, np.repeat(h[rows], n), n * width).reshape(n, width).cumsum(1)[:, :-1]
                        gs, hs = g[rows].sum(), h[rows].sum()
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        j, b = divmod(int(gain.argmax()), width - 1)
                        if gain[j, b] > 1e-6 and b < len(cuts[some[j]]):
                            f[node], t[node] = some[j], cuts[some[j]][b]
                    at[rows] = 2 * node + 1 + (x[rows, f[node]] > t[node])
            leaf = at - (2**depth - 1)
            v = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
            odds += v[leaf]
            features.append(f)
            thresholds.append(t)
            values.append(v)
        return cls(base, np.array(features), np.array(thresholds), np.array(values))


# Names that page authors give to parts of a page.
_PAGE_NAMES = "content article post entry main story body text page copy prose read lead".split()
_OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs links toc tabs topbar".split(),
    "header": "header masthead top brand logo site banner hero".split(),
    "footer": "footer bottom foot copyright legal imprint colophon".split(),
    "aside": "sidebar aside related widget recommended popular trending more share social author tags rail".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense native".split(),
    "notice": "notice cookie consent gdpr alert popup modal overlay newsletter subscribe paywall announcement warning message".split(),
    "comments": "comments comment reply replies discussion disqus responses thread feedback reviews".split(),
    "form": "form search login signup contact poll".split(),
}


def training_page(r: random.Random) -> str:
    """A page whose main text's words begin with 'm' and all others' with 'x'."""

    def say(first: str, least: int, most: int) -> str:
        out = []
        for i in range(r.randint(least, most)):
            w = first + "".join(r.choice("aeiorstln") for _ in range(r.randint(1, 8)))
            out.append(w + ("." if r.random() < 0.08 else "," if r.random() < 0.06 else ""))
        return " ".join(out)

    def named(kind: str) -> str:
        parts = [r.choice(_OTHER_NAMES[kind])]
        if r.random() < 0.4:
            parts.append(r.choice("box wrap wrapper list item block inner container left right small wide".split()))
        text = r.choice("-_ ").join(parts)
        return r.choice([f' class="{text}"', f' id="{text}"', f' class="{text} {r.choice("a1 js col-3 hidden-xs".split())}"'])

    def links(n: int) -> str:
        items = [f'<a href="/{i}">{say("x", 1, 3)}</a>' for i in range(n)]
        return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"])

    def other(kind: str) -> str:
        long = lambda: "".join(f"<p>{say('x', 3, 40)}</p>" for _ in range(r.randint(1, 3)))
        body = {
            "nav": lambda: links(r.randint(2, 12)),
            "header": lambda: r.choice([f"<h1>{say('x', 1, 4)}</h1>", f"<div>{say('x', 1, 5)}</div>"]) + (links(3) if r.random() < 0.4 else ""),
            "footer": lambda: r.choice([f"&copy; {say('x', 1, 8)}", f"<p>{say('x', 2, 20)}</p>" + links(3), say("x", 2, 15)]),
            "aside": lambda: r.choice([f"<h3>{say('x', 1, 3)}</h3>" + links(5), long(), f"<h4>{say('x', 1, 3)}</h4>" + long()]),
            "ad": lambda: r.choice([say("x", 2, 25), f"<p>{say('x', 2, 25)}</p>", f'<a href="#">{say("x", 2, 8)}</a> {say("x", 2, 20)}']),
            "notice": lambda: r.choice([f"<p>{say('x', 4, 30)}</p><button>{say('x', 1, 2)}</button>", say("x", 4, 25)]),
            "comments": lambda: r.choice(["", f"<h3>{say('x', 1, 3)}</h3>"]) + "".join(f'<{t}{r.choice(["", " class=" + chr(34) + "comment" + chr(34)])}><p>{say("x", 2, 50)}</p></{t}>' for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 5))),
            "form": lambda: f"<label>{say('x', 1, 3)}</label><input><button>{say('x', 1, 2)}</button>" + (f"<p>{say('x', 2, 15)}</p>" if r.random() < 0.4 else ""),
        }[kind]()
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind)
        if own and kind != "comments" and r.random() < 0.6:
            return f"<{own}{named(kind) if r.random() < 0.4 else ''}>{body}</{own}>"
        tag = r.choice(["div", "section", "aside", "div"]) if kind not in ("form",) else "div"
        return f"<{tag}{named(kind)}>{body}</{tag}>"

    def block() -> str:
        kind = r.random()
        if kind < 0.72:
            return f"<p>{say('m', 1, r.choice([6, 6, 40, 110]))}" + r.choice(["</p>", "</p>", "</p>", ""])
        if kind < 0.78:
            return f"<p><b>{say('m', 2, 20)}.<br>" + r.choice(["", f"<p>{say('m', 2, 60)}</p>"])
        if kind < 0.84:
            return f"<h{(k := r.randint(2, 4))}>{say('m', 1, 7)}</h{k}>"
        if kind < 0.89:
            return f"<blockquote><p>{say('m', 4, 30)}</p></blockquote>"
        if kind < 0.94:
            return "<ul>" + "".join(f"<li>{say('m', 2, 16)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.97:
            return f"<div>{say('m', 4, 60)}</div>"
        return "<table>" + "".join(f"<tr><td>{say('m', 1, 4)}</td><td>{say('m', 1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"

    kinds = list(_OTHER_NAMES)
    body = [block() for _ in range(r.choice([1, 1, 1, 2, 4, 8, 14]))]
    if r.random() < 0.8:
        body.insert(0, f"<h1>{say('m', 1, 12)}</h1>")
    for _ in range(r.choice([0, 0, 0, 1, 2])):
        body.insert(r.randint(0, len(body)), other(r.choice(["ad", "aside", "notice", "form", "comments"])))
    names = " ".join(r.sample(_PAGE_NAMES, r.randint(1, 2)))
    held = r.choice([("article", ""), ("article", ""), ("main", ""), ("div", f' class="{names}"'), ("div", f' id="{names.split()[0]}"'), ("section", f' class="{names}"'), ("article", f' class="{names}"')])
    main = f"<{held[0]}{held[1]}>{''.join(body)}</{held[0]}>"
    for _ in range(r.choice([0, 0, 1, 2])):
        main = r.choice([f"<div>{main}</div>", f'<div class="{r.choice("wrapper container row page layout site".split())}">{main}</div>', f"<main>{main}</main>"])
    before = [other(r.choice(["nav", "header", "ad", "notice", "nav", "form"])) for _ in range(r.randint(0, 3))]
    after = [other(r.choice([*kinds, "footer", "comments", "aside"])) for _ in range(r.randint(0, 4))]
    if r.random() < 0.15:
        main, before, after = f'<div class="wrapper">{"".join(before)}{main}{"".join(after)}</div>', [], []
    return f"<html><head><title>{say('x', 1, 6)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


def labels(nodes: list[Node], pieces: list[tuple[Node, str | None]]) -> np.ndarray:
    y = np.zeros(len(nodes))
    for n, t in pieces:
        if t and t.lstrip()[:1] == "m":
            q = n
            while q:
                if q.node >= 0:
                    y[q.node] = 1
                q = q.parent
    return y


@functools.lru_cache(maxsize=1)
def model(pages: int = 600, seed: int = 7) -> Boosted:
    """Trained when first asked for, from the seed alone."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        root, pieces = parse(training_page(r))
        nodes, x = describe(root, pieces)
        xs.append(x)
        ys.append(labels(nodes, pieces))
    return Boosted.train(np.concatenate(xs), np.concatenate(ys))


def extract_all(pages: list[str | None], boosted: Boosted) -> list[str]:
    parsed = [parse(p) if p else None for p in pages]
    described = [describe(*p) if p else None for p in parsed]
    some = [d[1] for d in described if d]
    odds = boosted.odds(np.concatenate(some)) if some else np.zeros(0)
    out, at = [], 0
    for p, d in zip(parsed, described, strict=True):
        if not d:
            out.append("")
            continue
        own = odds[at : at + len(d[0])]
        at += len(d[0])
        if len(d[0]) == 1:  # no markup
            own = np.ones(1)
        out.append("\n\n".join(blocks(p[1], decode(d[0], own))))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_once: int = 200) -> DataFrame:
    """page_id, url, text for every row."""
    boosted = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, at_once):
                part = b.slice(k, at_once)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(extract_all(part.column(2).to_pylist(), boosted), pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(run, "page_id long, url string, text string")
