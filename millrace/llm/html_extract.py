"""Operator 3: main text of web pages, by gradient-boosted trees over DOM nodes."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, table

# ---------------------------------------------------------------- document tree

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_MAIN = "data-main"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in these is no markup: they end at their own end tag alone.
RAW = frozenset("script style textarea title iframe xmp noembed".split())
#: Drawings, formulas and choices: blocks of the page can't stand in them, so they end where one begins.
ISLANDS = frozenset("svg math select".split())
#: Never part of a page's text.
SILENT = RAW | ISLANDS | frozenset("noscript template object head button canvas audio video datalist map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr".split())
#: Blocks without a break of their own: their text runs on in the surrounding block after a space.
CELLS = frozenset(("td", "th", "br", "img", "input", "wbr"))
_CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",))}
_END_OF = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: Within these a slash closes an element.
_DRAWN = frozenset("svg math g defs symbol clippath lineargradient mask pattern marker".split())
_HEAD_ONLY = frozenset("head meta title link base style script noscript".split())


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attrs: frozenset[str] = frozenset()
    #: Children in page order: text, or the number of a node.
    parts: list = field(default_factory=list)


def _tokens(attrs: str) -> frozenset[str]:
    out: list[str] = []
    for name, *values in _ATTR.findall(attrs):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label", "data-role", "data-component", "name"):
            out += [t.lower() for t in _TOKEN.findall("".join(values))]
        if name.lower() == _MAIN:
            out.append(_MAIN)
        if name.lower() in ("hidden", "aria-hidden"):
            out.append("hidden")
    return frozenset(out)


def parse(page: str) -> list[Node]:
    """Nodes in page order, each after its parent; the first is the root.  Missing end tags are implied, stray ones
    ignored, and what is open at the end is closed."""
    nodes = [Node("#root", -1, 0)]
    stack = [0]
    at = 0

    def close(upto: int) -> None:
        del stack[upto:]

    find = _TAG.search
    while at < len(page):
        m = find(page, at)
        if not m:
            nodes[stack[-1]].parts.append(page[at:])
            break
        if m.start() > at:
            nodes[stack[-1]].parts.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ending, attrs = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if ending:
            for i in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[i]].tag
                if open_tag == tag:
                    close(i)
                    break
                if tag in INLINE and open_tag not in INLINE:
                    break
            continue
        if tag not in _HEAD_ONLY and nodes[stack[-1]].tag == "head":
            close(len(stack) - 1)
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag in ISLANDS:
                    close(i)
                    break
                if nodes[stack[i]].tag in _CLOSES_P:
                    break
            for i in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[i]].tag
                if open_tag == "p":
                    close(i)
                    break
                if open_tag not in INLINE:
                    break
        if tag in _SIBLINGS:
            like, within = _SIBLINGS[tag]
            cut_at = 0
            for i in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[i]].tag
                if open_tag in within:
                    break
                if open_tag in like:
                    cut_at = i
            if cut_at:
                close(cut_at)
        if tag in ("html", "body") and any(n.tag == tag for n in nodes):
            continue
        k = len(nodes)
        nodes.append(Node(tag, stack[-1], len(stack), _tokens(attrs) if attrs else frozenset()))
        nodes[stack[-1]].parts.append(k)
        closed = bool(attrs) and attrs.rstrip().endswith("/")
        if tag in RAW:
            # one without an end holds nothing, but for a script or a style, which is code up to the page's end
            end = _END_OF[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style") and not closed:
                at = len(page)
        elif tag not in VOID and not (closed and (tag in ISLANDS or nodes[stack[-1]].tag in _DRAWN or tag in SILENT)):
            stack.append(k)
    return nodes


# ---------------------------------------------------------------- features

TAGS = ("div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "nav", "header", "footer", "aside", "article", "main", "section", "form", "table", "tr", "td", "a", "span", "blockquote", "pre", "figure", "figcaption", "dl", "fieldset", "details", "dialog", "address", "menu", "label", "small", "body")
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_END = re.compile(r"[.!?;:,]")
NUMBERS = ("depth", "chars", "words", "links", "link_chars", "tags", "density", "marks", "paragraphs", "items", "inputs", "images", "mean_block", "page_share", "parent_share", "place", "siblings", "alike", "before_share", "after_share", "first_tag", "last_tag", "heads", "copyright", "colon", "own_chars", "children", "digits", "in_article", "in_boiler")
_BOILER_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog"))


def judged(n: Node) -> bool:
    """Nodes that get a label of their own; plain inline ones go with their parent."""
    return n.tag not in SILENT and n.tag not in VOID and (n.tag not in INLINE or bool(n.attrs))


def features(nodes: list[Node], tokens: dict[str, int]) -> tuple[list[int], np.ndarray]:
    """Numbers of the judged nodes, and their features: subtree sums and densities, place among siblings, tag, and
    attribute tokens of the node and of its ancestors."""
    n = len(nodes)
    sums = np.zeros((n, 13))  # chars words links link_chars tags marks paragraphs items inputs images blocks heads digits
    own, special = np.zeros(n), np.zeros((n, 2))
    in_link = [False] * n
    for k, x in enumerate(nodes):
        in_link[k] = x.tag == "a" or (x.parent >= 0 and in_link[x.parent])
    for k in range(n - 1, -1, -1):
        x, s = nodes[k], sums[k]
        if x.tag in SILENT:
            s[:] = 0
            s[8] += x.tag in ("button", "select", "textarea")
            s[9] += x.tag in ("iframe", "video", "svg")
        else:
            text = "".join(p for p in x.parts if isinstance(p, str))
            if text and not text.isspace():
                c = len(text) - text.count(" ") // 8
                s[0] += c
                s[1] += len(text.split())
                s[3] += c if in_link[k] else 0
                s[5] += len(_END.findall(text))
                s[12] += sum(map(str.isdigit, text))
                own[k] = c
                low = text.lower()
                special[k] = ("©" in low or "&copy" in low or "copyright" in low, text.rstrip().endswith(":"))
            s[2] += x.tag == "a"
            s[4] += 1
            s[6] += x.tag == "p"
            s[7] += x.tag == "li"
            s[8] += x.tag in ("input", "label")
            s[9] += x.tag == "img"
            s[10] += x.tag not in INLINE and x.tag not in VOID and own[k] > 0
            s[11] += x.tag in ("h1", "h2", "h3")
        if x.parent >= 0:
            sums[x.parent] += s
            special[x.parent, 0] = max(special[x.parent, 0], special[k, 0])
    kids: list[list[int]] = [[p for p in x.parts if isinstance(p, int) and judged(nodes[p])] for x in nodes]
    use = [k for k in range(1, n) if judged(nodes[k])]
    out = np.zeros((len(use), len(NUMBERS) + 2 * len(TAGS) + 2 * len(tokens)), np.float32)
    row = {k: i for i, k in enumerate(use)}
    total = max(1.0, sums[0, 0])
    seen, spot = np.zeros(n), [0] * n
    like: list[dict[str, int]] = [{}] * n
    marked: list[tuple[bool, bool]] = [(False, False)] * n
    named: list[frozenset] = [frozenset()] * n
    for p, own_kids in enumerate(kids):
        have = 0.0
        if own_kids:
            like[p] = {}
        for i, k in enumerate(own_kids):
            seen[k], spot[k] = have, i
            have += sums[k, 0]
            like[p][nodes[k].tag] = like[p].get(nodes[k].tag, 0) + 1
    for k, x in enumerate(nodes):
        if k == 0:
            continue
        pa = x.parent
        marked[k] = (marked[pa][0] or x.tag in ("article", "main"), marked[pa][1] or x.tag in _BOILER_TAGS)
        named[k] = named[pa] | x.attrs if x.attrs else named[pa]
        if k not in row:
            continue
        s, brothers, i, mates = sums[k], kids[pa], spot[k], like[pa][x.tag]
        parent_chars = max(1.0, sums[pa, 0])
        after = max(0.0, parent_chars - seen[k] - s[0])
        f = out[row[k]]
        f[: len(NUMBERS)] = (
            x.depth, math.log1p(s[0]), math.log1p(s[1]), math.log1p(s[2]), s[3] / max(1.0, s[0]), math.log1p(s[4]), math.log1p(s[0] / max(1.0, s[4])), s[5] / max(1.0, s[1]),
            math.log1p(s[6]), math.log1p(s[7]), min(s[8], 5), min(s[9], 5), math.log1p(s[1] / max(1.0, s[10])), s[0] / total, s[0] / parent_chars, i / max(1, len(brothers)), math.log1p(len(brothers)), math.log1p(mates),
            seen[k] / parent_chars, after / parent_chars, _TAG_AT.get(nodes[brothers[i - 1]].tag, -1) if i else -2, _TAG_AT.get(nodes[brothers[i + 1]].tag, -1) if i + 1 < len(brothers) else -2, s[11], special[k, 0], special[k, 1], math.log1p(own[k]), len(kids[k]), s[12] / max(1.0, s[0]), marked[pa][0], marked[pa][1],
        )
        base = len(NUMBERS)
        if (j := _TAG_AT.get(x.tag, -1)) >= 0:
            f[base + j] = 1
        if (j := _TAG_AT.get(nodes[pa].tag, -1)) >= 0:
            f[base + len(TAGS) + j] = 1
        base += 2 * len(TAGS)
        for t in x.attrs:
            if (j := tokens.get(t, -1)) >= 0:
                f[base + j] = 1
        for t in named[pa]:
            if (j := tokens.get(t, -1)) >= 0:
                f[base + len(tokens) + j] = 1
    return use, out


# ---------------------------------------------------------------- boosted trees


@dataclass
class Boosted:
    """Complete binary trees of one depth: at each inner node a feature and a threshold, at each leaf a value."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    tokens: dict[str, int] = field(default_factory=dict)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, depth = np.arange(len(x)), int(math.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (v.size - 1)]
        return out

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 6, rate: float = 0.2, bins: int = 12, l2: float = 2.0, columns: float = 0.15, rows: float = 0.5, seed: int = 4) -> Boosted:
        """Logistic loss, second-order gains over quantile bins, level by level; each tree sees a share of the features and rows."""
        n, every = x.shape
        rng, d = np.random.default_rng(seed), max(1, int(columns * x.shape[1]))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(np.unique(x[:, j])) > bins else np.unique(x[:, j])[:-1] for j in range(every)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int32)
        mean = y.mean()
        start = float(np.log(mean / (1 - mean)))
        score = np.full(n, start)
        fs, ts, vs = [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            at = np.zeros(n, np.int64)
            cols = np.sort(rng.permutation(every)[:d])
            drawn = rng.random(n) < rows
            flat, g1, h1 = (binned[drawn][:, cols] + np.arange(d) * bins), np.repeat(g[drawn], d), np.repeat(h[drawn], d)
            feat, thr = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                m = 2**level
                key = (flat + (at[drawn] * d * bins)[:, None]).ravel()
                gs = np.bincount(key, g1, m * d * bins).reshape(m, d, bins).cumsum(axis=2)
                hs = np.bincount(key, h1, m * d * bins).reshape(m, d, bins).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                best = gain.reshape(m, -1).argmax(axis=1)
                go = np.zeros(n, bool)
                for i in range(m):
                    j, b = divmod(int(best[i]), bins)
                    gained, j = gain[i, j, b], int(cols[j])
                    if gained <= 1e-6 or b >= len(edges[j]):
                        continue
                    feat[m - 1 + i], thr[m - 1 + i] = j, edges[j][b]
                    mine = at == i
                    go[mine] = binned[mine, j] > b
                at = 2 * at + go
            leaf_g, leaf_h = np.bincount(at, g, 2**depth), np.bincount(at, h, 2**depth)
            value = -rate * leaf_g / (leaf_h + l2)
            score += value[at]
            fs.append(feat)
            ts.append(thr)
            vs.append(value)
        return Boosted(start, np.array(fs), np.array(ts), np.array(vs))


def decode(nodes: list[Node], use: list[int], logit: np.ndarray) -> list[bool]:
    """Which nodes are kept: the labelling of greatest likelihood in which everything below a dropped node is
    dropped, so no ancestor contradicts a descendant.  Sums from the leaves up decide each node; choices then go
    down from the root."""
    n = len(nodes)
    keep, drop = np.zeros(n), np.zeros(n)
    yes = dict(zip(use, (-np.logaddexp(0, -logit)).tolist(), strict=True))
    no = dict(zip(use, (-np.logaddexp(0, logit)).tolist(), strict=True))
    for k in range(n - 1, 0, -1):
        keep[k] += yes.get(k, 0.0)
        drop[k] += no.get(k, 0.0)
        p = nodes[k].parent
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    out = [False] * n
    out[0] = True
    for k in range(1, n):
        x = nodes[k]
        out[k] = out[x.parent] and x.tag not in SILENT and (keep[k] > drop[k] if k in yes else True)
    return out


def text_of(nodes: list[Node], kept: list[bool]) -> str:
    """Text of the kept nodes: a line for each block, its white space as single spaces, character references decoded."""
    lines: list[str] = []
    now: list[str] = []

    def flush() -> None:
        line = " ".join(html.unescape("".join(now)).split())
        if line:
            lines.append(line)
        now.clear()

    stack: list[tuple[int, int]] = [(0, 0)]
    while stack:
        k, i = stack.pop()
        x = nodes[k]
        block = x.tag not in INLINE and x.tag not in CELLS
        if i == 0:
            if block:
                flush()
            elif x.tag in CELLS:
                now.append(" ")
        while i < len(x.parts):
            p = x.parts[i]
            i += 1
            if isinstance(p, str):
                now.append(p)
            elif kept[p]:
                stack += [(k, i), (p, 0)]
                break
        else:
            if block:
                flush()
            elif x.tag in CELLS:
                now.append(" ")
    flush()
    return "\n".join(lines)


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """Main texts; empty for null and for pages without any."""
    trees = [parse(p or "") for p in pages]
    parts = [features(t, model.tokens) for t in trees]
    logit = model.logit(np.concatenate([f for _, f in parts])) if parts else np.zeros(0)
    out, at = [], 0
    for nodes, (use, f) in zip(trees, parts, strict=True):
        out.append(text_of(nodes, decode(nodes, use, logit[at : at + len(f)])))
        at += len(f)
    return out


PAGES_AT_A_TIME = 256


@lru_cache(maxsize=1)
def trained() -> Boosted:
    """Trees fitted on pages made by :mod:`html_training`, whose nodes carry their labels."""
    from .html_training import labelled_pages

    return fit(labelled_pages())


def fit(pages: list[str], min_count: int = 6) -> Boosted:
    """``pages``: html whose elements of main text carry the attribute ``data-main``; what holds one is kept."""
    trees, labels = [], []
    for page in pages:
        nodes = parse(page)
        marks = [_MAIN in x.attrs for x in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            if marks[k]:
                marks[nodes[k].parent] = True
            nodes[k].attrs -= {_MAIN}
        trees.append(nodes)
        labels.append(marks)
    count: dict[str, int] = {}
    for nodes in trees:
        for t in {t for x in nodes for t in x.attrs}:
            count[t] = count.get(t, 0) + 1
    tokens = {t: i for i, t in enumerate(sorted(t for t, c in count.items() if c >= min_count))}
    xs, ys = [], []
    for nodes, marks in zip(trees, labels, strict=True):
        use, f = features(nodes, tokens)
        xs.append(f)
        ys.append(np.array([marks[k] for k in use], float))
    model = Boosted.fit(np.concatenate(xs), np.concatenate(ys))
    model.tokens = tokens
    return model


def with_text(pages: DataFrame, html_col: str = "html", out_col: str = "_text", model: Boosted | None = None) -> DataFrame:
    """Add ``_text``, the main text of each page; empty for null or empty pages and pages without main text.

    Pages of any length are parsed whole.  All rows and columns are kept; nothing is shuffled.
    """
    held = Shipped(pages.sparkSession, model or trained())

    @F.pandas_udf("string")
    def run(htmls: pd.Series) -> pd.Series:
        m, rows = held.value, htmls.to_list()
        out: list[str] = []
        for i in range(0, len(rows), PAGES_AT_A_TIME):
            out += extract(rows[i : i + PAGES_AT_A_TIME], m)
        return pd.Series(out, index=htmls.index, dtype=object)

    return pages.withColumn(out_col, run(F.col(html_col)))


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    """Every page's main text and its number of characters."""
    out = with_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
