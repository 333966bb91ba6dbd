"""Main text of web pages by gradient-boosted trees over DOM nodes with hierarchical decoding.

A page becomes a tree of its block elements. Each gets features of its subtree (text and link density, paragraphs), its
tag and attribute tokens, its depth and its siblings. Boosted trees give each node a score for three states: outside (it
may hold the article), main (it is of the article) and waste. The decoding takes the best labelling of the whole tree in
which outside may lead to anything, main only to main or waste, and waste only to waste, so a choice for a node never
contradicts one for its ancestors or descendants.

The trees are fitted on a bounded sample of pages, those first that mark their article themselves (``article`` or ``main``).
Of pages that don't, the article is taken to be the innermost element that holds most of the page's text outside links. The
sample's copies are varied: containers get other tags and attributes, in some copies all telling tags become ``div`` without
a name, and blocks of the kinds that surround articles elsewhere (menus, comments, notices, forms and so on) are put in, so
the model knows layouts that the sample itself lacks.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import texts

#: Pages that the trees are fitted on (those with the smallest hashes), varied copies of each, boosting rounds, depth,
#: learning rate, and candidate splits of a feature.
FIT_PAGES, COPIES, ROUNDS, DEPTH, RATE, SPLITS = 100, 4, 20, 4, 0.3, 12
#: Bytes of a page that the trees may be fitted on, so that the driver gets so many pages of a bounded size.
FIT_BYTES = 256 << 10
SEED = 42
OUTSIDE, MAIN, WASTE = 0, 1, 2

# HTML's elements by kind.
SKIPPED = frozenset("script style head template noscript iframe svg object select textarea button canvas audio video title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: Starting one of these closes an open element of its group, up to the element that bounds it.
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Elements of text.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre blockquote figcaption caption".split())

RAW = frozenset("script style textarea title noscript template iframe svg".split())
NAME = re.compile(r"/?([a-z][a-z0-9:-]*)", re.I)
#: The rest of a tag, in which a quoted ">" doesn't end it, and the same where quotes are broken. Both never go back.
REST, LOOSE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"), re.compile("[^>]*+>")
ATTR = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
TAGS = "html body div section article main nav aside header footer form p ul ol li h1 h2 h3 h4 table tr td blockquote figure dl".split()
#: Hashed attribute tokens.
TOKENS = 64


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset[int]
    index: int = 0
    children: list[int] = field(default_factory=list)
    links: int = 0
    mark: str = ""


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before it, name, whether it ends an element, attributes) of each tag in page order, and the last text without a
    name. Comments, declarations and the contents of raw elements have no name. Passes over a page once, however broken."""
    at = look = 0  # where the text so far begins, and where the next tag may
    rest, low = REST, page.lower()
    if len(low) != len(page):  # a few letters grow in lower case
        low = "".join(c.lower() if c.isascii() else c for c in page)
    last = page.rfind(">")
    while (begin := page.find("<", look)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            yield page[at:begin], "", False, ""
            at = look = len(page) if end < 0 else end + 3
            continue
        if begin > last:  # no tag ends any more
            break
        name = NAME.match(page, begin + 1)
        if name is None:
            look = begin + 1
            if page[look : look + 1] in ("!", "?", "/"):
                yield page[at:begin], "", False, ""
                at = look = page.index(">", look) + 1
            continue
        end = rest.match(page, name.end())
        if end is None:  # quotes don't close: from here on they are characters like any other
            rest = LOOSE
            end = rest.match(page, name.end())
        tag, ends = name[1].lower(), page[begin + 1] == "/"
        stop = end.end()
        if tag in RAW and not ends and not page.endswith("/", 0, stop - 1):
            close = low.find("</" + tag, stop)
            yield page[at:begin], "", False, ""
            close = len(page) if close < 0 else page.find(">", close)
            at = look = len(page) if close < 0 else close + 1
            continue
        yield page[at:begin], tag, ends, page[name.end() : stop - 1]
        at = look = stop
    yield page[at:], "", False, ""


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(block elements in page order, texts with the element each is in). Text in skipped elements is left out, inline
    elements only count as link text, a line break is a space, and elements that HTML lets end by themselves do."""
    nodes = [Node("#", -1, 0, frozenset())]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("#", 0)]  # open elements with the block element that text in them belongs to
    open_: Counter[str] = Counter()
    link, skip = 0, 0

    def text(s: str) -> None:
        if s and not skip:
            here = stack[-1][1]
            runs.append((here, s))
            if link:
                nodes[here].links += len(s)

    def close(tag: str) -> None:
        nonlocal link, skip
        while True:
            name, _ = stack.pop()
            open_[name] -= 1
            link -= name == "a"
            skip -= name in SKIPPED
            if name == tag:
                return

    for before, tag, ends, attrs in tokens(page):
        text(before)
        if not tag:
            continue
        if ends:
            if open_[tag]:
                close(tag)
            continue
        if tag in CLOSES_P and open_["p"]:
            for name, _ in reversed(stack):
                if name == "p":
                    close("p")
                    break
                if name not in INLINE:
                    break
        if tag in SAME and any(open_[name] for name in SAME[tag][0]):
            group, bound = SAME[tag]
            for name, _ in reversed(stack):
                if name in group:
                    close(name)
                    if tag != "tr" or name == "tr":
                        break
                elif name in bound:
                    break
        if tag in VOID:
            text(" ")
            continue
        if tag in INLINE:
            if not attrs.endswith("/"):
                stack.append((tag, stack[-1][1]))
                open_[tag] += 1
                link += tag == "a"
            continue
        parent = stack[-1][1]
        names = frozenset(zlib.crc32(w.encode()) % TOKENS for g in ATTR.findall(attrs) for x in g for w in PARTS.findall(x.lower())) if attrs else frozenset()
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, names, len(nodes[parent].children)))
        if "data-" in attrs:  # marks of varied copies
            nodes[-1].mark = "waste" if "data-waste" in attrs else "main" if "data-main" in attrs else ""
        nodes[parent].children.append(len(nodes) - 1)
        if not attrs.endswith("/"):
            stack.append((tag, len(nodes) - 1))
            open_[tag] += 1
            skip += tag in SKIPPED
    return nodes, runs


def features(nodes: list[Node], runs: list[tuple[int, str]]) -> np.ndarray:
    """(nodes x features): see the module's text."""
    n = len(nodes)
    own, stops = np.zeros(n), np.zeros(n)
    for i, s in runs:
        k = len(s.strip())
        own[i] += k
        stops[i] += s.count(".") + s.count(",")
    links = np.array([x.links for x in nodes], float)
    chars, link, marks, size = own.copy(), links.copy(), stops.copy(), np.ones(n)
    paragraphs = np.array([x.tag == "p" for x in nodes], float)
    parent = np.array([x.parent for x in nodes])
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        chars[p] += chars[i]
        link[p] += link[i]
        marks[p] += marks[i]
        size[p] += size[i]
        paragraphs[p] += paragraphs[i]
    up = np.maximum(parent, 0)
    total = max(chars[0], 1)
    siblings = np.array([len(nodes[x.parent].children) if x.parent >= 0 else 1 for x in nodes], float)
    index = np.array([x.index for x in nodes], float)
    before = np.concatenate([[0], np.cumsum(own)[:-1]])
    numbers = np.stack([
        np.array([x.depth for x in nodes], float), np.log1p(chars), chars / total, link / np.maximum(chars, 1), np.log1p(chars / size), marks / np.maximum(chars, 1) * 100,
        paragraphs, np.log1p(own), siblings, index / np.maximum(siblings - 1, 1), chars / np.maximum(chars[up], 1), np.log1p(chars[up]), link[up] / np.maximum(chars[up], 1), before / total, size,
    ], 1)
    tags = np.zeros((n, len(TAGS)), np.uint8)
    names = np.zeros((n, TOKENS), np.uint8)
    for i, x in enumerate(nodes):
        if x.tag in _TAG_AT:
            tags[i, _TAG_AT[x.tag]] = 1
        if x.tokens:
            names[i, list(x.tokens)] = 1
    # What the ancestors are called counts as well: the nearest with a name, handed down.
    above_tags, above_tokens = np.zeros_like(tags), np.zeros_like(names)
    for i in range(1, n):
        p = parent[i]
        above_tags[i] = above_tags[p]
        above_tokens[i] = above_tokens[p] if not nodes[p].tokens else names[p]
        above_tags[i] = np.maximum(above_tags[p], tags[p])
    return np.concatenate([x.astype(np.float32) for x in (numbers, tags, names, above_tags, above_tokens)], 1)


_TAG_AT = {t: i for i, t in enumerate(TAGS)}


# ------------------------------------------------------------------------------------------------------- boosted trees


@dataclass
class Trees:
    """For each state, trees as arrays: (tree x node) of a complete binary tree of DEPTH levels."""

    feature: np.ndarray  # state x tree x node
    split: np.ndarray
    leaf: np.ndarray
    bias: np.ndarray


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient-boosted trees, one against the rest for each of the three states, with a logistic loss."""
    states, inner, leaves = 3, 2**DEPTH - 1, 2**DEPTH
    feature, split = np.zeros((states, ROUNDS, inner), np.int64), np.full((states, ROUNDS, inner), np.inf)
    leaf, bias = np.zeros((states, ROUNDS, leaves)), np.zeros(states)
    levels = [np.unique(np.quantile(c, np.linspace(0, 1, SPLITS + 2)[1:-1])) if len(np.unique(c)) > 2 else np.unique(c)[1:] for c in x.T]
    binned = np.stack([np.searchsorted(v, c, "right") for v, c in zip(levels, x.T, strict=True)], 1) if len(x) else np.zeros(x.shape, int)
    bins = SPLITS + 1
    for s in range(states):
        target = (y == s).astype(float)
        rate = min(max(target.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        bias[s] = np.log(rate / (1 - rate))
        score = np.full(len(y), bias[s])
        for t in range(ROUNDS):
            prob = 1 / (1 + np.exp(-score))
            g, h = target - prob, prob * (1 - prob) + 1e-6
            at = np.zeros(len(y), np.int64)
            for d in range(DEPTH):
                base = 2**d - 1
                best = np.full(2**d, 1e-6)
                for k in range(x.shape[1]):
                    if not len(levels[k]):
                        continue
                    cell = at * bins + binned[:, k]
                    gs = np.cumsum(np.bincount(cell, g, 2**d * bins).reshape(-1, bins), 1)
                    hs = np.cumsum(np.bincount(cell, h, 2**d * bins).reshape(-1, bins), 1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain = gain[:, : len(levels[k])]
                    j = gain.argmax(1)
                    better = gain[np.arange(2**d), j] > best
                    best[better] = gain[np.arange(2**d), j][better]
                    feature[s, t, base : base + 2**d][better] = k
                    split[s, t, base : base + 2**d][better] = levels[k][j[better]]
                at = at * 2 + (x[np.arange(len(y)), feature[s, t, base + at]] >= split[s, t, base + at])
            leaf[s, t] = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
            score += leaf[s, t][at]
    return Trees(feature, split, leaf, bias)


def scores(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Log-probabilities (nodes x states), normalised over the states."""
    every = np.arange(len(x))
    out = np.tile(trees.bias, (len(x), 1)).astype(float)
    for s in range(3):
        for t in range(trees.feature.shape[1]):
            at = np.zeros(len(x), np.int64)
            for d in range(DEPTH):
                node = 2**d - 1 + at
                at = at * 2 + (x[every, trees.feature[s, t, node]] >= trees.split[s, t, node])
            out[:, s] += trees.leaf[s, t, at]
    out = -np.logaddexp(0, -out)
    return out - np.logaddexp.reduce(out, 1)[:, None]


def decode(nodes: list[Node], logp: np.ndarray) -> list[int]:
    """The best states of all nodes together. The root is outside, skipped elements are waste, and in the article plain
    elements of text without a name of their own stay."""
    n = len(nodes)
    score = logp.tolist()
    allowed = ((OUTSIDE, MAIN, WASTE), (MAIN, WASTE), (WASTE,))
    choice: list[tuple[int, int, int]] = [(0, 0, 0)] * n
    for i in range(n - 1, -1, -1):
        if nodes[i].tag in SKIPPED:
            score[i] = [-1e9, -1e9, score[i][WASTE]]
        a, b, c = score[i]
        follows = nodes[i].tag in TEXTUAL and not nodes[i].tokens
        picks = (max((OUTSIDE, MAIN, WASTE), key=(a, b, c).__getitem__), MAIN if follows or b >= c else WASTE, WASTE)
        choice[i] = picks
        p = nodes[i].parent
        if p >= 0:
            own = score[p]
            score[p] = [own[s] + score[i][picks[s]] for s in range(3)]
    states = [OUTSIDE] * n
    for i in range(1, n):
        states[i] = choice[i][states[nodes[i].parent]]
    return states


def main_text(nodes: list[Node], runs: list[tuple[int, str]], states: list[int]) -> str:
    """The texts of main elements in page order: references decoded, runs of white space one space, trimmed."""
    out: list[str] = []
    last = -1
    for i, s in runs:
        if states[i] == MAIN:
            out.append(s if i == last else " " + s)
            last = i
        elif states[i] != MAIN:
            last = -1
    return " ".join(html.unescape("".join(out)).split())


# ------------------------------------------------------------------------------------------------------------- training

# Names that layouts commonly give to the article and to what surrounds it, and tags that carry them.
ARTICLE_NAMES = "content entry-content post-content article-body story-body main-content post text body-copy articleBody".split()
WASTE_KINDS = {
    "nav": ("nav div ul", "menu navbar navigation breadcrumbs nav-links top-menu"),
    "header": ("header div", "header site-header masthead banner top-bar"),
    "footer": ("footer div", "footer site-footer colophon copyright bottom"),
    "side": ("aside div section", "sidebar widget related recommended side-column popular trending"),
    "notice": ("div section aside", "cookie-notice consent gdpr notice alert newsletter popup modal subscribe promo"),
    "ad": ("div aside section", "ad ads advert advertisement sponsored adsbygoogle banner-ad"),
    "form": ("form div", "search-form login signup contact-form form newsletter-form"),
    "comments": ("section div ol", "comments comment-list responses discussion disqus reader-comments comment"),
    "share": ("div ul", "share social share-buttons tags meta byline-links pagination"),
}


#: Pages that mark their article, and the share of the text that the article is taken to have over in those that don't.
MARKED, MOST = re.compile(r"<(article|main)\b", re.I), 0.5


def varied(page: str, rng: random.Random, other: list[str], whole: bool, short: bool = False) -> str:
    """A copy of a page whose article has another container and which has more blocks around and in the article.

    ``whole``: leave the page as it is. ``short``: leave of the article some words of a block or two. Every added block carries a mark that ``labels`` reads, and that no feature sees.
    """
    if whole or not (m := re.search(r"<(article|main)\b[^>]*>(.*)</\1\s*>", page, re.S | re.I)):
        return page
    tag = rng.choice(["article", "div", "div", "section", "main"])
    name = rng.choice(ARTICLE_NAMES) if tag in ("div", "section") or rng.random() < 0.4 else ""
    attrs = f' {rng.choice(["class", "id"])}="{name}"' if name else ""
    inner = m[2]

    def block() -> str:
        kind = rng.choice(list(WASTE_KINDS))
        tags, names = WASTE_KINDS[kind]
        t, c = rng.choice(tags.split()), rng.choice(names.split())
        named = "" if t in ("nav", "aside", "form", "footer", "header") and rng.random() < 0.5 else f' {rng.choice(["class", "class", "id"])}="{c}"'
        words = rng.choice(other)
        if kind == "comments":
            body = "".join(f"<{e}><p>{x}</p></{e}>" for e, x in ((rng.choice(["li", "div", "article"]), rng.choice(other)) for _ in range(rng.randint(1, 4))))
        elif kind in ("nav", "share", "footer") and rng.random() < 0.8:
            body = "<ul>" + "".join(f'<li><a href="/">{w}</a></li>' for w in words.split()[: rng.randint(2, 9)]) + "</ul>"
        elif kind == "form":
            body = f'<label>{" ".join(words.split()[:3])}</label><input type="text"><p>{" ".join(words.split()[:8])}</p>'
        else:
            body = rng.choice(["<p>{}</p>", "{}", "<h3>{}</h3><p>{}</p>"]).replace("{}", " ".join(words.split()[: rng.randint(3, 40)]))
        return f"<{t}{named} data-waste>{body}</{t}>"

    pieces = re.split(r"(?=<p\b)", inner)
    if short:
        some = rng.randint(2, 6)
        pieces = [re.sub(r"[^<>]{20,}(?=<|$)", lambda t: " ".join(t[0].split()[:some]), x) for x in pieces[: rng.randint(1, 2)]]
    for _ in range(rng.choice([0, 0, 1, 2])):
        pieces.insert(rng.randint(1, len(pieces)) if len(pieces) > 1 else len(pieces), block())
    body = f"<{tag}{attrs} data-main>{''.join(pieces)}</{tag}>"
    for _ in range(rng.randint(0, 2)):
        body = f'<div{rng.choice(["", " class=wrapper", " id=page", " class=container", " class=row"])}>{body}{block() if rng.random() < 0.3 else ""}</div>'
    around = ["", ""]
    for _ in range(rng.randint(0, 4)):
        around[rng.random() < 0.5] += block()
    return page[: m.start()] + around[0] + body + around[1] + page[m.end() :]


def stripped(page: str, rng: random.Random) -> str:
    """A copy of a page in which telling tags are ``div`` (their meaning goes into marks), and most names of elements are gone."""
    main = "data-main" in page

    def opening(m: re.Match) -> str:
        tag, attrs = m[1].lower(), m[2]
        mark = "" if "data-" in attrs or tag == "section" else " data-main" if tag in ("article", "main") and not main else " data-waste" if tag not in ("article", "main") else ""
        kept = attrs if "data-" in attrs and rng.random() < 0.3 else " data-main" if "data-main" in attrs else " data-waste" if "data-waste" in attrs else ""
        return f"<div{kept}{mark}>"

    page = re.sub(r"<(article|main|nav|aside|footer|header|section|form)\b([^>]*)>", opening, page, flags=re.I)
    return re.sub(r"</(?:article|main|nav|aside|footer|header|section|form)\s*>", "</div>", page, flags=re.I)


def likely(nodes: list[Node], runs: list[tuple[int, str]]) -> list[str]:
    """Marks for a page that has none: the innermost element with over MOST of the text outside links is main, and in and around
    it lists and blocks that are mostly links are waste."""
    n = len(nodes)
    chars, links = np.zeros(n), np.array([x.links for x in nodes], float)
    for i, t in runs:
        chars[i] += len(t.strip())
    for i in range(n - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        links[nodes[i].parent] += links[i]
    plain = np.maximum(chars - links, 0)
    marks = ["waste" if chars[i] and links[i] > 0.5 * chars[i] else "" for i in range(n)]
    at = 0
    while inner := [c for c in nodes[at].children if plain[c] > MOST * plain[0] and nodes[c].tag not in TEXTUAL and nodes[c].tag not in SKIPPED]:
        at = inner[0]
    if at:
        marks[at] = "main"
    return marks


def labels(nodes: list[Node], marks: list[str]) -> np.ndarray:
    """The states that a page's own marks say: its article is main, what isn't text of an article is waste."""
    state = [OUTSIDE] * len(nodes)
    holds = [False] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        holds[i] = holds[i] or marks[i] == "main" or (marks[i] == "" and nodes[i].tag in ("article", "main"))
        if holds[i] and nodes[i].parent >= 0:
            holds[nodes[i].parent] = True
    for i in range(1, len(nodes)):
        p = state[nodes[i].parent]
        waste = marks[i] == "waste" or nodes[i].tag in SKIPPED or nodes[i].tag in ("nav", "aside", "footer", "header", "form") and marks[i] != "main"
        if p == WASTE or waste:
            state[i] = WASTE
        elif p == MAIN or marks[i] == "main" or nodes[i].tag in ("article", "main"):
            state[i] = MAIN
        else:
            state[i] = OUTSIDE if holds[i] else WASTE
    return np.array(state)


def fit(pages: list[str]) -> Trees:
    """Trees from pages, in themselves and in varied copies."""
    rng = random.Random(SEED)
    other = [" ".join(t.split())[:400] for p in pages for t in re.findall(r"<p>([^<]{40,})", p)[:5]] or ["Some words of another page, to fill a block."]
    xs, ys = [np.zeros((0, len(TAGS) * 2 + TOKENS * 2 + 15), np.float32)], [np.zeros(0, int)]
    for page in pages:
        for k in range(COPIES + 1):
            copy = varied(page, rng, other, whole=k == 0, short=k == 1)
            nodes, runs = parse(stripped(copy, rng) if k == COPIES and MARKED.search(page) else copy)
            marks = [x.mark for x in nodes] if MARKED.search(page) else likely(nodes, runs)
            if "main" in marks or MARKED.search(page):
                xs.append(features(nodes, runs)[1:])
                ys.append(labels(nodes, marks)[1:])
    return boost(np.concatenate(xs), np.concatenate(ys))


def extract(df: DataFrame, trees: Trees, key: str = "page_id", keep: tuple[str, ...] = ("url",), markup: str = "html") -> DataFrame:
    """Each row's key, the columns of ``keep``, ``text`` and ``n_chars`` (code points).

    Null and empty pages, and pages without main text, have an empty text. Broken markup is read as far as it goes. Repeated
    rows and null keys stay, other columns are ignored, no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk in texts(batches, "markup", 256):
            parsed = [parse(t.decode("utf-8", "replace")) for t in chunk]
            logp = scores(trees, np.concatenate([features(*p) for p in parsed]))
            out, at = [], 0
            for nodes, runs in parsed:
                out.append(main_text(nodes, runs, decode(nodes, logp[at : at + len(nodes)])))
                at += len(nodes)
            rest = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=[*part.schema.names[:-1], "text", "n_chars"])

    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate((key, *keep))]
    rows = df.select(*columns, F.col(f"`{markup}`").cast("binary").alias("markup"))
    kinds = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(columns)))
    out = rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate((key, *keep))), "text", "n_chars")


def learn(df: DataFrame, markup: str = "html", key: str = "page_id") -> Trees:
    """Trees fitted on FIT_PAGES pages of FIT_BYTES bytes at most: those that mark their article before others, then those with
    the smallest hashes. Null and empty pages teach nothing."""
    own = F.xxhash64(F.col(f"`{key}`"), F.md5(F.col(f"`{markup}`")))
    marks = F.rlike(F.col(f"`{markup}`"), F.lit(r"(?i)<(article|main)\b")).cast("int")
    rows = df.filter(F.octet_length(F.col(f"`{markup}`")).between(1, FIT_BYTES)).select(F.col(f"`{markup}`").alias("m"), F.struct((-marks).alias("marks"), own.alias("h")).alias("h"))
    # Hashes first: each task sends FIT_PAGES of them, and only then are that many pages fetched.
    last = rows.select("h").orderBy("h").limit(FIT_PAGES).agg(F.max("h").alias("h")).first().h
    bound = F.struct(F.lit(last.marks).alias("marks"), F.lit(last.h).alias("h")) if last else None
    return fit([r.m for r in rows.filter(F.col("h") <= bound).orderBy("h").limit(FIT_PAGES).collect()] if last else [])
