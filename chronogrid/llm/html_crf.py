"""Main-text extraction: a linear-chain conditional random field over leaf blocks.

A page becomes the sequence of its leaf blocks, runs of text between block
tags. Features of a block are its ancestor tags with their class and id words
and figures of its text. The field is trained on labelled pages and a page is
decoded by Viterbi; the blocks labelled as main text are the result.

Labelled pages are of two kinds: pages of the input that mark their article
(``article`` or ``main``), whose labels follow from that markup, and pages put
together here from page parts of known kind in varying markup, so that the
field also knows sites that do not mark their article.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import hash_share

BUCKETS = 1 << 14
EPOCHS = 5
RATE = 0.3
LABELLED_PAGES = 300
MADE_PAGES = 1000
MAX_TRAIN_ANCESTORS = 20_000

# Fixed values of the HTML standard
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript iframe svg math textarea title object canvas".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table body article section div nav aside main form select".split())

# A comment, a declaration, or a tag whose quoted values may hold ">"; with an odd quote the tag ends at the next ">".
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']+|\"[^\"]*\"|'[^']*')*+(?=>)|[^<>]*)>",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PIECE = re.compile(r"[a-z]+")


# Page parts that are not main text, by their markup: for the labelled pages that are made here and for marked ones.
_BOILER = (
    ("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("menu", ""),
    ("div", "nav"), ("div", "menu"), ("div", "navbar"), ("div", "breadcrumb"), ("div", "header"), ("div", "footer"),
    ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("div", "cookie notice"), ("div", "banner"),
    ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "sponsor"), ("div", "promo"), ("div", "newsletter"),
    ("div", "subscribe"), ("div", "share social"), ("div", "comments"), ("section", "comments"), ("div", "comment"),
    ("ul", "menu"), ("section", "related"), ("div", "popup modal"), ("div", "login"), ("div", "search"), ("div", "copyright"),
    ("div", "consent"), ("div", "notice"), ("div", "advertisement"), ("section", "newsletter"), ("div", "pagination"), ("div", "tags"),
)
_OUT_TAGS = set("nav header footer aside form menu".split())
_OUT_WORDS = set(w for _, named in _BOILER for w in named.split())


class Node:
    """An open tag: its class and id words, its parent and, carried from there, its depth and place by the markup."""

    __slots__ = ("tag", "words", "parent", "depth", "inside", "out")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.depth = parent.depth + 1 if parent else 1
        self.inside, self.out = (parent.inside, parent.out) if parent else (False, False)
        if tag in ("article", "main"):
            self.inside, self.out = True, False
        elif tag in _OUT_TAGS or _OUT_WORDS.intersection(words):
            self.out = True


@dataclass
class Block:
    """Text of a leaf block with its innermost open tag; ancestors are shared between blocks, not copied."""

    text: str
    node: Node | None
    link_chars: int = 0


class _Stack:
    """Open tags with the places of each tag name, so that looking one up does not walk the stack."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in SCOPES:
            self.scopes.append(len(self.nodes))
        self.nodes.append(Node(tag, words, self.top()))

    def top(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open tag of these names, -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def in_scope(self, tags: Iterable[str]) -> int:
        """The same, -1 also if a scope was opened since."""
        found = self.last(tags)
        return found if found > (self.scopes[-1] if self.scopes else -1) else -1

    def cut(self, index: int) -> None:
        while len(self.nodes) > index:
            self.places[self.nodes.pop().tag].pop()
        while self.scopes and self.scopes[-1] >= index:
            self.scopes.pop()


def blocks_of(html: str | None) -> list[Block]:
    """Leaf blocks in page order: character references decoded, white space runs made one space, empty ones left out.

    Time and memory grow with the length of the page, however deep its tags are nested.
    """
    html = html or ""
    stack = _Stack()
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                chars = len(" ".join(unescape("".join(linked)).split())) if linked else 0
                out.append(Block(text, stack.top(), chars))
            parts.clear()
            linked.clear()

    def close_to(index: int) -> None:
        if index >= 0:
            flush()
            stack.cut(index)

    at, size = 0, len(html)
    while at < size:
        found = _TOKEN.search(html, at)
        stop = found.start() if found else size
        if stop > at:
            parts.append(html[at:stop])
            if in_link:
                linked.append(html[at:stop])
        if not found:
            break
        at = found.end()
        tag = (found.group(2) or "").lower()
        if not tag:
            continue
        closing = bool(found.group(1))
        if tag in RAW:
            if not closing and not found.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag in VOID:
            flush()
            continue
        if closing:
            flush()
            close_to(stack.last((tag,)))
            in_link = 0
            continue
        if tag in CLOSES_P:
            close_to(stack.in_scope(("p",)))
        close_to(stack.in_scope(SELF_CLOSING.get(tag, ())))
        flush()
        named = [w for m in _NAMED.finditer(found.group(3)) for w in _PIECE.findall((m[2] or m[3] or m[4] or "").lower())]
        stack.push(tag, tuple(dict.fromkeys(named)))
    flush()
    return out


@lru_cache(1 << 16)
def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


@dataclass
class Path:
    """Feature buckets that a tag adds to those of the tags around it."""

    above: Path | None
    added: list[int]


@dataclass
class Features:
    """Feature buckets of a block: those of its path, shared with other blocks, and its own beyond these."""

    path: Path | None
    own: list[int]

    def all(self) -> np.ndarray:
        """All buckets in order; as long as the path is deep, so for examples to learn from only."""
        found, path = list(self.own), self.path
        while path:
            found += path.added
            path = path.above
        return np.array(sorted(found), np.int32)


def features_of(blocks: list[Block]) -> list[Features]:
    """Feature buckets of every block: its ancestors' tags and words, its place, its text's figures.

    Blocks come in page order, so every open tag is entered and left once.
    """
    out = []
    total = len(blocks)
    nodes: list[Node] = []
    paths: list[Path | None] = [None]
    grown: list[list[int]] = []
    held: set[int] = set()
    for i, block in enumerate(blocks):
        fresh, node = [], block.node
        while node and not (node.depth <= len(nodes) and nodes[node.depth - 1] is node):
            fresh.append(node)
            node = node.parent
        for _ in range(len(nodes) - (node.depth if node else 0)):
            nodes.pop()
            paths.pop()
            held.difference_update(grown.pop())
        for node in reversed(fresh):
            added = sorted({_hash(f"in:{node.tag}"), *(_hash(f"named:{w}") for w in node.words)} - held)
            held.update(added)
            nodes.append(node)
            grown.append(added)
            paths.append(Path(paths[-1], added) if added else paths[-1])
        text = block.text
        names = {"always", f"depth{min(len(nodes), 12)}"}
        for node in nodes[-2:]:
            names.add(f"near:{node.tag}")
            names.update(f"close:{w}" for w in node.words)
        n_words = text.count(" ") + 1
        names.add(f"words{min(int(np.log2(n_words)), 8)}")
        names.add(f"links{min(int(4 * block.link_chars / max(len(text), 1)), 4)}")
        names.add(f"stop{sum(text.count(c) for c in '.!?') > 0}")
        names.add("ends" + (text[-1] if text[-1] in ".!?:,;\"" else "x"))
        names.add(f"place{min(4 * i // max(total, 1), 3)}")
        if "©" in text or "(c)" in text.lower():
            names.add("copyright")
        if any(c in text for c in "|»›•"):
            names.add("bars")
        out.append(Features(paths[-1], sorted({_hash(x) for x in names} - held)))
    return out


@dataclass
class Field:
    """Weights of the state features (bucket by label) and of the moves between labels."""

    state: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 2)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def scores(self, features: list[Features]) -> np.ndarray:
        """Summed weights of every block; the sum of a path is that of the path around it and what its tag adds."""
        own = np.array([x for block in features for x in block.own], np.int64)
        place = np.repeat(np.arange(len(features)), [len(block.own) for block in features])
        out = np.stack([np.bincount(place, self.state[own, c], len(features)) for c in (0, 1)], axis=1)
        sums: dict[int, np.ndarray] = {}
        for i, block in enumerate(features):
            fresh, path = [], block.path
            while path and id(path) not in sums:
                fresh.append(path)
                path = path.above
            for path in reversed(fresh):
                above = sums[id(path.above)] if path.above else 0.0
                sums[id(path)] = above + self.state[path.added].sum(axis=0)
            if block.path:
                out[i] += sums[id(block.path)]
        return out

    def viterbi(self, features: list[Features]) -> list[int]:
        """Most likely labels; on a tie the label 0."""
        if not features:
            return []
        scores, move = self.scores(features).tolist(), self.move.tolist()
        best, back = scores[0], []
        for s in scores[1:]:
            step, now = [], []
            for label in (0, 1):
                a, b = best[0] + move[0][label], best[1] + move[1][label]
                step.append(0 if a >= b else 1)
                now.append(max(a, b) + s[label])
            back.append(step)
            best = now
        label = 0 if best[0] >= best[1] else 1
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]

    def expected(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the labels and of the moves by forward and backward sums."""
        n = len(scores)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = scores[0]
        for i in range(1, n):
            forward[i] = scores[i] + np.logaddexp.reduce(forward[i - 1][:, None] + self.move, axis=0)
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.move + (scores[i + 1] + backward[i + 1])[None, :], axis=1)
        norm = np.logaddexp.reduce(forward[-1])
        moves = np.zeros((2, 2))
        for i in range(1, n):
            moves += np.exp(forward[i - 1][:, None] + self.move + (scores[i] + backward[i])[None, :] - norm)
        return np.exp(forward + backward - norm), moves


def train_field(pages: list[tuple[list[np.ndarray], list[int]]], epochs: int = EPOCHS) -> Field:
    """Gradient ascent on the conditional likelihood, page by page, with steps by AdaGrad."""
    model = Field()
    seen_state, seen_move = np.full((BUCKETS, 2), 1e-2), np.full((2, 2), 1e-2)
    laid = []
    for features, labels in pages:
        if features:
            sizes = np.array([len(f) for f in features])
            flat = np.concatenate(features)
            buckets, place = np.unique(flat, return_inverse=True)
            truth = np.eye(2)[labels]
            real = np.zeros((2, 2))
            np.add.at(real, (labels[:-1], labels[1:]), 1)
            laid.append((flat, np.cumsum(sizes) - sizes, sizes, buckets, place, truth, real))
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for at in order.permutation(len(laid)):
            flat, starts, sizes, buckets, place, truth, real = laid[at]
            marginals, moves = model.expected(np.add.reduceat(model.state[flat], starts, axis=0))
            miss = np.repeat(truth - marginals, sizes, axis=0)
            steps = np.stack([np.bincount(place, miss[:, c]) for c in (0, 1)], axis=1) - 1e-4 * model.state[buckets]
            seen_state[buckets] += steps**2
            model.state[buckets] += RATE * steps / np.sqrt(seen_state[buckets])
            step = real - moves
            seen_move += step**2
            model.move += RATE * step / np.sqrt(seen_move)
    return model


# The same for parts that are main text.
_MAIN = (
    ("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "article"), ("div", "post"),
    ("div", "entry content"), ("section", "article body"), ("div", "main"), ("div", "story"), ("div", "text"), ("section", ""),
    ("div", ""), ("td", ""),
)
_INNER = ("p", "p", "p", "p", "div", "blockquote", "li", "h2", "h3", "pre", "td")


def made_pages(count: int = MADE_PAGES, seed: int = 5) -> list[tuple[str, list[int]]]:
    """(html, labels of the blocks): known parts in random order, wrapping and length."""
    random = np.random.default_rng(seed)
    letters = "etaoinshrdlucmfwyp"
    pool = ["".join(letters[i] for i in random.integers(0, len(letters), n)) for n in random.integers(2, 9, 500)]

    def words(n: int, full: bool) -> str:
        text = " ".join(pool[i] for i in random.integers(0, len(pool), n)).capitalize()
        return text + "." if full else text

    def wrapped(tag: str, named: str, inner: str) -> str:
        if not named:
            return f"<{tag}>{inner}</{tag}>"
        how = "id" if random.random() < 0.3 else "class"
        return f'<{tag} {how}="{named.replace(" ", "-") if random.random() < 0.5 else named}">{inner}</{tag}>'

    def boiler() -> tuple[str, int]:
        tag, named = _BOILER[random.integers(len(_BOILER))]
        parts, n = [], int(random.integers(1, 7))
        style = random.random()
        for _ in range(n):
            if tag in ("ul", "menu") or style < 0.35:
                parts.append(f'<li><a href="/x">{words(int(random.integers(1, 4)), False)}</a></li>')
            elif style < 0.7:
                parts.append(f"<p>{words(int(random.integers(3, 40)), True)}</p>")
            else:
                parts.append(f"<div>{words(int(random.integers(1, 25)), random.random() < 0.6)}</div>")
        if style < 0.35 and tag not in ("ul", "menu"):
            parts = ["<ul>", *parts, "</ul>"]
        if random.random() < 0.3 and style >= 0.35 and tag not in ("ul", "menu"):
            return wrapped(tag, named, words(int(random.integers(2, 30)), True)), 1
        return wrapped(tag, named, "".join(parts)), n

    def main() -> tuple[str, int]:
        tag, named = _MAIN[random.integers(len(_MAIN))]
        parts, n = [], int(random.integers(1, 12))
        heading = random.random() < 0.8
        if heading:
            parts.append(f"<h1>{words(int(random.integers(2, 12)), False)}</h1>")
        for _ in range(n):
            inner = _INNER[random.integers(len(_INNER))] if random.random() < 0.4 else "p"
            short = inner in ("h2", "h3", "li") or random.random() < 0.2
            body = words(int(random.integers(1, 12) if short else random.integers(12, 120)), inner not in ("h2", "h3"))
            if random.random() < 0.15:
                body += f' <a href="/y">{words(2, False)}</a>'
            parts.append(f"<{inner}>{body}</{inner}>")
        if tag == "td":
            return "<table><tr><td>" + "".join(parts) + "</td></tr></table>", n + heading
        return wrapped(tag, named, "".join(parts)), n + heading

    pages = []
    for _ in range(count):
        html, labels = [], []
        for _ in range(int(random.integers(0, 5))):
            part, n = boiler()
            html.append(part)
            labels += [0] * n
        if random.random() < 0.97:
            part, n = main()
            if random.random() < 0.25:  # something else inside the article
                inside, m = boiler()
                cut = part.rfind("</")
                html.append(part[:cut] + inside + part[cut:])
                labels += [1] * n + [0] * m
            else:
                html.append(part)
                labels += [1] * n
        for _ in range(int(random.integers(0, 5))):
            part, n = boiler()
            html.append(part)
            labels += [0] * n
        pages.append(("<html><body>" + "".join(html) + "</body></html>", labels))
    return pages


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels by the page's own markup, or None when it marks no article."""
    if not any(block.node and block.node.inside for block in blocks):
        return None
    return [int(bool(block.node and block.node.inside and not block.node.out)) for block in blocks]


def train(pages: DataFrame, key: str = "page_id", html: str = "html", labelled_pages: int = LABELLED_PAGES) -> Field:
    """Field from the made pages and about ``labelled_pages`` pages of the input that mark their article.

    Whole pages are learnt from; those whose blocks have more than
    ``MAX_TRAIN_ANCESTORS`` open tags in sum are no examples.
    """
    rows = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("k"), F.col(html).alias("h"))
    total = rows.count()
    marked = rows.where(F.lower("h").rlike(r"<(article|main)[\s>]"))
    sample = marked.where(hash_share(F.col("k")) < F.lit(min(1.0, labelled_pages / max(total, 1))))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch["k"], batch["h"]):
                blocks = blocks_of(text)
                labels = marked_labels(blocks)
                if labels and sum(b.node.depth if b.node else 0 for b in blocks) <= MAX_TRAIN_ANCESTORS:
                    out.append((str(k), [f.all().tolist() for f in features_of(blocks)], labels))
            yield pd.DataFrame(out, columns=["k", "f", "y"])

    found = sample.mapInPandas(featured, "k string, f array<array<int>>, y array<int>").orderBy("k").collect()  # bounded
    pages_in = [([np.array(f, np.int32) for f in r["f"]], list(r["y"])) for r in found]
    for text, labels in made_pages():
        blocks = blocks_of(text)
        if len(blocks) == len(labels):
            pages_in.append(([f.all() for f in features_of(blocks)], labels))
    return train_field(pages_in)


def extract(pages: DataFrame, model: Field, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row, from its whole html.

    Null and empty html and pages without main text give an empty text. Equal
    pages have equal texts; rows with equal or null keys are read each. An empty
    table gives an empty result. Other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    kinds = dict(rows.dtypes)

    def main_text(text: str | None) -> str:
        blocks = blocks_of(text)
        labels = shared.value.viterbi(features_of(blocks))
        return "\n".join(b.text for b, label in zip(blocks, labels) if label)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(t) for t in batch["h"]]
            yield pd.DataFrame({"k": batch["k"], "u": batch["u"], "text": texts, "n_chars": [len(t) for t in texts]})

    found = rows.mapInPandas(work, f"k {kinds['k']}, u {kinds['u']}, text string, n_chars bigint")
    return found.withColumnsRenamed({"k": key, "u": url})
