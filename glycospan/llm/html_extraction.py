"""Main text of web pages: boosted trees over DOM nodes, and a decoding that no ancestor contradicts.

Every element and every run of text of a page is a node with features of its subtree
(text, tags, links, marks), its place (depth, siblings) and its attributes. Boosted trees
give the probability that a node holds main text. The page's most likely labelling, under
the rule that nothing below a node without main text has any, is found exactly by one
pass up and one down the tree. Text runs labelled main make the result.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glycospan.llm import page_layouts
from glycospan.llm.boosted_trees import BoostedTrees
from glycospan.llm.common import slices

#: Pages whose words fill the training layouts, those with the smallest hash of their id, and how many layouts are made.
TRAINING_PAGES, TRAINING_LAYOUTS = 200, 1600
#: Tags are read as browsers do: a quote opens a value only right after the equals sign, and one that is never closed runs
#: to the end of the page. The patterns give nothing back, so that each character is looked at once or twice.
_VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+"
_PAIR = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}))?+")
_TAG = rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE}))?+)*+)(?:>|\Z)"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|{_TAG}|<[!?/][^>]*+(?:>|\Z)", re.S)
_LONG_NUMBER = re.compile(r"&#([0-9]{100,});?")
_PART = re.compile(r"[A-Z]?[a-z]+")
_MARKS = re.compile(r"[.,;:!?。、]")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
#: Elements whose text is never shown as part of an article.
SILENT = frozenset("script style title textarea head template noscript iframe object svg math canvas audio video select option button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
#: An opening tag of this kind ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt td th tr tbody thead tfoot".split())
#: An opening tag ends an open one of these, unless one of the limits stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("table td th caption button object body html article section div main aside nav header footer form li".split())

TAGS = {name: i for i, group in enumerate(("p", "div", "section", "article main", "nav menu", "header", "footer", "aside", "ul ol dl", "li dt dd", "a", "h1 h2 h3 h4 h5 h6", "form fieldset", "table tbody", "tr td th", "blockquote pre figure", "#text"), 1) for name in group.split()}
#: Stems of attribute words, by what they hint at.
HINTS = {stem: i for i, group in enumerate(("nav navi navigation menu breadcrumb breadcrumbs toolbar", "header head masthead topbar top logo", "footer foot bottom copyright legal", "side sidebar aside rail widget widgets", "cookie cookies consent notice alert banner popup modal overlay message warning", "ad ads adv advert advertisement sponsor sponsored promo promotion", "share social follow", "comment comments reply replies respond discussion disqus", "related recommended more popular trending teaser", "form search login signup subscribe newsletter", "article content main post entry story text body page", "meta byline author date tags tag caption")) for stem in group.split()}
N_HINTS = 12
_AD, _CONTENT = 1 << 5, 1 << 10
_TOLD = frozenset("class id role aria-label".split())
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    hints: int = 0
    inherited: int = 0
    silent: bool = False
    inline: bool = False
    text: str = ""
    children: list[int] = field(default_factory=list)


def _unescaped(text: str) -> str:
    """The text with its character references decoded; numbers of any length, too large ones as U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or 0};", text))


def _hints(pairs: list[tuple[str, str]]) -> int:
    found = 0
    for name, value in pairs:
        name = name.lower()
        if name in _TOLD or name.startswith("data-"):
            for part in _PART.findall(value):
                hint = HINTS.get(part.lower())
                if hint is not None:
                    found |= 1 << hint
    return found


def _hidden(pairs: list[tuple[str, str]]) -> bool:
    """Whether there is an attribute called hidden, or a style whose display is none."""
    styled = False
    for name, value in pairs:
        name = name.lower()
        if name == "hidden":
            return True
        if name == "style" and not styled:  # the first of two counts
            styled = True
            display, fixed = "", False
            for declaration in _COMMENT.sub(" ", _unescaped(value.strip("\"'"))).lower().split(";"):
                key, _, setting = declaration.partition(":")
                setting, _, rank = setting.partition("!")
                if key.strip() == "display" and (not fixed or rank):  # the last one counts, unless one is important
                    display, fixed = setting.strip(), fixed or bool(rank)
            if display == "none":
                return True
    return False


class _Parser:
    """The nodes of a page while it is read; open elements are found by name, without a walk."""

    def __init__(self) -> None:
        self.nodes = [Node("#root", -1, 0)]
        self.open: list[tuple[str, bool]] = [("#root", True)]  # name, whether it is a node
        self.blocks = [(0, 0)]  # node and place of the open elements that are nodes
        self.places: dict[str, list[int]] = {}  # places of the open elements of each name
        self.scopes: list[int] = []  # places of those that keep an open paragraph from being ended
        self.run: list[str] = []
        self.linked = self.open_links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            block = self.blocks[-1][0]
            own = self.nodes[block]
            self.nodes.append(Node("#text", block, own.depth + 1, min(self.linked, len(text)), own.inherited | own.hints, text=text))
            own.children.append(len(self.nodes) - 1)
        self.linked = 0

    def add(self, text: str) -> None:
        if text and not self.nodes[self.blocks[-1][0]].silent:
            text = _unescaped(text)
            self.run.append(text)
            if self.open_links:
                self.linked += len(text)

    def start(self, tag: str, pairs: list[tuple[str, str]], hints: int) -> None:
        """Open an element that is a node."""
        self.flush()
        block = self.blocks[-1][0]
        own = self.nodes[block]
        silent = own.silent or tag in SILENT or bool(pairs) and _hidden(pairs)
        self.nodes.append(Node(tag, block, own.depth + 1, hints, own.inherited | own.hints, silent))
        own.children.append(len(self.nodes) - 1)
        self.blocks.append((len(self.nodes) - 1, len(self.open)))
        self.push(tag, True)

    def push(self, tag: str, is_node: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in SCOPE:
            self.scopes.append(len(self.open))
        self.open.append((tag, is_node))
        self.open_links += tag == "a"

    def close(self, place: int) -> None:
        """Close the open elements from a place on."""
        while len(self.open) > place:
            tag, is_node = self.open.pop()
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            self.open_links -= tag == "a"
            if is_node:
                self.flush()
                self.blocks.pop()

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def end(self, tag: str) -> None:
        place = self.last(tag)
        # the end tag of an inline element that stands outside of the block is a stray one
        if place and (tag not in INLINE or place >= self.blocks[-1][1]):
            self.close(place)

    def end_implied(self, tag: str) -> None:
        """Close what an opening tag ends without an end tag."""
        if tag in ENDS_P:
            place = self.last("p")
            if place and place > (self.scopes[-1] if self.scopes else 0):
                self.close(place)
        if tag in ENDS:
            ended, limits = ENDS[tag]
            limit = max(map(self.last, limits))
            beyond = [p[i] for p in map(self.places.get, ended) if p and (i := bisect_right(p, limit)) < len(p)]
            if beyond:
                self.close(min(beyond))


def parse(page: str) -> list[Node]:
    """Nodes in page order: elements, and the runs of text of each block as nodes called #text.

    Inline elements are no nodes but part of a run, except those whose attributes name an
    advert; of links the runs carry the length in ``hints`` (in characters). Missing end
    tags are put in as browsers do. A tag that the end of the page cuts off is dropped. The
    time is in proportion to the page, whatever its tags.
    """
    reading = _Parser()
    at, size = 0, len(page)
    while at < size:
        match = _TOKEN.search(page, at)
        if not match:
            reading.add(page[at:])
            break
        reading.add(page[at : match.start()])
        at = match.end()
        ending, tag, attributes = match.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if ending:
            reading.end(tag)
            continue
        if tag == "br":
            reading.add(" ")
            continue
        reading.end_implied(tag)
        if tag in VOID:
            if tag not in INLINE:
                reading.flush()
            continue
        pairs = _PAIR.findall(attributes) if attributes else []
        hints = _hints(pairs) if pairs else 0
        if tag in INLINE and not hints & _AD:
            if not attributes.endswith("/"):
                reading.push(tag, False)
            continue
        reading.start(tag, pairs, hints)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            reading.close(reading.last(tag))
    reading.close(1)
    reading.flush()
    return reading.nodes


FEATURES = 25 + 2 * N_HINTS + 5
_INSIDE = {"nav": 1, "menu": 1, "header": 2, "footer": 16, "aside": 4, "form": 4, "article": 8, "main": 8}


def features(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node."""
    n = len(nodes)
    text, tags, links, paragraphs, items, marks, runs = ([0] * n for _ in range(7))
    inside = [0] * n
    for i in range(1, n):
        node = nodes[i]
        inside[i] = inside[node.parent] | _INSIDE.get(node.tag, 0)
    for i in range(n - 1, 0, -1):
        node = nodes[i]
        if node.tag == "#text":
            text[i], links[i], runs[i] = len(node.text), node.hints, 1
            marks[i] = len(_MARKS.findall(node.text))
        else:
            tags[i] += 1
            paragraphs[i] += node.tag == "p"
            items[i] += node.tag == "li"
        up = node.parent
        for values in (text, tags, links, paragraphs, items, marks, runs):
            values[up] += values[i]
    largest = [0] * n  # text of the largest child
    wrapped = told = 0  # text in the page's largest article or main element, and in its largest element called like one
    for i in range(1, n):
        node = nodes[i]
        largest[node.parent] = max(largest[node.parent], text[i])
        if node.tag in ("article", "main"):
            wrapped = max(wrapped, text[i])
        elif node.tag != "#text" and node.hints & _CONTENT:
            told = max(told, text[i])
    total, log = max(text[0], 1), math.log1p
    rows = np.zeros((n, FEATURES), np.float32)
    for i in range(1, n):
        node = nodes[i]
        parent = nodes[node.parent]
        beside, here, above = len(parent.children), text[i], text[node.parent]
        hints = 0 if node.tag == "#text" else node.hints
        row = [
            TAGS.get(node.tag, 0),
            TAGS.get(parent.tag, 0),
            min(node.depth, 40),
            log(here),
            log(tags[i]),
            here / (tags[i] + 1),
            links[i] / here if here else 0,
            marks[i] / here if here else 0,
            log(paragraphs[i]),
            log(items[i]),
            log(len(node.children)),
            log(beside),
            here / above if above else 0,
            (above - here) / beside,
            here / total,
            log(above),
            links[node.parent] / above if above else 0,
            log(paragraphs[node.parent]),
            here / runs[i] if runs[i] else 0,
            here / largest[node.parent] if here else 0,
            largest[node.parent] / above if above else 0,
            largest[i] / here if here else 0,
            wrapped / total,
            told / total,
            log(total),
        ]
        row += [hints >> k & 1 for k in range(N_HINTS)]
        row += [node.inherited >> k & 1 for k in range(N_HINTS)]
        row += [inside[i] >> k & 1 for k in range(5)]
        rows[i] = row
    return rows


def decode(nodes: list[Node], probability: np.ndarray) -> list[bool]:
    """The most likely labels under which a node without main text has none below it."""
    n = len(nodes)
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log1p(-p).tolist()
    for i in range(n - 1, 0, -1):  # children come after their parents
        up = nodes[i].parent
        if nodes[i].silent:
            yes[i] = -math.inf
        yes[up] += max(yes[i], no[i])
        no[up] += no[i]
    main = [False] * n
    main[0] = True
    for i in range(1, n):
        main[i] = main[nodes[i].parent] and yes[i] > no[i]
    return main


@dataclass
class Extractor:
    trees: BoostedTrees

    def texts(self, pages: list[str | None]) -> list[str]:
        parsed = [parse(p) if p else [] for p in pages]
        rows = [features(nodes) for nodes in parsed if nodes]
        probability = self.trees.probability(np.concatenate(rows)) if rows else np.zeros(0)
        out, at = [], 0
        for nodes in parsed:
            main = decode(nodes, probability[at : at + len(nodes)]) if nodes else []
            at += len(nodes)
            out.append(" ".join(node.text for node, keep in zip(nodes, main, strict=True) if keep and node.text))
        return out


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a training layout: a node holds main text if a marked run is in it."""
    nodes = parse(page)
    label = np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1, 0, -1):
        if page_layouts.MARK in nodes[i].text:
            nodes[i].text = nodes[i].text.replace(page_layouts.MARK, "")
            label[i] = True
        label[nodes[i].parent] |= label[i]
    return features(nodes), label


def runs_of_text(page: str | None) -> list[str]:
    """All runs of shown text of a page, main or not."""
    return [node.text for node in parse(page or "") if node.text]


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = TRAINING_PAGES, layouts: int = TRAINING_LAYOUTS, seed: int = 11) -> Extractor:
    """Trees fitted on layouts with known main text, filled with the words of at most ``most`` pages.

    There are no labelled pages, so layouts of many kinds, with and without telling tags and
    attributes, are made by a grammar. Without any page the layouts have words of their own.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html")).where(F.col("html").isNotNull())
    chosen = rows.orderBy(F.xxhash64("id", "html")).limit(most)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(runs_of_text(t)) for t in part.column("html").to_pylist()], pa.string())], names=["text"])

    words = [r.text.split(" ") for r in sorted(chosen.mapInArrow(shown, "text string").toLocalIterator(), key=lambda r: r.text)]
    made = [labelled(page) for page in page_layouts.layouts(words, layouts, seed)]
    return Extractor(BoostedTrees.fit(np.concatenate([x for x, _ in made]), np.concatenate([y for _, y in made])))


def extract_text(pages: DataFrame, extractor: Extractor | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Text of a block has single spaces and is trimmed; blocks are joined by one space in
    page order. A null, empty or textless page gives an empty text. Each row is worked on
    alone, whole, without a shuffle, in time in proportion to its length; null and repeated
    ids are kept as they are.
    """
    sent = pages.sparkSession.sparkContext.broadcast(extractor or train(pages, id_col, html_col))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = sent.value.texts(part.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
