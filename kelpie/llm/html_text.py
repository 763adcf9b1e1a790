"""Main-text extraction: gradient-boosted trees over DOM-node features with hierarchical decoding.

A page is parsed into a tree of block elements (inline elements without attributes are folded into them). Each
node gets features of its subtree (text, words, links, density of text over tags, punctuation), of the tokens of
its class, id and role, of its depth, and of its siblings. Trees give each node the log-odds that it holds main
text. Decoding picks the most likely set of kept nodes in which no kept node has a dropped ancestor: for every
node, keep it and decide each child, or drop its whole subtree.

The model is trained here, on pages made by page_maker.py; it is a few kilobytes and is sent with the tasks.

Defined results: a null or empty page, and one without text, gives empty text; an empty table gives an empty result;
markup that never ends is read to the end of the page; a very long page is parsed whole, in memory in proportion to
it; svg, select, button, template, noscript and iframe are left out from their start to their end tag, or alone where
they close themselves or have no end tag; a slash closes no other element; white space is str.split()'s; a line break
inside a block is white space; unknown character references stay as they are; where keeping and dropping a subtree
are alike likely it is dropped; rows that repeat give a row each. Only page_id, url and html are read, so other
columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import gbdt
from kelpie.llm.common import map_rows

TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)(?:([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>|([^>]*)(?:>|\Z)))",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: A slash at the end that is no part of an unquoted value.
SELF_CLOSED = re.compile(r"(?:\A|[\s\"']|(?:\A|\s)[^\s=\"']+)/\Z")
TOKEN = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
#: Elements that are left out with what they hold, if they are closed.
DROPPED = frozenset("iframe noembed noframes noscript template svg select button".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("html body dd dt li tbody td tfoot th thead tr caption".split())
#: What an opening tag closes first, up to the nearest of the second set.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "li", "ul", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "a", "span", "body", "dl")
#: Words in class, id and role that speak for a kind of block.
KINDS = {
    "content": "article content post entry story main body text paragraph blog news page prose",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc tabs pagination pager topbar toolbar",
    "edge": "header footer masthead foot head banner copyright legal bottom colophon",
    "side": "sidebar side aside rail widget related recommended more trending popular promo",
    "advert": "ad ads advert advertisement advertising sponsor sponsored sponsors adslot dfp promoted banner",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay paywall warning privacy toast",
    "comment": "comment comments reply replies discussion disqus respond commentlist thread reader",
    "form": "form login signup subscribe newsletter search register input",
    "social": "share social follow tags meta byline author tools print date published",
}
KIND_OF = {w: k for k, name in enumerate(KINDS) for w in KINDS[name].split()}
HEADINGS = re.compile(r"^(comments?|\d+ comments?|related|share|leave a reply|responses?|subscribe|newsletter|advertisement|sponsored)\b", re.I)


class Node:
    __slots__ = ("children", "kinds", "named", "parent", "parts", "tag")

    def __init__(self, tag: str, parent: int, kinds: tuple[int, ...], named: bool) -> None:
        self.tag, self.parent, self.kinds, self.named = tag, parent, kinds, named
        self.parts: list = []  # text (str), link text (tuple), or a child (int), in order
        self.children: list[int] = []


@lru_cache(1 << 14)
def kinds_of(value: str) -> tuple[int, ...]:
    return tuple(sorted({k for t in TOKEN.findall(value) if (k := KIND_OF.get(t.lower())) is not None}))


def parse(html: str) -> list[Node]:
    """The tree of a page in page order; node 0 is the root."""
    nodes = [Node("html", -1, (), False)]
    # the open elements: tag and its node (that of its parent for folded inline elements)
    open_: list[tuple[str, int]] = [("html", 0)]
    # of the open elements that are dropped: their place in open_, and the nodes, parts and children there were before
    undo: list[tuple[int, int, int, int]] = []
    links, at, n = 0, 0, len(html)

    def text(s: str) -> None:
        if s and not s.isspace():
            s = unescape(s) if "&" in s else s
            nodes[open_[-1][1]].parts.append((s,) if links else s)
        elif s:
            nodes[open_[-1][1]].parts.append(" ")

    def close(k: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in open_[k:])
        del open_[k:]
        while undo and undo[-1][0] >= k:
            undo.pop()

    while at < n:
        m = TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == tag:
                    before = [u for u in undo if u[0] == k]
                    parent = nodes[open_[k][1]]
                    close(k)
                    for _, n_nodes, n_parts, n_children in before:
                        del nodes[n_nodes:], parent.parts[n_parts:], parent.children[n_children:]
                    break
            continue
        attributes = m[3] if m[3] is not None else m[4]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in DROPPED:
            if not SELF_CLOSED.search(attributes):
                parent = nodes[open_[-1][1]]
                undo.append((len(open_), len(nodes), len(parent.parts), len(parent.children)))
                open_.append((tag, open_[-1][1]))
            continue
        if tag in ("head", "html", "body") and tag != "body":
            continue
        if tag == "br" or tag in VOID:
            nodes[open_[-1][1]].parts.append(" " if tag != "hr" else "\n")
            continue
        if tag in CLOSES_P:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == "p":
                    close(k)
                    break
                if open_[k][0] in BLOCK or open_[k][0] in DROPPED:
                    break
        if tag in IMPLIED:
            shut, stop = IMPLIED[tag]
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] in stop or open_[k][0] in DROPPED:
                    break
                if open_[k][0] in shut:
                    close(k)
                    if tag != "tr" or not any(t in shut for t, _ in open_[k:]):
                        break
        kinds: tuple[int, ...] = ()
        named = False
        if attributes and "=" in attributes:
            values = [a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(attributes) if a[1].lower() in ("class", "id", "role")]
            named = bool(values)
            kinds = kinds_of(" ".join(values)) if named else ()
        if tag == "a":
            links += 1
        parent = open_[-1][1]
        if tag in BLOCK or kinds:
            child = len(nodes)
            nodes.append(Node(tag, parent, kinds, named))
            nodes[parent].parts.append(child)
            nodes[parent].children.append(child)
            open_.append((tag, child))
        else:
            # a slash closes no element of HTML
            open_.append((tag, parent))
    return nodes


OWN = 27
N_FEATURES = OWN + len(TAGS) + 2 * len(KINDS)


def features(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node."""
    n = len(nodes)
    own = np.zeros((n, 6))  # characters, words, link characters, sentence ends, commas, text runs
    tags = np.ones(n)
    paragraphs = np.zeros(n)
    heading = np.zeros(n)
    for k, node in enumerate(nodes):
        c = w = link = ends = commas = 0
        for p in node.parts:
            if isinstance(p, int):
                continue
            s = p if isinstance(p, str) else p[0]
            c += len(s)
            w += s.count(" ") + 1 if len(s) > 1 else 0
            if p is not s:
                link += len(s)
            ends += s.count(".") + s.count("!") + s.count("?") + s.count("。")
            commas += s.count(",")
        own[k] = c, w, link, ends, commas, c > 1
        paragraphs[k] = node.tag == "p"
        if c and c < 60 and node.tag[0] == "h":
            heading[k] = bool(HEADINGS.match("".join(p if isinstance(p, str) else p[0] for p in node.parts if not isinstance(p, int)).strip()))
    total = own.copy()
    depth = np.zeros(n)
    parent = np.array([node.parent for node in nodes])
    for k in range(n - 1, 0, -1):
        q = parent[k]
        total[q] += total[k]
        tags[q] += tags[k]
        paragraphs[q] += paragraphs[k]
    x = np.zeros((n, N_FEATURES))
    mine, above = np.zeros((n, len(KINDS))), np.zeros((n, len(KINDS)))
    tag_at = {t: i for i, t in enumerate(TAGS)}
    hot = np.zeros((n, len(TAGS)))
    place, count, after, before, first_heading, prev_kind, linked = (np.zeros(n) for _ in range(7))
    in_edge = np.zeros(n)
    largest = np.ones(n)
    for k, node in enumerate(nodes):
        if k:
            depth[k] = depth[node.parent] + 1
            above[k] = np.maximum(above[node.parent], mine[node.parent])
            in_edge[k] = in_edge[node.parent]
        for kind in node.kinds:
            mine[k, kind] = 1
        if node.tag in tag_at:
            hot[k, tag_at[node.tag]] = 1
        if node.tag in ("nav", "footer", "aside", "form", "header"):
            in_edge[k] = 1
        kids = node.children
        if kids:
            most = max(total[j, 0] for j in kids)
            for i, j in enumerate(kids):
                place[j], count[j] = i, len(kids)
                largest[j] = total[j, 0] / most if most else 1
                before[j] = total[kids[i - 1], 0] if i else 0
                after[j] = total[kids[i + 1], 0] if i + 1 < len(kids) else 0
            first_heading[k] = heading[kids[0]]
            seen = 0.0
            for j in kids:
                prev_kind[j] = seen
                seen = max(seen, heading[j])
    root = max(1.0, total[0, 0])
    inherited = np.zeros(n)
    for k in range(1, n):
        q = parent[k]
        inherited[k] = max(inherited[q], first_heading[q], prev_kind[q])
    up = np.maximum(parent, 0)
    chars = np.maximum(total[:, 0], 1)
    x[:, :OWN] = np.column_stack([
        np.log1p(total[:, 0]), np.log1p(total[:, 1]), total[:, 2] / chars, total[:, 3] / np.maximum(total[:, 1], 1), total[:, 4] / np.maximum(total[:, 1], 1),
        np.log1p(total[:, 0] / tags), np.log1p(tags), np.log1p(paragraphs), total[:, 0] / root, np.log1p(own[:, 0]), own[:, 2] / np.maximum(own[:, 0], 1),
        np.minimum(depth, 30), np.log1p(place), place / np.maximum(count, 1), np.log1p(count), largest, np.log1p(before), np.log1p(after),
        np.log1p(total[up, 0]), total[up, 2] / np.maximum(total[up, 0], 1), np.log1p(paragraphs[up]), hot[up, 0] + hot[up, 1], in_edge,
        heading, np.maximum(first_heading, prev_kind), inherited, np.array([node.named for node in nodes], float),
    ])
    x[:, OWN : OWN + len(TAGS)] = hot
    x[:, OWN + len(TAGS) : OWN + len(TAGS) + len(KINDS)] = mine
    x[:, OWN + len(TAGS) + len(KINDS) :] = above
    return x


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """The kept nodes: the likeliest choice in which every kept node's parent is kept."""
    n = len(nodes)
    yes, no = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)
    dropped, kept = no.copy(), yes.copy()
    for k in range(n - 1, 0, -1):
        q = nodes[k].parent
        dropped[q] += dropped[k]
        kept[q] += max(kept[k], dropped[k])
    keep = np.zeros(n, bool)
    keep[0] = True
    for k in range(1, n):
        keep[k] = keep[nodes[k].parent] and kept[k] > dropped[k]
    return keep


def text_of(nodes: list[Node], keep: np.ndarray) -> str:
    """The blocks of kept nodes in page order."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if s := " ".join("".join(line).split()):
                blocks.append(s)
            line.clear()

    stack: list[tuple[int, int]] = [(0, 0)]
    while stack:
        k, i = stack.pop()
        node = nodes[k]
        parts = node.parts
        while i < len(parts):
            p = parts[i]
            i += 1
            if isinstance(p, int):
                if not keep[p]:
                    if nodes[p].tag in BLOCK:
                        flush()
                    continue
                stack.append((k, i))
                if nodes[p].tag in BLOCK:
                    flush()
                stack.append((p, 0))
                break
            if p == "\n":
                flush()
            else:
                line.append(p if isinstance(p, str) else p[0])
        else:
            if node.tag in BLOCK:
                flush()
    flush()
    return "\n".join(blocks)


@cache
def trained(pages: int = 1500, seed: int = 7, trees: int = 80) -> gbdt.Boosted:
    """The model, fitted on generated pages; the same each time."""
    from kelpie.llm import page_maker

    xs, ys = [], []
    for html, marks in page_maker.pages(pages, seed):
        nodes = parse(html)
        xs.append(features(nodes))
        ys.append(labels(nodes, marks))
    return gbdt.fit(np.concatenate(xs), np.concatenate(ys).astype(float), trees)


def labels(nodes: list[Node], main: set[str]) -> np.ndarray:
    """Which nodes hold main text: made pages mark every word of it with their own letter."""
    y = np.zeros(len(nodes), bool)
    for k in range(len(nodes) - 1, -1, -1):
        y[k] = y[k] or any(w.rstrip(".,;!?") in main for p in nodes[k].parts if not isinstance(p, int) for w in (p if isinstance(p, str) else p[0]).split())
        if y[k] and nodes[k].parent >= 0:
            y[nodes[k].parent] = True
    return y


def extract(htmls: list[str], model: gbdt.Boosted) -> Iterator[str]:
    """Main texts of pages, scored together."""
    trees = [parse(h) for h in htmls]
    xs = [features(t) for t in trees]
    logits = model.logits(np.concatenate(xs)) if xs else np.zeros(0)
    at = 0
    for nodes in trees:
        yield text_of(nodes, decode(nodes, logits[at : at + len(nodes)]))
        at += len(nodes)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def rows(batch: dict) -> Iterator[tuple]:
        htmls = [h or "" for h in batch["html"]]
        for at in range(0, len(htmls), 64):
            for k, t in enumerate(extract(htmls[at : at + 64], model.value), at):
                yield batch["page_id"][k], batch["url"][k], t, len(t)

    id_type = pages.schema["page_id"].dataType.simpleString()
    return map_rows(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), f"page_id {id_type}, url string, text string, n_chars long", rows, 256)
