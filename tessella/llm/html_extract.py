"""Main text of web pages by a tree-structured graphical model over the DOM.

Nodes are block elements and the runs of text between their bounds; inline elements are no nodes, but the
share of a run's text inside links is a feature. Each node is content or not. Its features (tag, words of
class and id, role, length and link share of its text) have a likelihood under either label, and a child's
label depends on its parent's: a hidden Markov tree, its tables counted on labelled pages. Messages go up
from the leaves and down from the root, over all pages of a chunk at once by depth; the product is each
node's exact marginal, and runs of text with a content marginal over one half are the main text.

Character references are decoded, white space inside a block becomes one blank, blocks are joined by \\n.

Defined cases: null html is an empty page with empty text; unclosed tags end with what holds them; `<` that
starts no tag is text; scripts, styles, templates and other unseen elements have no text. Without an end tag
of its own, script, style, title and textarea take the rest of the page as in HTML, the others end at the next
start or end of a block; an open head ends where text or a tag begins that a head can't hold, and `/>` closes
svg and math. A page without any tag is a single run; a run that is as likely content as not is left out; repeated rows
each get a row; an empty table gives an empty result; other columns are ignored. Very long pages go through a worker by
themselves, in time linear in their length. Labels are read from training pages only: `data-y` of other pages says nothing.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textbytes as tb
from tessella.session import ship

TRAINING_PAGES, SMOOTHING = 1200, 0.5
#: Powers of the likelihoods by kind of feature: those of one node aren't independent of each other.
WEIGHTS = {"t": 0.5, "n": 0.1, "l": 1.0, "c": 2.0, "u": 1.0}
_START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|data-y)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML: elements whose content is not seen as text, elements without content, and inline elements.
UNSEEN = frozenset("script style noscript template title textarea select button svg iframe object canvas audio video map head math datalist".split())
#: Unseen elements whose content is text alone, and what a head may hold.
_RAW = frozenset("script style textarea title".split())
_HEAD = frozenset("base basefont bgsound html head link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var picture".split())
#: A start tag ends an open element of the same group; the second set bounds how far up it looks.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|li|main|menu|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)(?=[\s/>])", re.I)
_AFTER_HEAD = re.compile(r"</head\b[^>]*>?|(?=<body\b)", re.I)


class Tags:
    """The tags and comments of a page, found in time linear in its length."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        #: Places outside quotes from which no `>` outside quotes follows.
        self.dead: set[int] = set()

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, lowered name, attributes) of the next one; a comment has no name."""
        page = self.page
        while m := _START.search(page, at):
            if m[2]:
                if (end := self._end(m.end())) > 0:
                    return m.start(), end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]
                at = m.end()
                continue
            mark = "-->" if m[0] == "<!--" else ">"
            end = page.find(mark, m.end())
            return m.start(), len(page) if end < 0 else end + len(mark), False, "", ""
        return None

    def _end(self, at: int) -> int:
        """Where the tag ends whose name ends at this place: after the first `>` outside quotes, else after the first one; 0 without any."""
        if at > self.last[">"]:
            return 0
        passed, p = [], at
        while p not in self.dead and (stop := _STOP.search(self.page, p)):
            c = stop[0]
            if c == ">":
                return stop.end()
            if stop.end() > self.last[c]:
                break
            passed.append(p)
            p = self.page.index(c, stop.end()) + 1
        self.dead.update(passed)
        self.dead.add(p)
        return self.page.index(">", at) + 1


class Nodes:
    """Nodes of one or more pages, parents before children; with labels where the pages are labelled ones."""

    def __init__(self, labelled: bool = False):
        self.labelled = labelled
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.names: list[list[str]] = []
        self.label: list[int] = []
        self.size: list[int] = []
        self.linked: list[int] = []
        self.text: list[str | None] = []
        self.tag: list[str] = []

    def add(self, parent: int, names: list[str], label: int = -1, text: str | None = None, linked: int = 0, tag: str = "") -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.names.append(names)
        self.label.append(label)
        self.size.append(len(text) if text else 0)
        self.linked.append(linked)
        self.text.append(text)
        self.tag.append(tag)
        return len(self.parent) - 1


def _names(attrs: str, labelled: bool) -> tuple[list[str], int]:
    """Feature names of an element, and its label if it has one."""
    names, label = [], -1
    if attrs and attrs.strip():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id"):
                names += sorted({"c=" + w.lower() for w in _NAME.findall(value)})
            elif key == "role":
                names.append("r=" + value.lower())
            elif key == "data-y":
                label = int(value) if labelled else -1
            elif key in ("hidden", "aria-hidden") and value != "false" or key == "style" and "display:none" in value.replace(" ", ""):
                names.append("hidden")
    return names, label


def _end_tag(tag: str, page: str, at: int) -> re.Match | None:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)


def _unseen_ends(page: str) -> dict[int, int]:
    """Where unseen elements with an end tag of their own end, by the end of their start tag; in one pass."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    at, tags = 0, Tags(page)
    while found := tags.after(at):
        _, at, closing, tag, attrs = found
        if tag not in UNSEEN or tag == "head":
            continue
        if closing:
            if opened.get(tag):
                ends[opened[tag].pop()] = at
        elif tag in _RAW:
            end = _end_tag(tag, page, at)
            if end is None:
                break
            ends[at] = at = end.end()
        elif not _closed(tag, attrs):
            opened.setdefault(tag, []).append(at)
    return ends


def _closed(tag: str, attrs: str) -> bool:
    return tag in ("svg", "math") and attrs.endswith("/")


def _after_head(page: str, tags: Tags, at: int) -> int:
    """Where a head ends that begins at this place."""
    n = len(page)
    end = _AFTER_HEAD.search(page, at)
    while True:
        if end and at > end.start():
            end = _AFTER_HEAD.search(page, at)
        stop, after = (end.start(), end.end()) if end else (n, n)
        found = tags.after(at)
        upto = min(stop, found[0]) if found else stop
        if page[at:upto].strip():
            return at
        if found is None or found[0] >= stop:
            return after
        start, at, closing, tag, _ = found
        if tag and not closing and tag not in _HEAD:
            return start
        if tag in UNSEEN and tag != "head" and not closing:
            close = _end_tag(tag, page, at)
            if close is None or close.start() > stop:
                block = None if end or tag in _RAW else _BLOCK.search(page, at)
                return block.start() if block else after
            at = close.end()


class _Stack:
    """The open elements; the lowest open one of a name is found without a search."""

    def __init__(self, root: int):
        self.open: list[tuple[str, int]] = [("#root", root)]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node))

    def lowest(self, names: Iterable[str]) -> int:
        """The place of the lowest open element of these names, 0 without any."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def close(self, place: int) -> None:
        """Ends the element at a place, and all that it holds; place 0 ends none."""
        while place and len(self.open) > place:
            self.places[self.open.pop()[0]].pop()


def parse(page: str, nodes: Nodes) -> None:
    """Appends the page's nodes; the root first."""
    stack = _Stack(nodes.add(-1, ["t=#root"], 1, tag="#root"))
    tags = Tags(page)
    run: list[str] = []
    linked, in_link, at, n = 0, 0, 0, len(page)
    ends: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                name, node = stack.open[-1]
                nodes.add(node, [f"t={name}>#text"], -1, text, min(linked, len(text)), "#text")
            run.clear()
        linked = 0

    while at < n:
        found = tags.after(at)
        start, end, closing, tag, attrs = found or (n, n, False, "", "")
        if start > at:
            run.append(page[at:start])
            if in_link:
                linked += start - at
        at = end
        if tag in UNSEEN:
            if not closing:
                if tag == "head":
                    at = _after_head(page, tags, at)
                elif not _closed(tag, attrs):
                    if ends is None:
                        ends = _unseen_ends(page)
                    block = None if at in ends or tag in _RAW else _BLOCK.search(page, at)
                    at = ends.get(at) or (block.start() if block else n)
                run.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
        elif tag in VOID:
            run.append(" ")
            if tag == "hr":
                flush()
        elif tag:
            flush()
            in_link = 0
            if closing:
                stack.close(stack.lowest((tag,)))
                continue
            if stack.open[-1][0] == "p":
                stack.close(len(stack.open) - 1)
            if tag in _ENDS:
                group, bound = _ENDS[tag]
                if (place := stack.lowest(group)) > stack.lowest(bound):
                    stack.close(place)
            if tag in ("html", "body"):
                continue
            above = stack.open[-1]
            names, label = _names(attrs, nodes.labelled)
            if tag in ("div", "section") and not any(x.startswith("c=") for x in names):
                names.append(f"u={above[0]}>{tag}")  # unnamed
            names.append(f"t={above[0]}>{tag}")
            stack.push(tag, nodes.add(above[1], names, label, tag=tag))
    flush()


def _total(nodes: Nodes) -> tuple[list[int], list[int]]:
    """Text and linked text below each node."""
    size, linked = list(nodes.size), list(nodes.linked)
    for i in range(len(size) - 1, -1, -1):
        p = nodes.parent[i]
        if p >= 0:
            size[p] += size[i]
            linked[p] += linked[i]
    return size, linked


def _measures(tag: str, size: int, linked: int) -> list[str]:
    return [f"n={tag},{min(size, 2000).bit_length() // 2}", f"l={tag},{0 if not linked else 1 + 4 * linked // (size + 1)}"]


class Model:
    """Log likelihoods of features by label, and the labels of children by that of the parent."""

    def __init__(self, pages: list[str], smoothing: float = SMOOTHING, weights: dict[str, float] | None = None):
        seen: list[Counter] = [Counter(), Counter()]
        moves = np.full((2, 2), 1.0)
        for page in pages:
            nodes = Nodes(labelled=True)
            parse(page, nodes)
            size, linked = _total(nodes)
            label = list(nodes.label)
            for i, p in enumerate(nodes.parent):
                if p >= 0:
                    label[i] = label[p] if label[i] < 0 else label[i] & label[p]
                    moves[label[p], label[i]] += 1
                for name in nodes.names[i] + _measures(nodes.tag[i], size[i], linked[i]):
                    seen[label[i]][name] += 1
        groups: list[Counter] = [Counter(), Counter()]
        for y in (0, 1):
            for name, c in seen[y].items():
                groups[y][name.partition("=")[0]] += c
        kinds = Counter(name.partition("=")[0] for name in set(seen[0]) | set(seen[1]))
        part = lambda y, name, kind: (seen[y][name] + smoothing) / (groups[y][kind] + smoothing * (kinds[kind] + 1))
        self.score = {}
        for name in set(seen[0]) | set(seen[1]):
            kind = name.partition("=")[0]
            self.score[name] = (weights or WEIGHTS).get(kind, 1.0) * math.log(part(1, name, kind) / part(0, name, kind))
        self.moves = np.log(moves / moves.sum(axis=1, keepdims=True))

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Content probability of each node: one pass of messages up and one down."""
        size, linked = _total(nodes)
        score = self.score
        odds = np.array([sum(score.get(f, 0.0) for f in names) + sum(score.get(f, 0.0) for f in _measures(t, s, k)) for names, t, s, k in zip(nodes.names, nodes.tag, size, linked, strict=True)])
        parent, depth = np.array(nodes.parent, np.int64), np.array(nodes.depth, np.int64)
        local = np.stack([np.zeros(len(odds)), odds], axis=1)  # log likelihood by label, up to a constant
        root = parent < 0
        local[root] += [-50.0, 0.0]  # a page as a whole may hold content
        order = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[order], np.arange(depth.max(initial=-1) + 2))
        up = local.copy()
        message = np.zeros_like(local)
        for d in range(len(edges) - 2, 0, -1):
            here = order[edges[d] : edges[d + 1]]
            message[here] = np.logaddexp(self.moves[:, 0] + up[here, :1], self.moves[:, 1] + up[here, 1:])
            np.add.at(up, parent[here], message[here])
        belief = up.copy()
        for d in range(1, len(edges) - 1):
            here = order[edges[d] : edges[d + 1]]
            rest = belief[parent[here]] - message[here]
            down = np.logaddexp(self.moves[0] + rest[:, :1], self.moves[1] + rest[:, 1:])
            belief[here] = up[here] + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def extract_texts(pages: list[str], model: Model) -> list[str]:
    nodes, first = Nodes(), []
    for page in pages:
        first.append(len(nodes.parent))
        parse(page, nodes)
    kept = model.marginals(nodes) > 0.5
    first.append(len(nodes.parent))
    return ["\n".join(nodes.text[i] for i in range(a, b) if nodes.text[i] and kept[i]) for a, b in zip(first, first[1:], strict=False)]


def trained(n: int = TRAINING_PAGES) -> Model:
    from tessella.llm.labelled_pages import pages

    return Model(pages(n))


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the columns of keep, text and n_chars."""
    ship(pages.sparkSession)
    model = model or trained()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for i, j, _, _ in tb.chunks(column):
                texts = extract_texts([x or "" for x in column.slice(i, j - i).to_pylist()], model)
                cols = [c.slice(i, j - i) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*(F.col(c) for c in keep), F.col(html_col).alias("__html"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "__html")
    return rows.mapInArrow(work, f"{schema}text string, n_chars long")
