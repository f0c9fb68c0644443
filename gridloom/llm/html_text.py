"""Main text of web pages by a tree-structured graphical model.

Every block element is a node with two states, main text or not. Its tag, the words of its class, id and role, and the
amount, punctuation and link share of its own text speak for a state, and, for pages whose names say nothing, so do the share of the page's
text that lies in it, how much of that is in links, and how much it holds of sentences; a parent-child potential ties it to the element
around it. Sum-product messages go up and down the tree once, and the exact marginal of a block's element decides
on the block. The potentials start from shares counted on labelled pages (those of ``labelled_pages``, and at
most ``sample`` pages of the table, whose semantic elements label what lies below them) and are then fitted to the labels by
gradient steps, for which the same messages give the expectations.

Inline elements do not make blocks; ``br`` counts as white space. Character references are decoded; white space of any kind
inside a block becomes one space; blocks are joined in page order by one newline. Scripts, styles, templates, form controls
and the head are never text. Unclosed and wrongly nested elements close as their blocks do: of a hidden element without its end tag
only the text right in it is lost, not the blocks behind.

Defined results: a NULL or empty page gives an empty text of 0 characters; rows that repeat a ``page_id`` or have NULL are read one
by one; an empty table gives no rows; columns other than ``page_id, url, html`` are ignored. Pages are read whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.labelled_pages import build

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
# Element kinds of HTML.
RAW = frozenset("script style textarea title iframe xmp noembed noframes head".split())
HIDDEN = frozenset("noscript template svg math select option button object canvas audio video".split())
#: Tags whose start or end closes an open option; a start tag that closes an open element of another kind.
AFTER_OPTION, CLOSED_BY = frozenset("option optgroup datalist select".split()), {"button": "button", "select": "select", "input": "select", "textarea": "select"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "body main article section nav aside header footer address div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote"
    " figure figcaption table thead tbody tfoot tr td th caption form fieldset legend details summary dialog menu center hr".split()
)
CLOSES_P = BLOCKS - {"body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
    "tbody": {"table"}, "tfoot": {"table"},
}
#: Elements whose meaning labels a page of the table, outermost first.
CONTENT, OTHER = frozenset({"article"}), frozenset({"nav", "footer", "aside", "form"})


class Node:
    __slots__ = ("parent", "tag", "words", "label", "top", "chars", "linked", "stops", "shape")

    def __init__(self, parent: int, tag: str, words: tuple[str, ...], label: int | None, top: bool = False):
        self.parent, self.tag, self.words, self.label, self.top = parent, tag, words, label, top
        self.chars = self.linked = self.stops = 0
        self.shape = ""


def _attributes(text: str) -> tuple[tuple[str, ...], int | None]:
    words, label = [], None
    for name, a, b, c in ATTRIBUTE.findall(text):
        value = a or b or c
        if name.lower() == "data-y":
            label = int(value == "1")
        else:
            words += [w.lower() for w in PART.findall(value)]
    return tuple(dict.fromkeys(words)), label


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order (a parent before its children) and text blocks with their element."""
    nodes = [Node(-1, "page", (), None)]
    blocks: list[tuple[int, str]] = []
    stack, buffer, at, link, linked = [0], [], 0, False, 0
    hidden: list[tuple[str, int, int, int]] = []  # open hidden elements: tag, and how many open elements, nodes and blocks were before

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                node = nodes[stack[-1]]
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.stops += sum(map(text.count, ".,;:!?"))
                blocks.append((stack[-1], text))
        linked = 0

    def close(tags: set[str] | frozenset[str], scope: set[str] | frozenset[str] = frozenset(), lowest: int = 1) -> None:
        """Ends the innermost open element of ``tags``, unless one of ``scope`` lies inside or it lies below ``lowest``."""
        for depth in range(len(stack) - 1, lowest - 1, -1):
            tag = nodes[stack[depth]].tag
            if tag in tags:
                flush()
                del stack[depth:]
                while hidden and hidden[-1][1] > depth:  # left open
                    hidden.pop()
                return
            if tag in scope:
                return

    def show(tag: str) -> None:
        """Ends an open hidden element without its end tag: its blocks stay."""
        for k in range(len(hidden) - 1, -1, -1):
            if hidden[k][0] == tag:
                del hidden[k]
                return

    def hide(tag: str) -> None:
        """Ends an open hidden element by its end tag, with all that is in it."""
        for k in range(len(hidden) - 1, -1, -1):
            if hidden[k][0] == tag:
                _, depth, first, mark = hidden[k]
                if stack[-1] >= first:
                    flush()
                    del stack[depth:]
                blocks[mark:] = [b for b in blocks[mark:] if b[0] < first]
                del nodes[first:], hidden[k:]
                return

    end = len(page)
    while at < end:
        begin = page.find("<", at)
        found = TOKEN.match(page, begin) if begin >= 0 else None
        text = page[at : end if begin < 0 else begin]
        if text and not (hidden and stack[-1] < hidden[-1][2]):
            buffer.append(text)
            linked += len(text) if link else 0
        if begin < 0:
            break
        if not found:  # a lone sign
            if not (hidden and stack[-1] < hidden[-1][2]):
                buffer.append("<")
            at = begin + 1
            continue
        at = found.end()
        closing, tag, rest = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in AFTER_OPTION and hidden and hidden[-1][0] == "option" and not (closing and tag == "option"):
            show("option")
        if not closing and tag in CLOSED_BY:
            show(CLOSED_BY[tag])
        if tag in HIDDEN or tag == "foreignobject":
            if closing:
                hide(tag)
            elif not rest.endswith("/") and (tag != "foreignobject" or hidden):
                hidden.append((tag, len(stack), len(nodes), len(blocks)))
                buffer.append(" ")
        elif tag in RAW:
            if not closing and not rest.endswith("/"):
                behind = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = behind.end() if behind else (at if tag == "head" else end)
                buffer.append(" ")
        elif tag in BLOCKS:
            flush()
            link = False
            if closing:
                close({tag}, {"table", "article", "section", "main", "body"} - {tag} if tag != "body" else frozenset())
            else:
                while hidden and hidden[-1][0] in ("svg", "math"):  # blocks end drawings and formulas
                    hidden.pop()
                lowest = hidden[-1][1] if hidden else 1
                if tag in CLOSES_P:
                    close({"p"}, {"div", "td", "th", "li", "section", "article", "blockquote", "table", "main", "aside"}, lowest)
                if tag in SIBLINGS:
                    while any(nodes[s].tag in SIBLINGS[tag] for s in stack[1:]):
                        before = len(stack)
                        close(SIBLINGS[tag], SCOPES[tag], lowest)
                        if len(stack) == before:
                            break
                words, label = _attributes(rest) if rest else ((), None)
                if label is None:
                    label = nodes[stack[-1]].label
                nodes.append(Node(stack[-1], tag, words, label, nodes[stack[-1]].tag in ("page", "body")))
                if tag not in VOID:
                    stack.append(len(nodes) - 1)
        elif tag == "a":
            link = not closing
        elif tag == "br":
            buffer.append(" ")
    flush()
    shapes(nodes)
    return nodes, blocks


def shapes(nodes: list[Node]) -> None:
    """Gives elements that hold others what can be said of them without names: share of the page's text, of links, of sentences."""
    chars, linked, stops = ([getattr(node, name) for node in nodes] for name in ("chars", "linked", "stops"))
    inner = [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        parent = nodes[i].parent
        inner[parent] = True
        chars[parent] += chars[i]
        linked[parent] += linked[i]
        stops[parent] += stops[i]
    for i in range(1, len(nodes)):
        n = chars[i]
        if inner[i] and n:
            share = 0 if n * 20 < chars[0] else 1 if n * 5 < chars[0] else 2 if n * 2 < chars[0] else 3
            links = 0 if linked[i] * 10 < n else 1 if linked[i] * 2 < n else 2
            nodes[i].shape = f"shape {share} {links} {int(stops[i] * 100 >= n)} {int(n >= 400)}"


def features(node: Node) -> list[str]:
    """What speaks for a state: tag (and whether it lies right in the body), attribute words, the kind of own text and of what it holds."""
    n = node.chars
    size = 0 if not n else 1 if n < 25 else 2 if n < 80 else 3 if n < 250 else 4
    top = [f"top {node.tag}"] if node.top else []
    share = "-" if not n else "all" if node.linked * 3 > n * 2 else "some" if node.linked else "none"
    shape = [node.shape] if node.shape else []
    return [f"tag {node.tag}", f"text {size} {share} {int(node.stops > 0)}", *shape, *top, *(f"word {w}" for w in node.words)]


class Model:
    """Potentials: a weight per feature for main text, and per pair of parent and child state."""

    TEXT_WEIGHT = 0.35  # own texts of neighbours say much the same, so each counts for less at first

    def __init__(self, counts: Counter, smoothing: float = 0.2):
        totals = [counts["node", y] for y in (0, 1)]
        self.start = math.log((totals[1] + 1) / (totals[0] + 1))
        self.odds: dict[str, float] = {}
        for key in {k[1] for k in counts if k[0] == "feature"}:
            share = [(counts["feature", key, y] + smoothing) / (totals[y] + 2 * smoothing) for y in (0, 1)]
            weight = self.TEXT_WEIGHT if key.startswith("text") else 1.0
            self.odds[key] = weight * math.log(share[1] / share[0])
        self.step = []
        for p in (0, 1):
            row = [counts["pair", p, y] + 0.5 for y in (0, 1)]
            self.step += [math.log(v / sum(row)) for v in row]
        self.known: dict[tuple, float] = {}

    def evidence(self, node: Node) -> float:
        key = tuple(features(node))
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            total = sum(self.odds.get(k, 0.0) for k in key)
            self.known[key] = math.exp(max(-25.0, min(25.0, total)))
        return self.known[key]

    def marginals(self, nodes: list[Node], pairs: list[float] | None = None) -> list[float]:
        """Probability of main text for each node, by one upward and one downward pass.

        ``pairs`` gets the expected numbers of the four pairs of parent and child state added.
        """
        n = len(nodes)
        low, high = [1.0] * n, [self.evidence(node) for node in nodes]
        t00, t01, t10, t11 = map(math.exp, self.step)
        up0, up1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            a, b = low[i], high[i]
            scale = a + b
            a, b = a / scale, b / scale
            low[i], high[i] = a, b
            m0, m1 = t00 * a + t01 * b, t10 * a + t11 * b
            up0[i], up1[i] = m0, m1
            parent = nodes[i].parent
            x, y = low[parent] * m0, high[parent] * m1
            scale = x + y
            low[parent], high[parent] = x / scale, y / scale
        x, y = low[0], high[0] * math.exp(self.start)
        low[0], high[0] = x / (x + y), y / (x + y)
        for i in range(1, n):
            parent = nodes[i].parent
            # the parent's belief without what came from here
            x, y = low[parent] / up0[i], high[parent] / up1[i]
            if pairs is not None:
                joint = [x * t00 * low[i], x * t01 * high[i], y * t10 * low[i], y * t11 * high[i]]
                for k in range(4):
                    pairs[k] += joint[k] / sum(joint)
            a, b = low[i] * (x * t00 + y * t10), high[i] * (x * t01 + y * t11)
            low[i], high[i] = a / (a + b), b / (a + b)
        return high

    def refine(self, pages: list[list[Node]], rounds: int = 60, rate: float = 0.3, decay: float = 0.05) -> None:
        """Gradient ascent on the likelihood of the labels: what the labels say less what the messages expect."""
        keys = [[features(node) for node in nodes] for nodes in pages]
        spent: Counter = Counter()

        def move(table, key, gradient: float) -> None:
            gradient -= (decay if table is not self.odds or not key.startswith("text") else 40 * decay) * table[key]
            spent[key] += gradient * gradient
            table[key] += rate * gradient / math.sqrt(spent[key] + 1e-8)

        for _ in range(rounds):
            unary: Counter = Counter()
            pairs = [0.0] * 4
            for nodes, own in zip(pages, keys):
                expected = [0.0] * 4
                chance = self.marginals(nodes, expected)
                for i, node in enumerate(nodes):
                    for key in own[i] if i else ():
                        unary[key] += (node.label or 0) - chance[i]
                    if i:
                        pairs[2 * (nodes[node.parent].label or 0) + (node.label or 0)] += 1
                pairs = [a - b for a, b in zip(pairs, expected)]
            for key, gradient in unary.items():
                move(self.odds, key, gradient)
            for k in range(4):
                move(self.step, k, pairs[k])
            self.known.clear()

    def text(self, page: str | None, threshold: float = 0.5) -> str:
        if not page:
            return ""
        nodes, blocks = parse(page)
        chance = self.marginals(nodes)
        return "\n".join(text for node, text in blocks if chance[node] >= threshold)


def tally(nodes: list[Node], into: Counter) -> None:
    """Counts labelled nodes, their features, and pairs of parent and child state."""
    for node in nodes[1:]:
        if node.label is None:
            continue
        into["node", node.label] += 1
        for key in features(node):
            into["feature", key, node.label] += 1
        parent = nodes[node.parent]
        into["pair", parent.label if parent.label is not None else 0, node.label] += 1


def labelled_by_meaning(nodes: list[Node]) -> list[Node]:
    """Labels below semantic elements: main text in an article, other text in menus, footers, sidebars and forms."""
    for node in nodes[1:]:
        above = nodes[node.parent].label
        node.label = 0 if node.tag in OTHER else 1 if node.tag in CONTENT and above is None else above
        if node.label == 1 and node.words:
            node.label = None  # a named box inside an article may be anything
    return nodes


def train(pages: DataFrame | None = None, sample: int = 300, weight: float = 0.02) -> Model:
    """The model of the labelled pages, and of at most ``sample`` pages of a table, each of which counts ``weight`` times."""
    counts: Counter = Counter()
    labelled = [parse(page)[0] for page in build()]
    for nodes in labelled:
        tally(nodes, counts)
    if pages is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own: Counter = Counter()
                for page in batch.column("html").to_pylist():
                    tally(labelled_by_meaning(parse(page or "")[0]), own)
                rows = [(k[0], str(k[1]), k[2] if len(k) > 2 else -1, n) for k, n in own.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))],
                    names=["kind", "name", "state", "n"],
                )

        chosen = pages.select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id").select("page_id").limit(sample)
        few = pages.select("page_id", "html").join(F.broadcast(chosen.distinct()), "page_id")  # at most ``sample`` ids
        # the features of a bounded number of pages
        for row in few.select("html").mapInArrow(run, "kind string, name string, state int, n bigint").groupBy("kind", "name", "state").agg(F.sum("n").alias("n")).collect():
            kind, name, state, n = row
            key = (kind, int(name)) if kind == "node" else (kind, int(name), state) if kind == "pair" else (kind, name, state)
            counts[key] += weight * n
    model = Model(counts)
    model.refine(labelled)
    return model


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                texts = [model.text(page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    chosen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return chosen.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
