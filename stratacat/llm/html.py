"""Operator 3: main text of web pages, by sum-product message passing over the page's tree."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from math import exp, log

from pyspark.sql import DataFrame

from stratacat.llm.common import map_batches, table

#: Elements whose content is no markup.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of these, up to the nearest scope.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in BLOCK - {"body", "html", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "legend", "summary"}} | {"tbody": {"thead", "tbody", "tr", "td", "th"}, "p": {"p"}}
SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form blockquote".split())
#: A quote counts only straight after =; anywhere else it is part of a name, as browsers read it, and the tag ends at its >.
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    names: str = ""
    parent: int = -1
    children: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)  # a block's own text, in pieces
    linked: int = 0  # characters of the text that stand in links


def parse(page: str) -> list[Node]:
    """The page's blocks as a tree, parents before children. Inline elements belong to their block; text between child blocks of a block gets a block of its own.

    Any text parses: unknown, unclosed and crossing tags are taken as browsers roughly do. Raw elements, comments and head matter give no text. Only blocks are kept open,
    with a count by tag, and each is closed once, so the work grows with the page.
    """
    nodes = [Node("#root")]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open blocks and their nodes
    opened: Counter[str] = Counter()
    at, size, link = 0, len(page), False
    into = -1  # the block that takes text now; -1: the next text opens one

    def put(raw: str) -> None:
        nonlocal into
        if not raw:
            return
        if into < 0:
            if raw.isspace():
                return
            into = len(nodes)
            nodes.append(Node("#text", "", stack[-1][1]))
            nodes[stack[-1][1]].children.append(into)
        text = entities.unescape(raw)
        nodes[into].text.append(text)
        if link:
            nodes[into].linked += len(text.strip())

    def close(k: int) -> None:
        """The open blocks from the k-th on are over."""
        nonlocal into, link
        for t, _ in stack[k:]:
            opened[t] -= 1
        del stack[k:]
        into, link = -1, False

    while at < size:
        m = _TAG.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = False
            elif opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in CLOSES and any(opened[t] > 0 for t in CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        if tag == "br":
            put(" ")
        elif tag == "a":
            link = True
        elif tag in BLOCK:
            into = -1
            if tag == "hr":
                continue
            names = " ".join((a[1] or a[2] or a[3] or a[0]).lower() for a in _ATTR.findall(m[3]) if a[0].lower() != "style" or "none" in a[1]) if m[3] else ""
            nodes.append(Node(tag, names, stack[-1][1]))
            nodes[stack[-1][1]].children.append(len(nodes) - 1)
            stack.append((tag, len(nodes) - 1))
            opened[tag] += 1
    return nodes


def features(nodes: list[Node], i: int) -> list[str]:
    """Of one node: its tag, the words of its class, id and role, and the length, links, form and neighbourhood of its text."""
    n = nodes[i]
    out = [f"tag={n.tag}", *{f"name={w[:12]}" for w in _WORD.findall(n.names)}]
    if n.tag == "#text":
        text = "".join(n.text).strip()
        words = len(text.split())
        out.append(f"words={0 if words < 4 else 1 if words < 9 else 2 if words < 20 else 3}")
        out.append(f"links={0 if not n.linked else 1 if 2 * n.linked < len(text) else 2}")
        out.append(f"end={text[-1:] in '.!?…:;»”\"'}")
        out.append(f"in={nodes[n.parent].tag}")
    elif n.children:
        texts = sum(nodes[c].tag == "#text" or nodes[c].tag == "p" for c in n.children)
        out.append(f"kids={min(3, texts)}")
    return out


#: Elements that group others. Content starts and ends at them; a paragraph or a text hardly ever differs from what it stands in.
GROUP = frozenset("#root html body div article main section aside nav header footer form center dialog fieldset ul ol table details figure".split())
Edge = tuple[tuple[float, float], tuple[float, float]]


class Model:
    """Potentials of the two states, 0 for boilerplate and 1 for content, of a node and of the edge from parent to child, by whether the child is a group."""

    def __init__(self, node: dict[str, float], edges: tuple[Edge, Edge]) -> None:
        self.node, self.edges = node, edges

    def local(self, nodes: list[Node], i: int) -> float:
        """Log odds of content by the node alone."""
        return max(-12.0, min(12.0, sum(self.node.get(f, 0.0) for f in features(nodes, i))))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of each node: messages go up from the leaves and down from the root; on a tree the product of a node's messages is exact."""
        phi = [(1.0, exp(self.local(nodes, i))) for i in range(len(nodes))]
        up: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)  # from a node to its parent
        inner: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)  # a node's potential times what came up to it

        def norm(a: float, b: float) -> tuple[float, float]:
            s = a + b
            return (max(a / s, 1e-300), max(b / s, 1e-300))

        for i in range(len(nodes) - 1, -1, -1):
            a, b = norm(*phi[i])
            for c in nodes[i].children:
                a, b = norm(a * up[c][0], b * up[c][1])
            inner[i] = (a, b)
            e = self.edges[nodes[i].tag in GROUP]
            up[i] = norm(e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b)
        out = [0.0] * len(nodes)
        down: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)
        for i, n in enumerate(nodes):
            a, b = norm(inner[i][0] * down[i][0], inner[i][1] * down[i][1])
            out[i] = b
            for c in n.children:
                x, y = norm(a / up[c][0], b / up[c][1])
                e = self.edges[nodes[c].tag in GROUP]
                down[c] = norm(x * e[0][0] + y * e[1][0], x * e[0][1] + y * e[1][1])
        return out


def fit(pages: list[str], smooth: float = 0.5, text_weight: float = 0.5) -> Model:
    """Potentials from labelled pages: elements with the attribute data-main hold content, those inside them with data-rest don't.

    A node's potential adds up the log ratios of its features' smoothed frequencies in the two states, those of texts by text_weight, since a text's features depend
    on each other more than an element's; an edge's is the smoothed frequency of the child's state by the parent's.
    """
    counts: dict[str, list[float]] = {}
    totals = {False: [0.0, 0.0], True: [0.0, 0.0]}  # of texts and of elements
    moves = {False: [[smooth, smooth], [smooth, smooth]], True: [[smooth, smooth], [smooth, smooth]]}
    for page in pages:
        marked = re.sub(r'data-(main|rest)', r'role="data-\1"', page)
        nodes = parse(marked)
        state = [0] * len(nodes)
        for i, n in enumerate(nodes):
            state[i] = 1 if "data-main" in n.names else 0 if "data-rest" in n.names else state[n.parent] if n.parent >= 0 else 0
            n.names = n.names.replace("data-main", "").replace("data-rest", "")
        for i, n in enumerate(nodes):
            totals[n.tag != "#text"][state[i]] += 1
            for f in features(nodes, i):
                counts.setdefault(f, [0.0, 0.0])[state[i]] += 1
            if n.parent >= 0:
                moves[n.tag in GROUP][state[n.parent]][state[i]] += 1
    node = {}
    for f, (a, b) in counts.items():
        of_text = f.startswith(("words=", "links=", "end=", "in=", "tag=#text"))
        none, all_ = totals[not of_text]
        node[f] = (text_weight if of_text else 1.0) * log((b + smooth) / (all_ + 2 * smooth) * (none + 2 * smooth) / (a + smooth))
    edges = tuple(tuple((a / (a + b), b / (a + b)) for a, b in moves[k]) for k in (False, True))
    return Model(node, edges)


def main_text(page: str | None, model: Model, least: float = 0.5) -> str:
    """The texts of the blocks whose marginal is least or more, in page order, white space within one made single, joined by two newlines."""
    nodes = parse(page or "")
    p = model.marginals(nodes)
    blocks = (_SPACE.sub(" ", "".join(n.text)).strip() for n, x in zip(nodes, p, strict=True) if n.text and x >= least)
    return "\n\n".join(b for b in blocks if b)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text of every row of pages; a page without content, empty or null, has an empty text. One pass, no shuffle."""
    model = model or trained()

    def run(c: dict[str, list]) -> dict[str, list]:
        return {"page_id": c["page_id"], "url": c["url"], "text": [main_text(h, model) for h in c["html"]]}

    return map_batches(pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html")), run, "page_id long, url string, text string")


def trained() -> Model:
    from stratacat.llm.html_pages import LABELLED

    return fit(LABELLED)


def op3(spark, sf_dir: str) -> DataFrame:
    """A row for each row of pages, repeated ones too, with the main text of its whole html. A null or empty html, or one without content, has an empty text and 0 characters; a null url or id stays null. Any markup gives a text: nothing is malformed. No rows give none."""
    from pyspark.sql import functions as F

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
