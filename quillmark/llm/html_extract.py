"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree; each is content or not.
A node's own evidence (tag, words of class, id and role, text of its own) and
the tie between parent and child, which depends on the child's having a name
and on its share of linked text, are potentials with tables counted from labelled pages. Sum-product messages go up the tree and down again and give
each node's marginal; the text of the nodes that are likelier content than not
is the main text.

A page is read in one pass of a regex and scored in time linear in its nodes;
pages are independent, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import map_texts
from quillmark.llm.html_pages import PAGES

BLOCKS = set(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements whose content is never text of the page.
SKIPPED = set("head script style noscript template svg iframe select option button textarea datalist title".split())
#: Elements that may stand in a head; any other one ends it.
_HEAD = set("base link meta noscript script style template title".split())
_RAW = set("script style textarea title noscript iframe".split())
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag closes an open element of these kinds first.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An implied end does not reach past these.
_HOLD = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "html", "blockquote", "td", "th", "main", "aside", "nav", "header", "footer", "form"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>|[^<]+|<", re.S)
_LENIENT = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*>|[^<]+|<", re.S)
_OPENS = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
#: Blocks whose own text, outside of further blocks, is evidence.
_CONTAINERS = set("#bare body div section article main td center".split())
#: Blocks that are what the list, table or section is that they are part of.
_PARTS = set("li dt dd tr td th tbody thead tfoot h1 h2 h3 h4 h5 h6".split())
#: Tags that say as much as a name.
_NAMING = set("nav footer aside header".split())
_NAME = re.compile(r"[a-z]+")
PRIOR = 0.5


@dataclass
class Node:
    tag: str
    attrs: str
    parent: int
    pieces: int = 0
    linked: int = 0
    chars: int = 0
    said: bool = False
    children: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order, and text pieces ``(node, text)``, in linear time.

    A piece of ``None`` for text marks a block boundary. Node 0 is the root. A
    tag whose quotes never close ends at the next ``>``, and so do all after it.
    An unclosed title, textarea, noscript or iframe ends at the next tag, an
    unclosed script or style with the page.
    """
    nodes, pieces = [Node("#root", "", -1)], []
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # tag, block node, skipped
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag, in the stack
    holds, unclosed = [0], set()
    pos, end, last, token = 0, len(page), page.rfind(">"), _TOKEN

    bare = 0

    def place(text: str) -> int:
        """The node of a piece here; what stands outside of any block has a node of its own."""
        nonlocal bare
        node = stack[-1][1]
        if nodes[node].tag not in ("#root", "html") or not bare and text.isspace():
            return node
        if not bare:
            nodes.append(Node("#bare", "", node))
            bare = len(nodes) - 1
        return bare

    def say(text: str) -> None:
        if text and not stack[-1][2]:
            node = place(text)
            pieces.append((node, html.unescape(text) if "&" in text else text))
            nodes[node].chars += len(text)
            nodes[node].said = nodes[node].said or not text.isspace()
            nodes[node].linked += len(text) if places["a"] else 0

    def close(k: int) -> list[str]:
        gone = [t for t, _, _ in stack[k:]]
        for t in gone:
            places[t].pop()
        del stack[k:]
        while holds[-1] >= k:
            holds.pop()
        return gone

    while pos < end:
        if pos > last:  # no tag can end any more
            say(page[pos:])
            break
        m = token.match(page, pos)
        if m[0] == "<" and token is _TOKEN and _OPENS.match(page, pos):
            token = _LENIENT
            m = token.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or len(m[0]) == 1:
                say(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            k = places[tag][-1] if places[tag] else 0
            if k and (tag in BLOCKS or k >= holds[-1]):
                pieces += [(0, None)] * any(t in BLOCKS for t in close(k))
            if tag == "p":
                pieces.append((0, None))
            continue
        if places["head"] and tag not in _HEAD and tag != "head":
            close(places["head"][-1])
        closing = _CLOSES.get(tag) or ({"p"} if tag in BLOCKS else ())
        k = max((places[t][-1] for t in closing if places[t]), default=0)
        if k and k >= holds[-1]:
            close(k)
        if tag == "br":
            pieces.append((place(" "), " "))
            continue
        _, node, skipped = stack[-1]
        skipped = skipped or tag in SKIPPED
        if tag in BLOCKS:
            pieces.append((0, None))
            if not skipped:
                nodes.append(Node(tag, m[3] or "", node))
                nodes[node].children.append(len(nodes) - 1)
                node = len(nodes) - 1
        if tag in _VOID or (m[3] or "").endswith("/") and tag in ("svg", "path"):
            continue
        if tag in _RAW:
            found = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            if found:
                pos = found.end()
            else:
                unclosed.add(tag)
                stop = page.find("<", pos)
                pos = end if tag in ("script", "style") or stop < 0 else stop
            continue
        places[tag].append(len(stack))
        if tag in _HOLD:
            holds.append(len(stack))
        stack.append((tag, node, skipped))
    return nodes, pieces


@lru_cache(maxsize=20_000)
def _names(tag: str, attrs: str) -> tuple[str, ...]:
    out = set() if tag in _PARTS else {f"tag={tag}"}
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            out |= {f"name={w[:-1] if len(w) > 3 and w.endswith('s') else w}" for w in _NAME.findall(value)}
        elif name in ("hidden", "data-main", "data-rest") or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            out.add("hidden" if name not in ("data-main", "data-rest") else name)
    return tuple(sorted(out))


def _evidence(n: Node, parent: Node) -> tuple[str, ...]:
    got = tuple(f for f in _names(n.tag, n.attrs) if not f.startswith("data-"))
    if parent.tag in ("body", "html", "#root") and n.tag not in ("body", "html"):
        got += (f"top={n.tag}",)
    return got + (f"own={n.tag}",) if n.said and n.tag in _CONTAINERS else got


def _kind(n: Node) -> int:
    """Whether a node has a name, and how much of its own text is linked: nothing to all, in five steps, or no text."""
    named = n.tag in _NAMING or any(f.startswith("name=") for f in _names(n.tag, n.attrs))
    return (min(4, 5 * n.linked // n.chars) if n.said else 5) + 6 * named


def _cut(nodes: list[Node]) -> list[bool]:
    """Nodes that are no text whatever stands around them: hidden parts and forms, but for a form that wraps the page's heading or article."""
    holds = [n.tag in ("h1", "article", "main") for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] = holds[nodes[i].parent] or holds[i]
    out = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        out[i] = out[n.parent] or n.tag == "form" and not holds[i] or "hidden" in _names(n.tag, n.attrs)
    return out


@dataclass
class Model:
    odds: dict[str, float]  # P(feature | content) / P(feature | rest)
    #: P(child, its kind | parent), as [kind][parent][child]: links say little below content, and what is unnamed is like its parent.
    tie: tuple[tuple[tuple[float, float], tuple[float, float]], ...]
    root: float


def train(pages: list[str] = PAGES, smoothing: float = 0.2) -> Model:
    """Counts the tables of the model from pages with marked subtrees."""
    feature, totals = defaultdict(lambda: [0.0, 0.0]), [0.0, 0.0]
    tie = [[[0.5, 0.5], [0.5, 0.5]] for _ in range(12)]
    for page in pages:
        nodes, _ = parse(page)
        label, cut = [0] * len(nodes), _cut(nodes)
        for i, n in enumerate(nodes[1:], 1):
            if cut[i]:
                continue
            names = _names(n.tag, n.attrs)
            label[i] = 1 if "data-main" in names else 0 if "data-rest" in names else label[n.parent]
            tie[_kind(n)][label[n.parent]][label[i]] += 1
            totals[label[i]] += 1
            for f in _evidence(n, nodes[n.parent]):
                feature[f][label[i]] += 1
    odds = {f: (c[1] + smoothing) / (totals[1] + 2 * smoothing) / ((c[0] + smoothing) / (totals[0] + 2 * smoothing)) for f, c in feature.items()}
    odds["tag=#bare"] = 100.0  # text outside of blocks has no other evidence
    each = [[sum(t[p]) for t in tie] for p in (0, 1)]
    return Model(odds, tuple(tuple(tuple(t[p][c] / sum(each[p]) for c in (0, 1)) for p in (0, 1)) for t in tie), 0.05)


def marginals(nodes: list[Node], m: Model) -> list[float]:
    """P(content) of each node, by messages up the tree and down again; parts that are cut off send none and are no content."""
    n, cut = len(nodes), _cut(nodes)
    own = [1.0] * n  # likelihood ratio of the node's own evidence
    for i in range(1, n):
        r = 1.0
        for f in _evidence(nodes[i], nodes[nodes[i].parent]):
            r *= m.odds.get(f, 1.0)
        own[i] = min(max(r, 1e-9), 1e9)
    ties = [m.tie[_kind(x)] for x in nodes]
    up = [(1.0, 1.0)] * n  # message to the parent, for the parent's states
    below = [(1.0, x) for x in own]
    for i in range(n - 1, 0, -1):  # children come after their parents
        if cut[i]:
            continue
        (t00, t01), (t10, t11) = ties[i]
        b0, b1 = below[i]
        u0, u1 = t00 * b0 + t01 * b1, t10 * b0 + t11 * b1
        up[i] = (u0 / (u0 + u1), u1 / (u0 + u1))
        p0, p1 = below[nodes[i].parent]
        p0, p1 = p0 * up[i][0], p1 * up[i][1]
        below[nodes[i].parent] = (p0 / (p0 + p1), p1 / (p0 + p1))
    out = [0.0] * n
    belief = [(1 - m.root, m.root)] * n
    b0, b1 = below[0]
    z = b0 * (1 - m.root) + b1 * m.root
    belief[0] = (b0 * (1 - m.root) / z, b1 * m.root / z)
    for i in range(1, n):
        if cut[i]:
            belief[i] = (1.0, 0.0)
            continue
        (t00, t01), (t10, t11) = ties[i]
        p0, p1 = belief[nodes[i].parent]
        p0, p1 = p0 / max(up[i][0], 1e-12), p1 / max(up[i][1], 1e-12)  # without what this node said
        d0, d1 = p0 * t00 + p1 * t10, p0 * t01 + p1 * t11
        x0, x1 = d0 * below[i][0], d1 * below[i][1]
        belief[i] = (x0 / (x0 + x1), x1 / (x0 + x1))
        out[i] = belief[i][1]
    out[0] = belief[0][1]
    return out


def extract(page: str | None, m: Model) -> str:
    """Blocks of the content nodes, blanks collapsed, joined by an empty line."""
    if not page:
        return ""
    nodes, pieces = parse(page)
    content = [p >= PRIOR for p in marginals(nodes, m)]
    blocks, run = [], []
    for node, text in [*pieces, (0, None)]:
        if text is None:
            block = " ".join("".join(run).split())
            if block:
                blocks.append(block)
            run = []
        elif content[node]:
            run.append(text)
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``, a row per input row.

    A null or empty page, and one without content, has an empty text. Repeated
    rows are extracted each; other columns are not read.
    """
    model = train()

    def run(texts: list[str | None]) -> list[list]:
        text = [extract(h, model) for h in texts]
        return [text, [len(t) for t in text]]

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_texts(rows, run, [("text", pa.string()), ("n_chars", pa.int64())])
