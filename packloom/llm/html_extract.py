"""Main text of HTML pages by inference on the DOM tree.

Every block-level element is a variable: content, other, or the frame around both. Its features (tag,
words of class, id and role, share of linked text, amount of own text) give a potential for each state,
parent and child share a potential that depends on what kind of element the child is. Sum-product messages run upwards and then
downwards, which gives the exact marginals of the tree; text of elements whose marginal reaches one half
is kept. The potentials are counts over labelled pages (``html_labels``). Text that stands right in the body, or
next to block elements, is an anonymous paragraph, as in a browser, and so a variable of its own.

Defined cases: a null or empty page, or one without content, has an empty text. Unclosed and stray tags
are repaired as browsers do for block elements; a page that breaks off ends there. Script, style and
other elements that show no text are left out with their content. Raw text and templates without an end
tag reach to the end of the page; the others end where an element around them does, drawings and formulas
also at the next block tag. A head has no text of its own but what a browser would move to the body. White space is what str.split()
takes for it. Repeated rows are pages of their own, an empty table gives an empty result, other columns
are left out.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.common import begin
from packloom.llm.html_labels import labelled_pages

# Classes of HTML elements.
_BLOCKS = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "caption label button".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = set("script style noscript template title iframe svg math select textarea object canvas audio video datalist".split())
_RAW = set("script style title textarea noscript iframe".split())
# Unseen elements that end with an element around them; in drawings and formulas only some hold blocks.
_ENCLOSED = _UNSEEN - _RAW - {"template"}
_DRAWN = {"svg", "math"}
_HOLDS_BLOCKS = set("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_ENDS_P = _BLOCKS - {"html", "body", "label", "button"}
# A start tag closes an open element of these kinds, looked for up to the nearest element of the second set.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "p": ({"p"}, {"td", "th", "li", "div", "article", "section", "table", "button", "blockquote"}),
}
# Elements whose own text is no part of them.
_BARE = {"#page", "html", "body"}
_FLOW = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th caption figcaption".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")


# States of an element: around content and other parts, part of the text, part of something else.
FRAME, CONTENT, OTHER = STATES = (0, 1, 2)


class Node:
    """A block-level element."""

    __slots__ = ("chars", "label", "linked", "names", "own", "parent", "tag")

    def __init__(self, tag: str, parent: int, names: tuple[str, ...], label: int):
        self.tag, self.parent, self.names, self.label = tag, parent, names, label
        self.chars = self.linked = self.own = 0


@functools.lru_cache(4096)
def _names(attributes: str) -> tuple[str, ...]:
    found = " ".join(_NAMES.findall(attributes)).lower()
    return tuple(dict.fromkeys(_WORD.findall(found)))


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block-level elements, parents first, and the text blocks in page order with the element they lie in."""
    nodes = [Node("#page", -1, (), 0)]
    runs: list[tuple[int, str, int]] = []  # element, text, linked characters
    stack = [0]
    open_tags: Counter = Counter()
    last_ends: dict[str, int] = {}
    pieces: list[str] = []
    state = [0, 0]  # open links, linked characters of the block

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                runs.append((stack[-1], text, min(state[1], len(text))))
        state[1] = 0

    def say(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if state[0]:
                state[1] += len(text)

    def close(kinds: set[str], stop: set[str] | frozenset = frozenset()) -> bool:
        if not any(open_tags[kind] for kind in kinds):
            return False
        for depth in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[depth]].tag
            if tag in kinds:
                flush()
                for i in stack[depth:]:
                    open_tags[nodes[i].tag] -= 1
                del stack[depth:]
                state[0] = 0
                return True
            if tag in stop:
                return False
        return False

    def closes_open(tag: str, inner: Counter) -> bool:
        """True if a start tag closes an open element without an end tag, with no element of ``inner`` in between."""
        for kinds, stop in ([_SIBLINGS["p"]] if tag in _ENDS_P else []) + ([_SIBLINGS[tag]] if tag in _SIBLINGS else []):
            if any(inner[kind] for kind in kinds | stop) or not any(open_tags[kind] for kind in kinds):
                continue
            for i in reversed(stack):
                if nodes[i].tag in kinds:
                    return True
                if nodes[i].tag in stop:
                    break
        return False

    def beyond(tag: str, at: int) -> int:
        """Where an enclosed element ends whose start tag ends at ``at``.

        That is after its end tag, unless an element around it ends before; then it is where the first tag stands
        that could not be inside.
        """
        opened: list[str] = []
        inner: Counter = Counter()
        first = -1
        if tag not in last_ends:
            last_ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
        while (at := page.find("<", at)) >= 0:
            if first >= 0 and at > last_ends[tag]:
                return first  # no end tag follows
            token = _TOKEN.match(page, at)
            if token is None:
                at += 1
                continue
            closing, name, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
            name = (name or "").lower()
            if name and closing:
                if inner[name]:
                    while (last := opened.pop()) != name:
                        inner[last] -= 1
                    inner[name] -= 1
                elif name == tag:
                    return token.end()
                elif open_tags[name]:
                    return first if first >= 0 else at
                elif first < 0:
                    first = at
            elif name:
                if first >= 0 and name == tag:
                    return first
                bare = tag not in _DRAWN or any(inner[kind] for kind in _HOLDS_BLOCKS)
                if first < 0 and ((not bare and name in _BLOCKS) or closes_open(name, inner)):
                    first = at
                if name in _RAW and tag not in _DRAWN:
                    over = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, token.end())
                    at = over.end() if over else end
                    continue
                if name not in _VOID and not attributes.endswith("/"):
                    opened.append(name)
                    inner[name] += 1
            at = token.end()
        return first if first >= 0 else end

    at, end = 0, len(page)
    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            say(page[at:])
            break
        token = _TOKEN.match(page, mark)
        if token is None:
            say(page[at : mark + 1])
            at = mark + 1
            continue
        say(page[at:mark])
        at = token.end()
        closing, tag, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in _BLOCKS:
                close({tag})
            elif tag == "a":
                state[0] = 0
            continue
        if tag in _UNSEEN:
            if not attributes.endswith("/") or tag in _RAW:
                pieces.append(" ")
                if tag in _ENCLOSED:
                    at = beyond(tag, at)
                else:
                    over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    at = over.end() if over else end
            continue
        if tag == "a":
            state[0] = 1
        elif tag == "br" or tag == "img":
            pieces.append(" ")
        if tag not in _BLOCKS:
            continue
        if tag in _ENDS_P:
            close({"p"}, _SIBLINGS["p"][1])
        if tag in _SIBLINGS:
            close(*_SIBLINGS[tag])
        flush()
        if tag in _VOID:
            continue
        parent = nodes[stack[-1]]
        marked = CONTENT if "data-main" in attributes else OTHER if "data-other" in attributes else parent.label
        nodes.append(Node(tag, stack[-1], _names(attributes) if attributes else (), marked))
        stack.append(len(nodes) - 1)
        open_tags[tag] += 1
    flush()
    blocks = []
    mixed = {node.parent for node in nodes} | {i for i, node in enumerate(nodes) if node.tag in _BARE}
    for at, text, linked in runs:
        if at in mixed:
            nodes.append(Node("p", at, (), nodes[at].label))
            at = len(nodes) - 1
        blocks.append((at, text))
        nodes[at].own += len(text)
        nodes[at].chars += len(text)
        nodes[at].linked += linked
    for node in reversed(nodes[1:]):
        nodes[node.parent].chars += node.chars
        nodes[node.parent].linked += node.linked
    return nodes, blocks


_LINKED = ("linked:0", "linked:1", "linked:2", "linked:3", "linked:none")
_OWN = tuple(f"own:{i}" for i in range(33))


def _features(node: Node) -> list[str]:
    share = min(10 * node.linked // node.chars, 6) // 2 if node.chars else 4
    return [*_spelled(node.tag, node.names), _LINKED[share], _OWN[node.own.bit_length() // 2]]


@functools.lru_cache(4096)
def _spelled(tag: str, names: tuple[str, ...]) -> tuple[str, ...]:
    return (f"tag:{tag}", *(f"name:{name}" for name in names), *(() if names else ("name:none",)))


class Model:
    """Log-potentials: of a state by feature, and of parent and child states by the child's kind.

    Those of parent and child are shares among the labelled pages. Those of the features are fitted by
    gradient steps on the likelihood of the labels given the pages: label counts less the marginals.
    """

    def __init__(self, pages: Iterable[str], steps: int = 40, rate: float = 0.5, smooth: float = 0.3):
        parsed = [parse(page)[0] for page in pages]
        pairs: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for nodes in parsed:
            for node in nodes[1:]:
                pairs[node.tag in _FLOW][nodes[node.parent].label, node.label] += 1
        self.pair = {}
        for flow, n in pairs.items():
            rows = [[n[parent, child] + smooth for child in STATES] for parent in STATES]
            self.pair[flow] = [[x / sum(row) for x in row] for row in rows]
        # A feature that was never seen says nothing.
        self.unary: dict[str, list[float]] = {}
        described = [[tuple(_features(node)) for node in nodes] for nodes in parsed]
        for features in described:
            for node in features:
                for feature in node:
                    self.unary.setdefault(feature, [0.0] * 3)
        past = {feature: [1e-6] * 3 for feature in self.unary}
        for _ in range(steps):
            slope = {feature: [0.0] * 3 for feature in self.unary}
            for nodes, features in zip(parsed, described, strict=True):
                for node, belief, own in zip(nodes[1:], self.beliefs(nodes)[1:], features[1:], strict=True):
                    if belief[node.label] < 0.999:
                        left = [(s == node.label) - belief[s] for s in STATES]
                        for feature in own:
                            for s in STATES:
                                slope[feature][s] += left[s]
            for feature, sums in slope.items():
                weights, squares = self.unary[feature], past[feature]
                for s in STATES:
                    g = sums[s] - 0.05 * weights[s]
                    squares[s] += g * g
                    weights[s] += rate * g / math.sqrt(squares[s])

    def beliefs(self, nodes: list[Node]) -> list[tuple[float, float, float]]:
        """Marginals of the states of every element: messages up to the page, then down again."""
        unary, pair = self.unary, self.pair
        # Log-evidence of an element's features and of the subtrees below it, by state.
        below = [[0.0, 0.0, 0.0] for _ in nodes]
        up = [(0.0, 0.0, 0.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            node, logs = nodes[i], below[i]
            for feature in _features(node):
                if (x := unary.get(feature)) is not None:
                    logs[0] += x[0]
                    logs[1] += x[1]
                    logs[2] += x[2]
            top = max(logs)
            logs[0] -= top
            logs[1] -= top
            logs[2] -= top
            e0, e1, e2 = map(math.exp, logs)
            r, q, t = pair[node.tag in _FLOW]
            m0 = math.log(r[0] * e0 + r[1] * e1 + r[2] * e2)
            m1 = math.log(q[0] * e0 + q[1] * e1 + q[2] * e2)
            m2 = math.log(t[0] * e0 + t[1] * e1 + t[2] * e2)
            up[i] = (m0, m1, m2)
            above = below[node.parent]
            above[0] += m0
            above[1] += m1
            above[2] += m2
        belief = [(1.0, 0.0, 0.0)] * len(nodes)  # the page itself frames its content
        for i in range(1, len(nodes)):
            node = nodes[i]
            # The parent's belief without what this child told it.
            a, b, c = belief[node.parent]
            m0, m1, m2 = up[i]
            a, b, c = a * math.exp(-m0), b * math.exp(-m1), c * math.exp(-m2)
            r, q, t = pair[node.tag in _FLOW]
            e0, e1, e2 = below[i]
            x = (a * r[0] + b * q[0] + c * t[0]) * math.exp(e0)
            y = (a * r[1] + b * q[1] + c * t[1]) * math.exp(e1)
            z = (a * r[2] + b * q[2] + c * t[2]) * math.exp(e2)
            total = x + y + z or 1.0
            belief[i] = (x / total, y / total, z / total)
        return belief

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for every element."""
        return [belief[CONTENT] for belief in self.beliefs(nodes)]


@functools.cache
def trained_model() -> Model:
    return Model(labelled_pages())


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes, blocks = parse(page)
    chances = model.marginals(nodes)
    return "\n".join(text for node, text in blocks if chances[node] >= 0.5)


def extract(
    pages: DataFrame, model: Model | None = None, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Rows ``page_id, url, text, n_chars``. One pass, no shuffle."""
    spark = begin(pages)
    shared = spark.sparkContext.broadcast(model or trained_model())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), shared.value) for page in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_column, url_column)]
    rows = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).cast("string").alias("html")
    )
    return rows.mapInArrow(read, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
