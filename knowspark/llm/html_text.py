"""Main text of web pages by tag-path ratios.

A page is read once into blocks, each with its root-to-leaf path of block tags. For every path the text length without
links and the punctuation per node are aggregated, smoothed over neighbouring nodes, fused (geometric mean) and weighted
by what the path's names make likely: more within an article or main element, a tenth within elements that are named
like boilerplate, nothing within elements that are never content. Paths whose score reaches the threshold, which the best
unmarked path sets, hold content: their nodes are chosen, whatever they are called.

The region of the article is where the chosen text lies: from the root down, the child that holds nearly all of it, as
far as the first article or main element. A heading of the first rank that comes before belongs to it. Within the region
every block stays, however short, unless its path has failed and it is named like boilerplate (or, outside article and
main, consists of links): so short paragraphs, headings and lists are not lost. Inline elements belong to their block;
only adverts and hidden ones go.

Each page is handled by itself, so partitions need nothing from each other.

Defined results: null or empty html, and pages without text, give an empty string; unclosed, misnested and stray tags are
repaired as browsers do for paragraphs and list items; an unclosed comment or script runs to the end; ``br`` is white
space; elements may be nested to any depth and texts have any length; unclosed inline adverts are text; ids and urls may be null or repeated; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--(?:.*?--!?>|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|</[^>]*>", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
WORD = re.compile(r"[a-z]+|[0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object audio video canvas select noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
KEEPS_P = frozenset("button table td th caption object".split())
NOT_CONTENT = frozenset("head nav footer aside form button dialog menu fieldset legend option search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Names in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored sidebar sidenav nav navbar navigation menu"
    " breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice"
    " notices alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social related recommended recommendations"
    " pagination pager widget widgets contentinfo complementary search searchbox dialog hidden skip toc copyright legal disclaimer feedback rating ratings header".split()
)
#: Of these, names that layouts also give to what surrounds the article.
SURROUND = frozenset("sidebar sidenav nav menu header banner share sharing social related widget widgets search notice modal overlay popup hidden skip toc".split())
WHOLE = frozenset("article main".split())
#: Whole class names by which an inline element is an advert.
INLINE_ADS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted".split())
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
WITHIN, NAMED, SHARE, LINKED = 3.0, 0.1, 0.75, 0.6
#: By name, the rules of what an opening tag closes that an open element ends (true) or shields from (false).
RULES = {"p": ({"p"}, KEEPS_P), **CLOSES}
EFFECT: dict[str, list[tuple[str, bool]]] = {}
for _rule, (_ends, _scope) in RULES.items():
    for _name in _ends | _scope:
        EFFECT.setdefault(_name, []).append((_rule, _name in _ends))
HARD, SOFT, MAYBE = 1, 2, 3


class Node:
    """An element, with what its descendants need of it and its ancestors: no block looks at the whole stack."""

    __slots__ = ("parent", "name", "number", "depth", "end", "path", "hard", "header", "heading", "whole", "outer", "mark", "near", "mass", "heavy")

    def __init__(self, parent, name, bad, number, path):
        self.parent, self.name, self.number, self.path, self.end = parent, name, number, path, math.inf
        self.depth = parent.depth + 1 if parent else 0
        self.hard = bad == HARD or parent is not None and parent.hard
        self.header = name == "header" or parent is not None and parent.header
        self.heading = name in HEADINGS or parent is not None and parent.heading
        self.whole = number if name in WHOLE else parent.whole if parent else 0  # the innermost article or main
        self.outer = (parent.outer or self.whole) if parent else 0  # the outermost
        self.mark = (number, bad, parent.mark) if bad > HARD else parent.mark if parent else None
        self.mass, self.heavy = 0.0, None  # chosen text below, and the child with most of it
        self.near = parent.near if parent else {}  # by rule, the place on the stack of what it closes
        if name in EFFECT:
            self.near = dict(self.near)
            for rule, ends in EFFECT[name]:
                self.near[rule] = self.depth - 1 if ends else None


class Block:
    """``never``: it lies in an element that is not content; ``named``: in one that is named like boilerplate."""

    __slots__ = ("node", "text", "linked", "never", "named")

    def __init__(self, node, text, linked, never):
        self.node, self.text, self.linked, self.never, self.named = node, text, linked, never, False


def _marked(name: str, attrs: str) -> tuple[str, int]:
    """The path name of an element, and how its names mark it as boilerplate: not (0), surely, by class, or perhaps."""
    bad, label = HARD if name in NOT_CONTENT else 0, name
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            key = (m[1] or m[5]).lower()
            value = next((v for v in m.group(2, 3, 4) if v is not None), "")
            if key in ("class", "id", "role"):
                words = WORD.findall(value.lower())
                if key == "class" and words:
                    label = f"{name}.{words[0]}"
                if name not in ("html", "body", "article", "main") and (found := MARKS.intersection(words)) and bad != HARD:
                    bad = MAYBE if found <= SURROUND and bad != SOFT else SOFT
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
                bad = HARD
    return label, bad


def _left_out(attrs: str) -> bool:
    """Whether an inline element is an advert, or not shown."""
    for m in ATTR.finditer(attrs):
        key = (m[1] or m[5]).lower()
        value = next((v for v in m.group(2, 3, 4) if v is not None), "").lower()
        if key == "class" and INLINE_ADS.intersection(value.split()) or key == "hidden" or key == "style" and HIDDEN.search(value):
            return True
    return False


class Mute:
    """An inline element whose text does not count, if it is closed in the block that it was opened in."""

    __slots__ = ("name", "open", "level", "at")

    def __init__(self, name, level, at):
        self.name, self.open, self.level, self.at = name, 1, level, at


def blocks(page: str) -> tuple[list[Block], list[Node]]:
    """The page's text blocks in order, white space within each being one space, and its elements."""
    out: list[Block] = []
    top = Node(None, "", 0, 0, 0)
    nodes = [top]
    stack: list[Node] = []
    places: dict[str, list[int]] = {}  # by name, where on the stack
    paths: dict[tuple[int, str], int] = {}
    held: list[tuple[str, bool]] = []
    links = at = number = 0
    mute: Mute | None = None

    def flush() -> None:
        nonlocal held
        if held:
            raw = "".join(t for t, _ in held)
            text = " ".join(html.unescape(raw).split()) if raw and not raw.isspace() else ""
            if text:
                node = stack[-1] if stack else top
                never = node.hard or node.header and not (node.whole and node.heading)
                out.append(Block(node, text, sum(len(t.strip()) for t, a in held if a), never))
            held = []
        if mute:
            mute.at = 0

    def pop_to(i: int) -> None:
        nonlocal mute
        flush()
        while len(stack) > i:
            node = stack.pop()
            node.end = number
            places[node.name].pop()
        if mute and len(stack) < mute.level:
            mute = None

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            held.append((page[at:], links > 0))
            break
        if m.start() > at:
            held.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            held.append((" ", False))
        elif name == "a":
            links = 0 if closing else 1
        elif name in RAW:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{name}\s*/?\s*>", re.I).search(page, at)
                at = end.end() if end else size
            held.append((" ", False))
        elif name in VOID:
            if name in BLOCK:
                flush()
        elif name in BLOCK or "-" in name:
            if closing:
                if places.get(name):
                    pop_to(places[name][-1])
                else:
                    flush()
                links = 0 if name in ("nav", "li", "article", "div") else links
            else:
                flush()
                if name in CLOSES or name not in ("html", "body", "head"):
                    near = stack[-1].near.get(name if name in CLOSES else "p") if stack else None
                    if near is not None:
                        pop_to(near)
                label, bad = _marked(name, attrs)
                if mute:
                    bad = HARD  # a block within an advert
                if name == "body" and places.get("head"):
                    pop_to(places["head"][0])
                number += 1
                parent = stack[-1] if stack else top
                places.setdefault(name, []).append(len(stack))
                stack.append(Node(parent, name, bad, number, paths.setdefault((parent.path, label), len(paths) + 1)))
                nodes.append(stack[-1])
        elif mute:
            if name == mute.name and not attrs.endswith("/"):
                mute.open += -1 if closing else 1
                if not mute.open:
                    del held[mute.at :]
                    mute = None
        elif attrs and not closing and not attrs.endswith("/") and _left_out(attrs):
            mute = Mute(name, len(stack), len(held))
    flush()
    return _settle(out), nodes


def _settle(found: list[Block]) -> list[Block]:
    """Marks by class count unless the element surrounds the article: holds one, or, where the name may mean that, most text."""
    marks: dict[int, tuple] = {}
    inside: dict[int, int] = {}
    deepest: dict[int, int] = {}  # the last article that one of its blocks lies in
    for b in found:
        if m := b.node.mark:
            inside[m[0]] = inside.get(m[0], 0) + len(b.text)
            deepest[m[0]] = max(deepest.get(m[0], 0), b.node.whole)
            while m and m[0] not in marks:
                marks[m[0]] = m
                m = m[2]
    order = sorted(marks)
    for n in reversed(order):  # from inner to outer
        if up := marks[n][2]:
            inside[up[0]] = inside.get(up[0], 0) + inside[n]
            deepest[up[0]] = max(deepest.get(up[0], 0), deepest[n])
    total = sum(len(b.text) for b in found)
    off: dict[int, bool] = {}
    for n in order:
        _, mark, up = marks[n]
        off[n] = bool(up and off[up[0]]) or deepest[n] <= n and not (mark == MAYBE and 2 * inside[n] > total)
    for b in found:
        b.named = b.node.mark is not None and off[b.node.mark[0]]
    return found


def path_scores(found: list[Block]) -> list[float]:
    """The fused, smoothed tag-path ratio of each block."""
    total: dict[int, list[float]] = {}
    for b in found:
        t = total.setdefault(b.node.path, [0, 0.0, 0.0])
        t[0] += 1
        t[1] += len(b.text) * (1 - min(1.0, b.linked / max(1, len(b.text))))
        t[2] += len(PUNCTUATION.findall(b.text))
    ratio = [(t[1] / t[0], t[2] / t[0]) for t in (total[b.node.path] for b in found)]
    kernel = [math.exp(-(d * d) / 2) for d in (-1, 0, 1)]
    out = []
    for i in range(len(found)):
        near = [(kernel[d + 1], ratio[i + d]) for d in (-1, 0, 1) if 0 <= i + d < len(found)]
        w = sum(k for k, _ in near)
        length, marks = (sum(k * r[j] for k, r in near) / w for j in (0, 1))
        b = found[i]
        weight = 0.0 if b.never else (WITHIN if b.node.whole else 1.0) * (NAMED if b.named else 1.0)
        out.append(weight * math.sqrt(length * (marks + 0.25)))
    return out


def content_paths(found: list[Block]) -> set[int]:
    """The paths whose best score reaches the threshold; what is named like boilerplate must reach half the best."""
    scores = path_scores(found)
    most = max((s for b, s in zip(found, scores) if not b.named), default=0.0)
    if most <= 0:
        return set()
    mean = sum(scores) / len(scores)
    limit = min(math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores)), 0.5 * most)
    return {b.node.path for b, s in zip(found, scores) if s > 0 and s >= (0.5 * most if b.named else limit)}


def region(found: list[Block], nodes: list[Node], paths: set[int]) -> Node:
    """The element that the article is in."""
    for b in found:
        if b.node.path in paths and not b.never:
            b.node.mass += len(b.text)
    for node in reversed(nodes):  # parents come before their children
        up = node.parent
        if up and node.mass:
            up.mass += node.mass
            if up.heavy is None or node.mass >= up.heavy.mass:
                up.heavy = node
    root = nodes[0]
    total = root.mass
    while (child := root.heavy) and child.mass >= SHARE * total and (child.heavy or child.name in WHOLE):
        root = child
        if root.name in WHOLE:
            break
    return root


def main_text(page: str | None) -> str:
    """The text of the article, its blocks joined by one newline."""
    found, nodes = blocks(page) if page else ([], [])
    paths = content_paths(found) if found else set()
    if not paths:
        return ""
    root = region(found, nodes, paths)
    inside = [i for i, b in enumerate(found) if root.number <= b.node.number <= root.end]
    first = inside[0]
    if not root.whole and not any(found[i].node.name == "h1" for i in inside):
        first = next((i for i in range(first - 1, -1, -1) if found[i].node.name == "h1"), first)
    linked: dict[int, list[int]] = {}
    for b in found:
        t = linked.setdefault(b.node.path, [0, 0])
        t[0] += b.linked
        t[1] += len(b.text)

    def stays(b: Block) -> bool:
        if b.never:
            return False
        if b.node.path in paths:
            return True
        links, size = linked[b.node.path]
        return not b.named and (b.node.whole > 0 or links < LINKED * size)

    return "\n".join(found[i].text for i in [*range(first, inside[0]), *inside] if stays(found[i]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = own.schema["page_id"].dataType.simpleString()
    return own.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
