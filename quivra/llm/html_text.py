"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text in page order. A linear classifier over length, links, punctuation and the names of the
elements around a block gives it a cost for either label; these are the capacities to the two terminals.
Blocks that follow each other and blocks with one parent are joined by edges whose capacity falls with their
distance in the DOM. The cut of least capacity, found by maximum flow, separates content from boilerplate.
A block whose terminal costs differ by more than all its edges together has its label in every minimum cut: it
is folded into its neighbours' capacities first. If a page has no content at all by this, its blocks without boilerplate marks that are not
mostly links are its text.

Reading is linear in the page: a scanner goes from tag to tag, elements stand in a stack with what a new tag may end, and a quote that swallows
the rest of a page ends all trust in quotes. A head ends at the first element or text that can't be in one; an open svg or math ends at an HTML block.

Nulls: a null page is empty; an empty page, or one without text outside scripts and the like, has an empty text. A very long page is one row's
work, some 100 bytes a character. Equal costs (ties) count as boilerplate. Repeated rows are treated alike; an empty table gives no rows. Only the
three columns named are read, so others can't clash."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from quivra.llm.common import quoted

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_PLAIN, _CARELESS = re.compile(r"[^>\"']*"), re.compile(r"[^>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_PARTS = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Element names of HTML by their part in a page; other names are inline.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = frozenset("svg math template select datalist object noscript canvas audio video".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BOILER = frozenset("nav footer aside header menu form button dialog figure figcaption search".split())
CONTENT = frozenset("article main".split())
# Roles, and words in class and id names. A strong word marks a name it is part of, a weak one only beside neutral words.
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CONTENT_ROLES = frozenset("main article".split())
STRONG = frozenset("advert adverts advertisement advertisements advertising sponsored breadcrumb breadcrumbs navbar pagination disqus cookie cookies consent gdpr popup newsletter subscribe signup sidebar masthead comments commentlist copyright".split())
WEAK = frozenset("ad ads banner sponsor promo promotion nav navigation menu footer header aside widget widgets related recommended recommendations share sharing social notice notification notifications alert modal login search comment reply replies respond pager tags toolbar legal disclaimer".split())
NEUTRAL = frozenset("site page main top bottom left right global primary secondary box block blocks list wrapper wrap container section area inner outer bar links link buttons button icons icon item items unit slot group row col column panel posts post articles article stories story news topics reading form input field media content body text title more also unit units google fixed sticky floating overlay js id the".split())
DENIED = frozenset("has no with without is not".split())
CONTENT_NAMES = frozenset("article content entry main post story body text".split())


@dataclass
class Block:
    text: str
    node: int
    tag: str
    linked: int
    boiler: int
    content: int


@dataclass
class Element:
    """An open element: its number, marks so far, and the places in the stack of what a new item, term, cell or row ends."""

    tag: str
    number: int
    boiler: int
    content: int
    item: int = -1
    term: int = -1
    cell: int = -1
    row: int = -1


class Page:
    """blocks in page order; parent[n] and depth[n] of element n."""

    def __init__(self, page: str | None):
        self.page = page or ""
        self.blocks: list[Block] = []
        self.parent, self.depth = [0], [0]
        self.stack = [Element("", 0, 0, 0)]
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.link = 0  # the stack's size where the open <a> began
        self.skip: list[str] = []
        self.head = False
        self.careless = False
        self._read()
        self._flush()

    # ---- scanning

    def _read(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = page.find("<", at)
            self._text(at, n if lt < 0 else lt)
            if lt < 0:
                return
            name = _NAME.match(page, lt + 1)
            if name is None:
                at = self._other(lt)
                continue
            end = self._tag_end(name.end())
            if end < 0:  # no > follows: what is left is a broken tag
                return
            tag = name[0].lower()
            if tag[0] == "/":
                self._close_tag(tag[1:])
                at = end
            else:
                at = self._open_tag(tag, name.end(), end)

    def _tag_end(self, at: int) -> int:
        """Behind the > of a tag whose name ends at `at`, -1 if there is none."""
        page, first = self.page, at
        while not self.careless:
            at = _PLAIN.match(page, at).end()
            if at >= len(page):
                break
            if page[at] == ">":
                return at + 1
            close = page.find(page[at], at + 1)
            if close < 0:
                break
            at = close + 1
        self.careless = True
        return page.find(">", first) + 1 or -1

    def _other(self, lt: int) -> int:
        """Behind a comment, declaration or mere <."""
        page = self.page
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            return end + 3 if end >= 0 else len(page)
        if page[lt + 1 : lt + 2] in ("!", "?", "/"):
            end = page.find(">", lt)
            return end + 1 if end >= 0 else len(page)
        self._text(lt, lt + 1)
        return lt + 1

    def _text(self, a: int, b: int) -> None:
        if a >= b or self.skip:
            return
        text = self.page[a:b]
        if self.head:
            if text.isspace():
                return
            self.head = False
        self.parts.append(text)
        if self.link:
            self.linked += b - a

    # ---- elements

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, top.number, top.tag, min(self.linked, len(text)), top.boiler, top.content))
            self.parts, self.linked = [], 0

    def _cut(self, k: int) -> None:
        """Ends all elements from place k of the stack on."""
        for x in self.stack[k:]:
            self.open[x.tag] -= 1
        del self.stack[k:]
        if self.link > k:
            self.link = 0

    def _close_tag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                del self.skip[self.skip.index(tag) :]
                return
            if tag not in BLOCK or not self.open.get(tag):
                return
            self.skip = []  # what was skipped ends with the element around it
        if tag == "head":
            self.head = False
        elif tag == "a":
            self.link = 0
        elif tag in BLOCK:
            self._flush()
            if self.open.get(tag) and tag not in ("body", "html"):
                k = len(self.stack) - 1
                while self.stack[k].tag != tag:
                    k -= 1
                self._cut(k)

    def _open_tag(self, tag: str, at: int, end: int) -> int:
        """Where reading goes on."""
        page = self.page
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, end)
            self._space()
            return close.start() if close else len(page)
        if tag == "head":
            self.head = True
            return end
        if self.head and tag not in HEAD:
            self.head = False
        closed = page[end - 2 : end - 1] == "/"
        if self.skip:
            if self.skip[0] in ("svg", "math", "select") and tag in BLOCK:
                self.skip = []
            else:
                if tag in SKIPPED and not closed and len(self.skip) < 64:
                    self.skip.append(tag)
                return end
        if tag in SKIPPED:
            self._space()
            if not (closed and tag in ("svg", "math")):
                self.skip = [tag]
        elif tag in ("br", "img"):
            self._space()
        elif tag == "hr":
            self._flush()
        elif tag == "a":
            self.link = len(self.stack)
        elif tag in BLOCK:
            self._flush()
            self._push(tag, page[at : end - 1])
        return end

    def _space(self) -> None:
        if self.parts:
            self.parts.append(" ")

    def _push(self, tag: str, attributes: str) -> None:
        if self.stack[-1].tag == "p":
            self._cut(len(self.stack) - 1)
        top = self.stack[-1]
        ends = top.item if tag == "li" else top.term if tag in ("dt", "dd") else top.cell if tag in ("td", "th") else top.row if tag == "tr" else -1
        if ends >= 0:
            self._cut(ends)
            top = self.stack[-1]
        here = len(self.stack)
        boiler, content = marks(tag, attributes, top.content)
        through = tag in ("div", "p", "address")
        self.parent.append(top.number)
        self.depth.append(self.depth[top.number] + 1)
        self.stack.append(
            Element(
                tag, len(self.parent) - 1, top.boiler + boiler, top.content + content,
                here if tag == "li" else top.item if through else -1,
                here if tag in ("dt", "dd") else top.term if through else -1,
                here if tag in ("td", "th") else -1 if tag in ("table", "tr") else top.cell,
                here if tag == "tr" else -1 if tag == "table" else top.row,
            )
        )
        self.open[tag] = self.open.get(tag, 0) + 1


def name_mark(name: str, content: int) -> int:
    """-1 for a class or id of boilerplate, 1 for one of content, else 0. `content`: marks of content around it."""
    parts = _PARTS.findall(_CAMEL.sub("-", name).lower())
    words = set(parts)
    if DENIED & words:
        return 0
    if "header" in words and (content or words & CONTENT_NAMES):
        return 0  # a headline's frame
    if STRONG & words:
        return -1
    if WEAK & words and all(x in WEAK or x in NEUTRAL or x.isdigit() or len(x) < 3 for x in parts):
        return -1
    return int(bool(parts) and all(x in CONTENT_NAMES for x in parts))


def marks(tag: str, attributes: str, content: int) -> tuple[int, int]:
    """(marks of boilerplate, marks of content) that an element adds to those around it."""
    more = int(tag in CONTENT)
    boiler = int(tag in BOILER and not (tag in ("header", "figure", "figcaption") and content + more))
    if tag in ("html", "body") or not attributes.strip():
        return boiler, more
    found = set()
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            found.update(name_mark(x, content + more) for x in value.split())
        elif key == "role":
            role = value.strip().lower()
            found.add(-1 if role in BOILER_ROLES else int(role in CONTENT_ROLES))
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            found.add(-1)
    if -1 in found:
        return boiler + 1, more
    return boiler, more + int(1 in found)


def blocks(page: str | None) -> Page:
    """Text between block-level tags, white space made one space, character references decoded."""
    return Page(page)


def evidence(b: Block) -> float:
    """Log-odds of content: a fixed linear classifier."""
    words = b.text.count(" ") + 1
    value = -1.0 + 0.6 * min(math.log1p(words), 4.0) - 4.0 * b.linked / len(b.text)
    value += 0.5 * (b.text[-1] in ".!?:;…»”\"'")
    value += 4.0 * min(b.content, 2) - 8.0 * min(b.boiler, 2)
    value -= 1.5 * b.text.startswith("©")
    return value + (1.0 if b.tag[:1] == "h" and b.tag[1:].isdigit() and b.content else 0.0)


def distance(page: Page, a: int, b: int, far: int = 60) -> int:
    """Steps from one element to another; `far` for any distance beyond, where an edge has no weight left (under 1e-12)."""
    parent, depth = page.parent, page.depth
    steps = 0
    while a != b and steps < far:
        if depth[a] >= depth[b]:
            a = parent[a]
        else:
            b = parent[b]
        steps += 1
    return steps


def edges(page: Page, strength: float = 1.2) -> list[tuple[int, int, float]]:
    found, last = [], {}
    bs = page.blocks
    weight = lambda a, b: strength * math.exp(-distance(page, bs[a].node, bs[b].node) / 2)
    for k, b in enumerate(bs):
        if k:
            found.append((k - 1, k, weight(k - 1, k)))
        beside = page.parent[b.node]
        before = last.get(beside)
        if before is not None and before < k - 1:
            found.append((before, k, 0.5 * weight(before, k)))
        last[beside] = k
    return found


def minimum_cut(source: list[float], sink: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node is on the source's side of a minimum cut.

    source[i] is paid if i is not on that side, sink[i] if it is, and the link's capacity if its ends differ."""
    n = len(source)
    need = [s - t for s, t in zip(source, sink)]
    beside: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        if a != b and w > 0:
            beside[a][b] = beside[a].get(b, 0.0) + w
            beside[b][a] = beside[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    weight = [sum(x.values()) for x in beside]
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if label[k] is None and abs(need[k]) > weight[k]:
            label[k] = need[k] > 0
            for j, w in beside[k].items():
                if label[j] is None:
                    need[j] += w if label[k] else -w
                    weight[j] -= w
                    todo.append(j)
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        flow = {k: {j: w for j, w in beside[k].items() if label[j] is None} for k in rest}
        side = _source_side(rest, need, flow)
        for k in rest:
            label[k] = k in side
    return [bool(x) for x in label]


def _source_side(nodes: list[int], need: list[float], room: dict[int, dict[int, float]]) -> set[int]:
    """Maximum flow between the nodes' excesses and deficits, by blocking flows in layers; what the source still reaches."""
    give = {k: max(need[k], 0.0) for k in nodes}
    take = {k: max(-need[k], 0.0) for k in nodes}
    tiny = 1e-12
    while True:
        level = {k: 0 for k in nodes if give[k] > tiny}
        queue, ends = deque(level), False
        while queue:
            k = queue.popleft()
            ends = ends or take[k] > tiny
            for j, w in room[k].items():
                if w > tiny and j not in level:
                    level[j] = level[k] + 1
                    queue.append(j)
        if not ends:
            return set(level)
        todo = {k: iter(list(room[k])) for k in level}
        for start in [k for k, x in level.items() if x == 0]:
            path = [start]
            while path and give[start] > tiny:
                k = path[-1]
                if take[k] > tiny:
                    steps = list(zip(path, path[1:]))
                    amount = min([give[start], take[k], *(room[a][b] for a, b in steps)])
                    give[start] -= amount
                    take[k] -= amount
                    full = len(path)
                    for x, (a, b) in enumerate(steps):
                        room[a][b] -= amount
                        room[b][a] = room[b].get(a, 0.0) + amount
                        if room[a][b] <= tiny:
                            full = min(full, x + 1)
                    path = path[:full]
                    continue
                j = next((j for j in todo[k] if room[k].get(j, 0.0) > tiny and level.get(j) == level[k] + 1), None)
                if j is None:
                    path.pop()  # nothing goes on from here in these layers: its iterator is used up
                else:
                    path.append(j)


def main_text(page: str | None) -> str:
    read = blocks(page)
    bs = read.blocks
    if not bs:
        return ""
    odds = [evidence(b) for b in bs]
    soft = lambda x: max(x, 0.0) + math.log1p(math.exp(-abs(x)))
    kept = minimum_cut([soft(x) for x in odds], [soft(-x) for x in odds], edges(read))
    if not any(kept):
        kept = [not b.boiler and 2 * b.linked < len(b.text) for b in bs]
    return " ".join(b.text for b, yes in zip(bs, kept) if yes)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    chosen = pages.select(quoted(id_col).cast("long"), quoted(url_col).cast("string"), quoted(html_col).cast("string"))
    return chosen.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
