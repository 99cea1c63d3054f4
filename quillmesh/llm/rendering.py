"""HTML extraction by layout-aware rendering (operator 4).

A tree builder reads tags, supplies the ones that HTML implies (a paragraph ends where a block
begins, items, cells and rows end each other, cells get a row) and ignores end tags that close
nothing.  Visibility rules drop what a browser doesn't show: head, scripts, styles, templates,
fallback content, ``hidden``, ``display: none`` and ``visibility: hidden`` in style attributes
and in simple rules of the page's style sheets, closed ``details`` and ``dialog``.  All other
text is laid out as lines: white space collapses but in ``pre``; paragraphs, headings, lists and
tables stand off by a blank line; list items carry their mark or number and hang their further
lines; table cells are padded to columns, with spans, and keep lines of their own.

Elements deeper than DEPTH are put beside each other, as browsers do, so no text is lost and no
stack overflows.  One pass without a shuffle over whole pages.

Defined results: a null or empty page, and one that shows nothing, give the empty text; broken
markup is text where it can't be a tag; repeated rows are rendered like any other.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices

DEPTH = 256
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their end tag.
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
#: Never shown.
UNSEEN = frozenset(
    "head script style template noscript datalist iframe noembed noframes title base link meta audio video canvas object map rp col colgroup".split()
)
#: Blocks, with the blank lines that they ask for around them.
BLOCKS = {
    **dict.fromkeys("address article aside body center details dialog dd div dt fieldset figcaption footer form header hgroup html legend li main menuitem nav optgroup search section summary caption tr tbody thead tfoot td th frameset".split(), 0),
    **dict.fromkeys("blockquote dir dl figure h1 h2 h3 h4 h5 h6 hr listing menu ol p plaintext pre table ul xmp".split(), 1),
}
_ENDS_P = frozenset(BLOCKS) - frozenset("body html li dd dt td th tr tbody thead tfoot caption optgroup menuitem frameset legend".split())
_SCOPE = frozenset("html table td th caption button template object".split())
_LISTS = _SCOPE | frozenset("ul ol menu dir".split())
_INLINE_ENDS = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
#: start tag -> (tags that it ends, tags that stop the search)
_ENDED_BY = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dt", "dd"]), _SCOPE | {"dl"}),
    "dd": (frozenset(["dt", "dd"]), _SCOPE | {"dl"}),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["tbody", "thead", "tfoot", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
_ENDED_BY["thead"] = _ENDED_BY["tfoot"] = _ENDED_BY["tbody"]
_HEAD_ONLY = frozenset("title base link meta style script noscript template".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSHOWN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SHOWN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*(?!none)\w|visibility\s*:\s*visible)", re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_ASIDE = re.compile(r"/\*.*?\*/|@media[^{]*\bprint\b[^{]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", re.S)
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?([.#][\w-]+)?")
_BLANKS = re.compile(r"[ \t\n\f\r]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "source", "kids")

    def __init__(self, tag: str, source: str = ""):
        self.tag, self.source, self.kids = tag, source, []

    def attributes(self) -> dict[str, str]:
        """Names in lower case; of a name given twice the first counts."""
        out: dict[str, str] = {}
        for name, a, b, c in _ATTRIBUTE.findall(self.source):
            out.setdefault(name.lower(), unescape(a or b or c))
        return out


class Builder:
    def __init__(self) -> None:
        self.root = Node("#root")
        self.open = [self.root]
        self.rules: list[str] = []

    def _pop_through(self, tags: frozenset, stops: frozenset) -> bool:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                del self.open[i:]
                return True
            if tag in stops:
                return False
        return False

    def start(self, tag: str, source: str, closed: bool = False) -> None:
        if tag in _ENDS_P:
            self._pop_through(frozenset(["p"]), _SCOPE)
        if tag in _ENDED_BY:
            self._pop_through(*_ENDED_BY[tag])
        if self.open[-1].tag == "head" and tag not in _HEAD_ONLY:
            self.open.pop()
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push(Node("tr"))
        self._push(Node(tag, source))
        if tag in VOID or closed:
            self.open.pop()

    def _push(self, node: Node) -> None:
        if len(self.open) > DEPTH:
            self.open.pop()
        self.open[-1].kids.append(node)
        self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        inline = tag in _INLINE_ENDS
        for i in range(len(self.open) - 1, 0, -1):
            found = self.open[i].tag
            if found == tag:
                del self.open[i:]
                return
            if found in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html") or inline and found in BLOCKS:
                return

    def text(self, text: str) -> None:
        self.open[-1].kids.append(text)


def parse(html: str) -> Builder:
    """The tree of a page, and the texts of its style sheets."""
    b = Builder()
    at, n = 0, len(html)
    unclosed: set[str] = set()  # quotes that the rest of the page doesn't hold in pairs
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= n:
            b.text(html[at:])
            break
        sign = html[lt + 1]
        if lt > at:
            b.text(html[at:lt])
        if sign == "!" or sign == "?":
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        ending = sign == "/"
        m = _NAME.match(html, lt + 1 + ending)
        if not m:
            if ending:  # a bogus comment
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                b.text("<")
                at = lt + 1
            continue
        gt = html.find(">", m.end())
        if gt < 0:
            b.text(html[lt:])
            break
        if gt > m.end():
            gt = _tag_end(html, m.end(), gt, unclosed)
        tag, source = m[0].lower(), html[m.end() : gt]
        at = gt + 1
        if ending:
            b.end(tag)
            continue
        b.start(tag, source, source.endswith("/") and tag not in BLOCKS and tag not in RAW and tag not in _INLINE_ENDS)
        if tag in RAW:
            close = _RAW_END[tag].search(html, at)
            inner = html[at : close.start() if close else n]
            if tag == "style":
                b.rules.append(inner)
            if inner and tag in ("textarea", "xmp"):
                b.text(inner)
            at = close.start() if close else n
            if close is None:
                b.end(tag)
    return b


def _tag_end(html: str, at: int, gt: int, unclosed: set[str]) -> int:
    """The end of a tag: a ``>`` that no quoted value holds."""
    while True:
        value = at
        quote = None
        while value < gt:
            c = html[value]
            if c == "=" and (q := html[value + 1 : gt].lstrip()[:1]) and q in "\"'" and q not in unclosed:
                begin = html.index(q, value)
                end = html.find(q, begin + 1)
                if end < 0:
                    unclosed.add(q)
                elif end > gt:
                    quote = end
                    break
                else:
                    value = end
            nxt = html.find("=", value + 1, gt)
            value = gt if nxt < 0 else nxt
        if quote is None:
            return gt
        at = quote + 1
        further = html.find(">", at)
        if further < 0:
            return gt
        gt = further


def unshown_rules(sheets: list[str]) -> set[str]:
    """Simple selectors (tag, .class, #id, tag.class, tag#id) that hide; the last rule of each counts."""
    out: set[str] = set()
    for sheet in sheets:
        for selectors, body in _RULE.findall(_ASIDE.sub(" ", sheet)):
            hides, shows = _UNSHOWN.search(body), _SHOWN.search(body)
            if hides or shows:
                for s in selectors.split(","):
                    s = s.strip()
                    if s and _SELECTOR.fullmatch(s):
                        (out.add if hides else out.discard)(s)
    return out


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _holds_cell(node: Node) -> bool:
    """Whether a cell of the same table lies below."""
    waiting = [node]
    while waiting:
        for kid in waiting.pop().kids:
            if not isinstance(kid, str):
                if kid.tag in ("td", "th"):
                    return True
                if kid.tag != "table":
                    waiting.append(kid)
    return False


class Layout:
    """Lines of a tree."""

    def __init__(self, rules: set[str]):
        self.rules = rules
        self.names = any("." in r or "#" in r for r in rules)

    def seen(self, node: Node) -> bool:
        tag = node.tag
        if tag in UNSEEN:
            return False
        if tag in self.rules:
            return False
        source = node.source
        if not source:
            return tag != "dialog"
        if tag == "dialog" or "hidden" in source or "style" in source or self.names or tag == "input":
            a = node.attributes()
            if "hidden" in a or _UNSHOWN.search(a.get("style", "")):
                return False
            if tag == "dialog" and "open" not in a:
                return False
            if self.names:
                marks = ["." + c for c in a.get("class", "").split()] + (["#" + a["id"]] if a.get("id") else [])
                return not any(m in self.rules or tag + m in self.rules for m in marks)
        return True

    def lines(self, node: Node, pre: bool = False) -> list[str]:
        """What a block shows, without margins of its own."""
        flow = Flow()
        self.walk(node.kids, flow, pre)
        return flow.done()

    def walk(self, kids: list, flow: Flow, pre: bool) -> None:
        for kid in kids:
            if isinstance(kid, str):
                flow.text(unescape(kid) if "&" in kid else kid, pre)
                continue
            tag = kid.tag
            if not self.seen(kid):
                continue
            if tag == "br":
                flow.new_line()
            elif tag in BLOCKS:
                flow.block(self.block(kid, pre), BLOCKS[tag])
            elif tag == "input":
                a = kid.attributes()
                if a.get("type", "text").lower() not in ("hidden", "password", "checkbox", "radio", "file", "image", "color", "range"):
                    flow.text(a.get("value", ""), pre)
            elif tag == "select":
                flow.text(self.choice(kid), pre)
            elif tag == "textarea":
                flow.text("".join(unescape(x) for x in kid.kids if isinstance(x, str)), True)
            elif tag == "q":
                flow.text("“", pre)
                self.walk(kid.kids, flow, pre)
                flow.text("”", pre)
            else:
                self.walk(kid.kids, flow, pre)

    def choice(self, select: Node) -> str:
        """The option that is chosen, or else the first."""
        options, waiting = [], [select]
        while waiting:
            node = waiting.pop()
            for kid in node.kids:
                if isinstance(kid, Node) and self.seen(kid):
                    (options if kid.tag == "option" else waiting).append(kid)
        chosen = [o for o in options if "selected" in o.source and "selected" in o.attributes()] or options
        return " ".join(self.lines(chosen[0])) if chosen else ""

    def block(self, node: Node, pre: bool) -> list[str]:
        tag = node.tag
        if tag in ("ul", "ol", "menu", "dir"):
            return self.list(node, pre)
        if tag == "table":
            return self.table(node)
        if tag in ("pre", "listing", "xmp", "plaintext"):
            lines = self.lines(node, True)
            return lines[1:] if lines and not lines[0] else lines
        if tag == "hr":
            return []
        if tag in ("blockquote", "dd"):
            return ["    " + x if x else x for x in self.lines(node, pre)]
        if tag == "details" and "open" not in node.attributes():
            first = next((k for k in node.kids if isinstance(k, Node) and k.tag == "summary"), None)
            return self.lines(first, pre) if first is not None and self.seen(first) else []
        return self.lines(node, pre)

    def list(self, node: Node, pre: bool) -> list[str]:
        a = node.attributes()
        ordered = node.tag == "ol"
        items = [k for k in node.kids if not isinstance(k, str)]
        step = -1 if ordered and "reversed" in a else 1
        number = _integer(a.get("start"), sum(k.tag == "li" for k in items) if step < 0 else 1)
        flow = Flow()
        for kid in node.kids:
            if isinstance(kid, str) or kid.tag != "li":
                self.walk([kid], flow, pre)
                continue
            if ordered:
                number = _integer(kid.attributes().get("value") if kid.source else None, number)
            if not self.seen(kid):
                continue
            mark = f"{number}. " if ordered else "- "
            number += step
            inner = Flow()
            for x in kid.kids:  # a list within an item stands close to it
                if isinstance(x, Node) and x.tag in ("ul", "ol", "menu", "dir") and self.seen(x):
                    inner.block(self.list(x, pre), 0)
                else:
                    self.walk([x], inner, pre)
            lines = inner.done()
            if lines:
                pad = " " * len(mark)
                flow.block([mark + lines[0], *[pad + x if x else x for x in lines[1:]]], 0)
        return flow.done()

    def table(self, node: Node) -> list[str]:
        captions, rows, outside = [], [], Flow()
        waiting = [node]
        sections: dict[str, list] = {"thead": [], "": [], "tfoot": []}
        while waiting:
            part = waiting.pop(0)
            for kid in part.kids:
                if isinstance(kid, str):
                    if kid.strip():
                        self.walk([kid], outside, False)
                elif not self.seen(kid):
                    continue
                elif kid.tag == "caption":
                    captions += self.lines(kid)
                elif kid.tag in ("tbody", "thead", "tfoot"):
                    waiting.append(kid)
                elif kid.tag == "tr":
                    sections[part.tag if part.tag in sections else ""].append(self.cells(kid, outside))
                else:  # what can't stand in a table is shown before it
                    self.walk([kid], outside, False)
        for name in ("thead", "", "tfoot"):
            rows += sections[name]
        return [*outside.done(), *captions, *self.grid(rows)]

    def cells(self, row: Node, outside: Flow) -> list[Node]:
        """The cells of a row, those within other elements too; what is no cell goes before the table."""
        out = []
        for kid in row.kids:
            if isinstance(kid, str):
                if kid.strip():
                    self.walk([kid], outside, False)
            elif not self.seen(kid):
                continue
            elif kid.tag in ("td", "th"):
                out.append(kid)
            elif kid.tag != "table" and _holds_cell(kid):
                out += self.cells(kid, outside)
            else:
                self.walk([kid], outside, False)
        return out

    def grid(self, rows: list[list[Node]]) -> list[str]:
        widths: dict[int, int] = {}
        taken: dict[int, int] = {}  # column -> rows that a cell above still holds
        laid, spans = [], []
        for row in rows:
            column, cells = 0, []
            for cell in row:
                while taken.get(column, 0) > 0:
                    column += 1
                a = cell.attributes() if cell.source else {}
                wide = min(max(1, _integer(a.get("colspan"), 1)), 1000)
                high = min(max(1, _integer(a.get("rowspan"), 1)), 65534)
                lines = self.lines(cell)
                cells.append((column, wide, lines))
                size = max(map(_width, lines), default=0)
                if wide == 1:
                    widths[column] = max(widths.get(column, 0), size)
                elif size:
                    spans.append((column, wide, size))
                if high > 1:
                    for x in range(column, column + wide):
                        taken[x] = max(taken.get(x, 0), high)
                column += wide
            taken = {x: k - 1 for x, k in taken.items() if k > 1}
            laid.append(cells)
        for column, wide, size in spans:
            held = [widths.get(x, 0) for x in range(column, column + wide)]
            lack = size - sum(held) - 2 * (sum(h > 0 for h in held) - 1)
            if lack > 0:
                at = next((x for x in range(column + wide - 1, column - 1, -1) if widths.get(x, 0)), column)
                widths[at] = widths.get(at, 0) + (lack if widths.get(at, 0) else size)
        places, at = {}, 0
        for column in sorted(widths):
            places[column] = at
            if widths[column]:
                at += widths[column] + 2
        starts = sorted(places)
        out = []
        for cells in laid:
            for i in range(max((len(lines) for _, _, lines in cells), default=0)):
                line, size = "", 0
                for column, _, lines in cells:
                    if i < len(lines) and lines[i]:
                        place = places.get(column)
                        if place is None:
                            near = [c for c in starts if c >= column]
                            place = places[near[0]] if near else at
                        gap = max(place - size, 2 if line else 0)
                        line += " " * gap + lines[i]
                        size += gap + _width(lines[i])
                out.append(line)
        return out


class Flow:
    """Lines under way: inline text collapses until a line ends, blocks keep their distance."""

    __slots__ = ("out", "inline", "breaks", "gap", "raw")

    def __init__(self) -> None:
        self.out: list[str] = []
        self.inline: list[str] = []
        self.breaks: list[str] = []  # lines ended by br
        self.gap = 0
        self.raw = False

    def text(self, text: str, pre: bool) -> None:
        if pre and "\n" in text:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self.inline.append(first)
            self.raw = True
            for x in rest:
                self.new_line()
                self.raw = True
                self.inline.append(x)
        elif text:
            self.raw |= pre
            self.inline.append(text)

    def _line(self) -> str:
        text = "".join(self.inline)
        self.inline = []
        raw, self.raw = self.raw, False
        return text.rstrip() if raw else _BLANKS.sub(" ", text).strip(" ")

    def new_line(self) -> None:
        self.breaks.append(self._line())

    def flush(self) -> None:
        line = self._line() if self.inline else ""
        lines = [*self.breaks, line] if line else self.breaks
        self.breaks = []
        if lines:
            self._put(lines, 0)

    def _put(self, lines: list[str], margin: int) -> None:
        if self.out and max(self.gap, margin) and self.out[-1]:
            self.out.append("")
        self.out += lines
        self.gap = margin

    def block(self, lines: list[str], margin: int) -> None:
        self.flush()
        if any(lines):
            self._put(lines, margin)
        else:
            self.gap = max(self.gap, margin)

    def done(self) -> list[str]:
        self.flush()
        lines = self.out
        first, last = 0, len(lines)
        while first < last and not lines[first]:
            first += 1
        while last > first and not lines[last - 1]:
            last -= 1
        return lines[first:last]


def _integer(text: str | None, usual: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return int(m[1]) if m else usual


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    if sys.getrecursionlimit() < 20 * DEPTH:
        sys.setrecursionlimit(20 * DEPTH)
    built = parse(html)
    return "\n".join(Layout(unshown_rules(built.rules)).lines(built.root))


def render_pages(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = pa.array([render(x) for x in part.column(1).to_pylist()], pa.string())
                yield pa.record_batch([part.column(0), texts], ["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string")
