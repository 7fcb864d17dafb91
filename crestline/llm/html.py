"""Layout-aware rendering of HTML pages to text.

A tree builder with implied end tags makes a tree of a page; visibility rules
leave out what a browser does not show; rendering keeps the spacing of blocks,
markers of lists and the columns of tables.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.base import map_texts, text_slices

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link object iframe canvas audio video svg math datalist select".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table caption ul tr center".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol menu dl table pre figure".split())
# A start tag that closes an open element of these kinds, unless a limit stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
# Elements that a closing tag does not reach beyond.
WALLS = frozenset(("table", "td", "th", "caption"))
MAX_DEPTH = 400
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NO_BOX = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:;|!|$)", re.I)
_NO_INK = re.compile(r"(?:^|;)\s*visibility\s*:\s*(?:hidden|collapse)\s*(?:;|!|$)", re.I)
_INK = re.compile(r"(?:^|;)\s*visibility\s*:\s*visible\s*(?:;|!|$)", re.I)
# Wider cells, and wider rows, are not aligned.
CELL_WIDTH, LINE_WIDTH = 60, 400
# Row spans are followed in the first columns.
SPANNED = 1_000


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Tree of a page; never fails on malformed markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.root.attrs.update(attrs)
            return
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        elif tag in BLOCK:
            self._close({"p"}, WALLS | {"button", "object"})
        if tag in ("p", "li", "dt", "dd") or re.fullmatch("h[1-6]", tag):
            self._close({"p"}, WALLS | {"button", "object"})
        if tag not in HIDDEN and any(n.tag == "head" for n in self.stack[1:2]):
            del self.stack[1:]
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push("tr", {})
        node = self._push(tag, attrs)
        if tag in VOID or len(self.stack) > MAX_DEPTH:
            self.stack.pop()
            del node

    def _push(self, tag, attrs):
        node = Node(tag, attrs)
        self.stack[-1].kids.append(node)
        self.stack.append(node)
        return node

    def _close(self, kinds, limits):
        """Close the outermost open element of ``kinds`` above the nearest limit."""
        at = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in limits:
                break
            if self.stack[i].tag in kinds:
                at = i
        if at is not None:
            del self.stack[at:]

    def handle_endtag(self, tag):
        if tag == "br":
            self._push("br", {})
            self.stack.pop()
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if self.stack[i].tag in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_data(self, data):
        self.stack[-1].kids.append(data)


def shown(node: Node) -> Node | None:
    """The element as a reader sees it, or None.

    Of a closed ``details`` only the summary is seen. An element of hidden
    visibility is seen through: descendants that are visible again remain.
    """
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or a.get("aria-hidden") == "true" or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return None
    if node.tag == "dialog" and "open" not in a:
        return None
    style = a.get("style", "")
    if style and _NO_BOX.search(style):
        return None
    if style and _NO_INK.search(style):
        left = Node(node.tag, {})
        left.kids = list(_revealed(node))
        return left if left.kids else None
    if node.tag == "details" and "open" not in a:
        left = Node(node.tag, a)
        left.kids = [k for k in node.kids if isinstance(k, Node) and k.tag == "summary"][:1]
        return left
    return node


def _revealed(node: Node) -> Iterator[Node]:
    """Outermost descendants of an unseen element whose own style makes them visible."""
    for kid in node.kids:
        if isinstance(kid, Node) and not _NO_BOX.search(kid.attrs.get("style", "")):
            if _INK.search(kid.attrs.get("style", "")):
                yield kid
            else:
                yield from _revealed(kid)


class _Lines:
    """Text under construction: collapsed runs, lines and blank lines between blocks."""

    def __init__(self, indent: str = ""):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.indent = indent
        self.mark = ""

    def add(self, text: str):
        self.now.append(text)

    def end(self, always: bool = False):
        text = _SPACE.sub(" ", "".join(self.now)).strip(" ")
        self.now = []
        if text or always and self.lines:
            self.put(text)

    def put(self, text: str):
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.indent + self.mark + text).rstrip())
        if self.mark:
            self.mark = " " * len(self.mark)

    def space(self):
        self.gap = True


def render(root: Node) -> str:
    out = _Lines()
    _walk(root, out, [])
    out.end()
    return "\n".join(out.lines).strip("\n")


def _walk(node: Node, out: _Lines, lists: list):
    for kid in node.kids:
        if isinstance(kid, str):
            out.add(kid)
            continue
        kid = shown(kid)
        if kid is None:
            continue
        if kid.tag == "br":
            out.end(always=True)
        elif kid.tag == "hr":
            out.end()
            out.put("---")
        elif kid.tag == "img":
            out.add(kid.attrs.get("alt", ""))
        elif kid.tag == "pre":
            out.end()
            out.space()
            for line in _text(kid).strip("\n").split("\n"):
                out.put(line.rstrip())
            out.space()
        elif kid.tag == "table":
            out.end()
            out.space()
            for line in _table(kid):
                out.put(line)
            out.space()
        elif kid.tag in ("ul", "ol", "menu"):
            out.end()
            if not lists:
                out.space()
            start = kid.attrs.get("start", "1")
            lists.append([kid.tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            _walk(kid, out, lists)
            out.end()
            lists.pop()
            if not lists:
                out.space()
        elif kid.tag == "li":
            out.end()
            kind = lists[-1] if lists else ["ul", 1]
            mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
            was = out.indent, out.mark
            out.indent, out.mark = "  " * max(0, len(lists) - 1), mark
            _walk(kid, out, lists)
            out.end()
            out.indent, out.mark = was
        elif kid.tag in BLOCK:
            out.end()
            if kid.tag in SPACED:
                out.space()
            if kid.tag == "dd":
                was = out.indent
                out.indent = was + "    "
                _walk(kid, out, lists)
                out.end()
                out.indent = was
            else:
                _walk(kid, out, lists)
                out.end()
            if kid.tag in SPACED:
                out.space()
        else:
            _walk(kid, out, lists)


def _text(node: Node) -> str:
    """Visible text with its white space."""
    parts: list[str] = []
    for kid in node.kids:
        if isinstance(kid, str):
            parts.append(kid)
            continue
        kid = shown(kid)
        if kid is not None:
            parts.append("\n" if kid.tag == "br" else _text(kid))
    return "".join(parts)


def _width(text: str) -> int:
    """Columns of a text; wide characters take two."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


def _cell(node: Node) -> list[str]:
    """Lines of a cell: its blocks, lists and tables, without blank lines."""
    inner = _Lines()
    _walk(node, inner, [])
    inner.end()
    return [x for x in inner.lines if x.strip()]


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1")
    return max(1, min(int(value), most)) if re.fullmatch(r"\d{1,5}", value) else 1


class _Grid:
    """Cells of a table in their columns; a cell that spans rows keeps its columns free below it."""

    def __init__(self):
        self.rows: list[dict[int, list[str]]] = []
        self.taken: dict[int, int] = {}

    def row(self, cells: list[tuple[list[str], int, int]]) -> None:
        at, row = 0, {}
        held, self.taken = self.taken, {c: n - 1 for c, n in self.taken.items() if n > 1}
        for lines, across, down in cells:
            while at in held:
                at += 1
            row[at] = lines
            if down > 1 and at + across <= SPANNED:
                self.taken.update(dict.fromkeys(range(at, at + across), down - 1))
            at += across
        self.rows.append(row)

    def lines(self) -> list[str]:
        """Rows with their cells padded to the columns' widths.

        A cell wider than CELL_WIDTH takes no part in the alignment: the cells of
        its row stand on lines of their own. A row that would be wider than
        LINE_WIDTH is not padded. So padding stays in proportion to the page.
        """
        wide: dict[int, int] = {}
        long = []
        for row in self.rows:
            widths = {c: max(map(_width, lines), default=0) for c, lines in row.items()}
            long.append(any(w > CELL_WIDTH for w in widths.values()))
            if not long[-1]:
                for c, w in widths.items():
                    wide[c] = max(wide.get(c, 0), w)
        start, used = {}, 0
        for c in sorted(wide):
            start[c] = used + 2 * c
            used += wide[c]
        out = []
        for row, apart in zip(self.rows, long):
            filled = {c: lines for c, lines in row.items() if lines}
            if apart:
                out += [x for lines in filled.values() for x in lines]
                continue
            for i in range(max(map(len, filled.values()), default=0)):
                now = {c: lines[i] for c, lines in filled.items() if i < len(lines)}
                if start[max(now)] > LINE_WIDTH:
                    out.append("  ".join(now.values()))
                    continue
                text, at = [], 0
                for c, x in now.items():
                    text.append(" " * (start[c] - at) + x)
                    at = start[c] + _width(x)
                out.append("".join(text).rstrip())
        return out


def _table(table: Node) -> list[str]:
    """Caption and rows, cells padded to their column's width."""
    grid = _Grid()
    head: list[str] = []
    rest: list[str] = []

    def gather(node: Node):
        for kid in node.kids:
            if isinstance(kid, str):
                if kid.strip():
                    rest.append(_SPACE.sub(" ", kid).strip())
                continue
            kid = shown(kid)
            if kid is None:
                continue
            if kid.tag == "caption":
                head.extend(_cell(kid))
            elif kid.tag == "tr":
                cells = []
                for c in kid.kids:
                    if isinstance(c, str):
                        if c.strip():
                            cells.append(([_SPACE.sub(" ", c).strip()], 1, 1))
                        continue
                    seen = shown(c)
                    if seen is not None:
                        cells.append((_cell(seen), _span(c, "colspan", 1000), _span(c, "rowspan", 65_534)))
                grid.row(cells)
            elif kid.tag in ("tbody", "thead", "tfoot"):
                gather(kid)
            else:
                rest.extend(_cell(kid))

    gather(table)
    return [x for x in (*head, *rest, *grid.lines()) if x]


def page_text(html: str) -> str:
    """All visible text of one page; malformed markup gives what could be read."""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return render(builder.root)


def extract_text(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text, n_lines, n_chars) of every row of ``pages``.

    A null or empty page has an empty text. Nesting deeper than MAX_DEPTH is
    read as if it were flat, so that no page exhausts the stack. Repeated rows
    and null ids are kept; other columns are ignored.
    """

    def fn(batch):
        for a, e, raw in text_slices(batch):
            texts = [page_text(x.decode("utf-8", "replace")) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, e - a), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "text", "n_lines", "n_chars"],
            )

    cols = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).cast("string").alias("text"))
    return map_texts(cols, fn, "page_id long, text string, n_lines long, n_chars long")
