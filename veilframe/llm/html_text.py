"""Layout-aware rendering of web pages as text.

A tokenizer and a tree builder with the usual implied tags give the page's
tree, rules of visibility take out what a browser would not show, and the rest
is laid out: blocks on lines of their own with blank lines where browsers have
margins, lists with markers and indents, tables with aligned columns, and white
space as it is shown. All visible text is kept.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.memory import lean
from veilframe.llm.tokens import text_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSHOWN = frozenset("head script style template noscript iframe noembed noframes object canvas audio video svg math datalist title meta link base".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Blocks with a blank line around them, and blocks without.
SPACED = HEADINGS | frozenset("p ul ol menu dl blockquote pre table figure hr fieldset xmp".split())
PLAIN = frozenset(
    "address article aside body center details dd dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option "
    "search section summary tbody td tfoot th thead tr caption textarea".split())
BLOCKS = SPACED | PLAIN
CLOSES_P = SPACED | frozenset(
    "address article aside center details dialog dir div dd dt figcaption footer form header hgroup main nav search section summary li".split())
CELLS, SECTIONS = frozenset(("td", "th")), frozenset(("tbody", "thead", "tfoot"))
SCOPE = frozenset("html table td th caption button object template marquee".split())
# A start tag closes open tags of these names, as far up as the nearest of those.
IMPLIED = {
    "li": (frozenset(["li"]), SCOPE | {"ul", "ol", "menu"}),
    "dt": (frozenset(["dt", "dd"]), SCOPE | {"dl"}),
    "dd": (frozenset(["dt", "dd"]), SCOPE | {"dl"}),
    "option": (frozenset(["option"]), SCOPE | {"select", "datalist"}),
    "optgroup": (frozenset(["option", "optgroup"]), SCOPE | {"select", "datalist"}),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["table", "tr"])),
    **{s: (SECTIONS | {"tr", "caption", "colgroup"}, frozenset(["table"])) for s in ("tbody", "thead", "tfoot")},
}
# Lists and quotes inside so many others are laid out alike, but not indented further.
INDENTS = 120
TABLE_DEPTH = 12

NAME = re.compile(r"[^\s/>]+")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WANTED = re.compile(r"hidden|style|class|id|start|value|type|span|open|reversed", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, ""), in one pass over the page."""
    at = start = 0
    unclosed = {'"': len(page) + 1, "'": len(page) + 1}  # from where on a quote has no partner

    def tag_end(place: int) -> int:
        while True:
            m = QUOTE_OR_END.search(page, place)
            if not m:
                return -1
            if m[0] == ">":
                return m.start()
            place = m.end()
            if m.start() < unclosed[m[0]]:
                partner = page.find(m[0], place)
                if partner < 0:
                    unclosed[m[0]] = m.start()
                else:
                    place = partner + 1

    while True:
        lt = page.find("<", at)
        if lt < 0:
            if start < len(page):
                yield "text", page[start:], ""
            return
        sign = page[lt + 1:lt + 2]
        closing = sign == "/"
        first = page[lt + 2:lt + 3] if closing else sign
        if first.isascii() and first.isalpha():
            name_at = lt + 1 + closing
            m = NAME.match(page, name_at)
            end = tag_end(m.end())
            if start < lt:
                yield "text", page[start:lt], ""
            if end < 0:
                return
            name = m[0].lower()
            if closing:
                yield "end", name, ""
            else:
                yield "start", name, page[m.end():end]
            at = start = end + 1
            if not closing and name in RAW:
                close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                stop = close.start() if close else len(page)
                if stop > at:
                    yield "text", page[at:stop], "raw" if name not in ("textarea", "title") else ""
                at = start = stop
        elif sign in ("!", "?") or closing:
            if start < lt:
                yield "text", page[start:lt], ""
            if page.startswith("<!--", lt):
                # "<!-->" and "<!--->" are whole comments.
                end = page.find("-->", lt + 2)
                at = start = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = start = len(page) if end < 0 else end + 1
        else:
            at = lt + 1


def attributes(text: str) -> dict[str, str]:
    if not text or not WANTED.search(text):
        return {}
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def tree(page: str) -> Node:
    """The page's tree, with implied tags, of any depth."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # of every tag where it is open, so that no search walks a deep stack
    blocks: list[int] = []
    body_seen = False

    def opened(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        if node.tag in BLOCKS:
            blocks.append(len(stack))
        stack.append(node)

    def cut(at: int) -> None:
        while len(stack) > at:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCKS:
                blocks.pop()

    def nearest(names: frozenset) -> int:
        """The innermost open tag of these names; 0 if there is none."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(names: frozenset, scope: frozenset) -> None:
        # Further names directly above are closed as well.
        while (at := nearest(names)) and at >= nearest(scope):
            cut(at)

    for kind, value, more in tokens(page):
        if kind == "text":
            stack[-1].children.append(value if more or "&" not in value else html.unescape(value))
        elif kind == "start":
            if value == "html" or value == "body" and body_seen:
                continue
            if value == "body":
                body_seen = True
                cut(1)
            elif stack[-1].tag == "head" and value not in UNSHOWN:
                cut(len(stack) - 1)
            if value in IMPLIED:
                close(*IMPLIED[value])
            if value in CLOSES_P:
                close(frozenset(["p"]), SCOPE)
            if value in HEADINGS and stack[-1].tag in HEADINGS:
                cut(len(stack) - 1)
            if value in CELLS and stack[-1].tag in SECTIONS | {"table"}:
                stack[-1].children.append(row := Node("tr"))
                opened(row)
            node = Node(value, attributes(more))
            stack[-1].children.append(node)
            if value not in VOID:
                opened(node)
        else:
            if value == "br":
                stack[-1].children.append(Node("br"))
                continue
            at = nearest(HEADINGS if value in HEADINGS else frozenset([value]))
            bounds = nearest(frozenset(["table"]))
            if value not in SECTIONS | CELLS | {"table", "tr"}:
                bounds = max(bounds, nearest(frozenset(["td", "th", "caption"])))
            if value not in BLOCKS and blocks:
                bounds = max(bounds, blocks[-1])
            if at and at >= bounds:
                cut(at)
    return root


class Style:
    """What the page's own style rules with simple selectors hide."""

    def __init__(self, root: Node):
        self.rules: list[tuple[str, frozenset, str | None, str | None]] = []
        found = [root]
        sheets = []
        while found:
            node = found.pop()
            if isinstance(node, Node):
                if node.tag == "style":
                    sheets.append("".join(c for c in node.children if isinstance(c, str)))
                else:
                    found += reversed(node.children)
        for sheet in sheets:
            for selectors, body in RULE.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
                display, visibility = declared(body)
                if not display and not visibility:
                    continue
                for selector in selectors.split(","):
                    m = SIMPLE.match(selector.strip())
                    if m and m[0]:
                        self.rules.append((m[1] or "*", frozenset(re.findall(r"[.#][\w-]+", m[2])), display, visibility))

    def of(self, node: Node) -> tuple[str | None, str | None]:
        """Display and visibility of a node, as far as they are given."""
        display = visibility = None
        if self.rules:
            marks = {f".{c}" for c in node.attrs.get("class", "").split()} | {f"#{node.attrs.get('id', '')}"}
            for tag, needs, d, v in self.rules:
                if tag in ("*", node.tag) and needs <= marks:
                    display, visibility = d or display, v or visibility
        if "style" in node.attrs:
            d, v = declared(node.attrs["style"])
            display, visibility = d or display, v or visibility
        return display, visibility


def declared(body: str) -> tuple[str | None, str | None]:
    display = visibility = None
    for part in body.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.replace("!important", "").strip().lower()
        if name == "display":
            display = value
        elif name == "visibility":
            visibility = value
    return display, visibility


def width(text: str) -> int:
    """Columns that a text takes; wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines that text and blocks are put into."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0
        self.held = ""  # markers that stand before the next line that isn't empty

    def text(self, value: str, keep_space: bool) -> None:
        if keep_space:
            first, *others = value.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.line += first
            for x in others:
                self.end_line(True)
                self.line += x
            return
        value = SPACE.sub(" ", value)
        if not self.line or self.line[-1] == " ":
            value = value.lstrip(" ")
        self.line += value

    def end_line(self, keep_empty: bool = False) -> None:
        line = self.line.rstrip(" \t")
        if line or keep_empty:
            self.add([line])
        self.line = ""

    def add(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        if self.held and (at := next((i for i, x in enumerate(lines) if x), -1)) >= 0:
            lines = [*lines[:at], self.held + lines[at], *lines[at + 1:]]
            self.held = ""
        self.lines += lines

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


def number(text: str | None, other: int, most: int = 1000) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return min(most, int(m[1])) if m else other


def marker(node: Node, n: int, kind: str) -> str:
    """The marker of a list item."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, rest = divmod(n - 1, 26)
            out = chr(97 + rest) + out
        return (out if kind == "a" else out.upper()) + ". "
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (n // value)
            n %= value
        return (out if kind == "i" else out.upper()) + ". "
    return f"{n}. "


class Layout:
    """Renders a tree."""

    def __init__(self, root: Node):
        self.style = Style(root)
        self.indents = 0

    def fill(self, node: Node, flow: Flow, shown: bool, keep_space: bool, tables: int) -> None:
        for child in node.children:
            if isinstance(child, str):
                if shown:
                    flow.text(child, keep_space)
            else:
                self.element(child, flow, shown, keep_space, tables)

    def visible(self, node: Node) -> tuple[bool, str | None]:
        """Whether a node takes part in the layout, and its own visibility."""
        if node.tag in UNSHOWN:
            return False, None
        display, visibility = self.style.of(node)
        if display == "none" or "hidden" in node.attrs and display is None or node.tag == "dialog" and "open" not in node.attrs:
            return False, None
        return True, visibility

    def element(self, node: Node, flow: Flow, shown: bool, keep_space: bool, tables: int) -> None:
        takes_part, visibility = self.visible(node)
        if not takes_part:
            return
        if visibility is not None:
            shown = visibility not in ("hidden", "collapse")
        tag = node.tag
        if tag == "br":
            flow.end_line(True)
        elif tag == "input":
            if shown and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                flow.text(node.attrs.get("value", ""), False)
        elif tag == "table" and tables < TABLE_DEPTH:
            flow.block(1)
            flow.add(lines) if (lines := self.table(node, shown, tables + 1)) else None
            flow.block(1)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.listing(node, flow, shown, keep_space, tables)
        elif tag == "details" and "open" not in node.attrs:
            flow.block(0)
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary":
                    self.element(child, flow, shown, keep_space, tables)
            flow.block(0)
        elif tag in ("blockquote", "dd"):
            self.indented(node, flow, shown, keep_space, tables, "  ", "  ", 1 if tag == "blockquote" else 0)
        elif tag == "q":
            flow.text('"', keep_space) if shown else None
            self.fill(node, flow, shown, keep_space, tables)
            flow.text('"', keep_space) if shown else None
        elif tag in BLOCKS:
            gap = 1 if tag in SPACED else 0
            flow.block(gap)
            if tag in ("pre", "xmp", "textarea"):
                if node.children and isinstance(node.children[0], str):
                    node.children[0] = node.children[0].removeprefix("\n")
                self.fill(node, flow, shown, True, tables)
            else:
                self.fill(node, flow, shown, keep_space, tables)
            flow.block(gap)
        else:
            self.fill(node, flow, shown, keep_space, tables)

    def indented(self, node: Node, flow: Flow, shown: bool, keep_space: bool, tables: int, first: str, others: str, gap: int) -> None:
        if self.indents >= INDENTS:
            flow.block(gap)
            self.fill(node, flow, shown, keep_space, tables)
            flow.block(gap)
            return
        inner = Flow()
        self.indents += 1
        self.fill(node, inner, shown, keep_space, tables)
        self.indents -= 1
        flow.block(gap)
        if lines := inner.done():
            flow.add([(first if i == 0 else others) + x if x else "" for i, x in enumerate(lines)])
        flow.block(gap)

    def listing(self, node: Node, flow: Flow, shown: bool, keep_space: bool, tables: int) -> None:
        nested = bool(flow.line or flow.lines) and isinstance(flow, ItemFlow)
        gap = 0 if nested else 1
        flow.block(gap)
        items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
        step = -1 if "reversed" in node.attrs else 1
        n = number(node.attrs.get("start"), items if step < 0 else 1, 10**9)
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                if node.tag == "ol":
                    n = number(child.attrs.get("value"), n, 10**9)
                    sign = marker(child, n, node.attrs.get("type", "1"))
                    n += step
                else:
                    sign = "- "
                takes_part, visibility = self.visible(child)
                if takes_part:
                    item_shown = shown if visibility is None else visibility not in ("hidden", "collapse")
                    flow.block(0)
                    if self.indents >= INDENTS:
                        held = len(flow.held)
                        flow.held += sign
                        self.fill(child, flow, item_shown, keep_space, tables)
                        flow.block(0)
                        # An item without lines has no marker.
                        flow.held = flow.held[:held]
                        continue
                    inner = ItemFlow()
                    self.indents += 1
                    self.fill(child, inner, item_shown, keep_space, tables)
                    self.indents -= 1
                    if lines := inner.done():
                        flow.add([(sign if i == 0 else " " * len(sign)) + x if x else "" for i, x in enumerate(lines)])
            elif isinstance(child, Node):
                self.element(child, flow, shown, keep_space, tables)
            elif shown:
                flow.text(child, keep_space)
        flow.block(gap)

    def table(self, node: Node, shown: bool, tables: int) -> list[str]:
        """Lines of a table: its captions and what stands outside rows first, then rows with aligned columns."""
        before, rows = Flow(), []

        def collect(parent: Node, shown: bool) -> None:
            for child in parent.children:
                if isinstance(child, str):
                    if shown:
                        before.text(child, False)
                    continue
                takes_part, visibility = self.visible(child)
                inner = shown if visibility is None else visibility not in ("hidden", "collapse")
                if not takes_part:
                    continue
                if child.tag in SECTIONS:
                    collect(child, inner)
                elif child.tag == "tr":
                    rows.append((child, inner))
                elif child.tag not in ("col", "colgroup"):
                    self.element(child, before, shown, False, tables)

        collect(node, shown)
        grid: list[list[tuple[int, int, list[str]]]] = []  # of each row (column, columns, lines)
        taken: dict[int, int] = {}  # rows for which a column is still taken from above
        for row, row_shown in rows:
            cells, at = [], 0
            for child in row.children:
                if isinstance(child, str):
                    if row_shown and child.strip():
                        before.text(child, False)
                    continue
                takes_part, visibility = self.visible(child)
                if not takes_part:
                    continue
                if child.tag not in CELLS:
                    self.element(child, before, row_shown, False, tables)
                    continue
                while taken.get(at, 0) > 0:
                    at += 1
                span, down = max(1, number(child.attrs.get("colspan"), 1)), max(1, number(child.attrs.get("rowspan"), 1, 65534))
                inner = Flow()
                self.fill(child, inner, row_shown if visibility is None else visibility not in ("hidden", "collapse"), False, tables)
                cells.append((at, span, inner.done()))
                for c in range(at, at + span):
                    taken[c] = down
                at += span
            grid.append(cells)
            taken = {c: r - 1 for c, r in taken.items() if r > 1}
        widths: dict[int, int] = {}
        for cells in grid:
            for at, span, lines in cells:
                if span == 1:
                    widths[at] = max(widths.get(at, 0), *map(width, lines), 0)
        for cells in grid:
            for at, span, lines in cells:
                if span > 1 and lines:
                    have = sum(widths.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
                    widths[at + span - 1] = widths.get(at + span - 1, 0) + max(0, max(map(width, lines)) - have)
        used = sorted(c for c, w in widths.items() if w)
        place, x = {}, 0
        for c in used:
            place[c] = x
            x += widths[c] + 2
        out = before.done()
        if out and any(lines for cells in grid for _, _, lines in cells):
            out = [*out, ""]
        for cells in grid:
            for i in range(max((len(lines) for _, _, lines in cells), default=0)):
                line, end = "", 0
                for at, span, lines in cells:
                    if i < len(lines) and lines[i]:
                        start = next((place[c] for c in range(at, at + span) if c in place), end)
                        gap = start - end if start > end or not line else 1
                        line += " " * gap + lines[i]
                        end += gap + width(lines[i])
                out.append(line.rstrip())
        return out


class ItemFlow(Flow):
    """The inside of a list item: lists in it have no blank line around."""


def render(page: str | None) -> str:
    """The visible text of a page; empty for null."""
    if not page:
        return ""
    root = tree(page)
    flow = Flow()
    most = sys.getrecursionlimit()
    # At most four calls for each level of the tree, and none of them by way of C, so only this limit bounds the depth.
    sys.setrecursionlimit(max(most, 1000 + 4 * depth(root)))
    try:
        Layout(root).fill(root, flow, True, False, 0)
    finally:
        sys.setrecursionlimit(most)
    return "\n".join(flow.done())


def depth(root: Node) -> int:
    """Levels of a tree."""
    level, levels = [root], 0
    while level:
        levels += 1
        level = [c for node in level for c in node.children if isinstance(c, Node)]
    return levels


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """Add the rendered text ``into`` to every row of ``pages``, in place of ``column``.

    Null and empty pages have empty texts; text without tags, unclosed tags and
    quotes, and any nesting are rendered as browsers would. Rows are handled on
    their own, so repeated rows and nulls elsewhere stay as they are; a column
    that is called like ``into`` is replaced; an empty table gives an empty one.
    """
    carry = pages.drop(into, column)
    names = carry.columns
    own = pages.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{column}`").cast("string").alias("_vf_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "_vf_page"):
                yield pa.RecordBatch.from_arrays(
                    [*(rows[c] for c in names), pa.array([render(p) for p in rows["_vf_page"].to_pylist()], pa.string())], names=[*names, into])

    kinds = "".join(f"`{c}` {t}, " for c, t in carry.dtypes)
    return own.mapInArrow(lean(run), f"{kinds}`{into}` string")
