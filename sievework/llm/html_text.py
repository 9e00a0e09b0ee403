"""Operator 3: layout-aware text of HTML pages.

A tolerant tokenizer feeds a tree builder that knows void elements, implied end tags (p, li, dt, dd, option, table
parts) and raw-text elements.  Elements are rendered as they close, so nothing but the open elements is held:

* hidden are head, script, style, template, noframes and the like, elements with `hidden` or `display:none`, hidden inputs,
  closed `details` (but for the summary) and closed `dialog`; text under `visibility:hidden` doesn't show, but that of a
  descendant with `visibility:visible` does;
* white space collapses except in pre and textarea; br breaks the line; blocks stand on lines of their own, with
  a blank line around paragraphs, headings, lists, tables and the like;
* list items have a bullet or their number, indented by depth, and definition descriptions are indented;
* a table's cells are aligned: column widths come from all its rows, colspan and rowspan are honoured, cells with several
  lines stay beside each other.  Cells of more than `WIDEST` columns don't widen their column, and a table whose blanks would
  outweigh its text many times over has two blanks between cells instead; tables nested very deep are blocks; nothing is cut off.

No visible character is dropped: every text that isn't hidden appears, in document order (cells row by row; text straight
inside a table, outside its cells, comes before the table, as in browsers).  Time and memory are linear in the page: open elements
are known by tag, so that no tag searches the elements that are open.

Defined results for odd input: a null or empty page has empty text; stray, unclosed or misnested tags never fail;
`<` that begins no tag is text; a null id is carried; repeated rows are each rendered; an empty table gives no
rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import named, ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template iframe noembed noframes datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset menu dir".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address center form details summary dialog li dt dd figcaption legend option optgroup select search hgroup caption tr thead tbody tfoot td th".split())
LISTS = frozenset("ul ol menu dir".split())
#: An open <p> ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
#: begin tag -> (open elements that it ends, elements beyond which none is looked for)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
HEAD_ONLY = frozenset("base link meta title style script noscript template head".split())
_TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
#: A cell of more columns than this doesn't widen its column; the blanks of a table, and how many columns it may span.
WIDEST, BLANKS, MOST_COLUMNS = 100, 8, 1000
#: Tables inside so many others are laid out as blocks, and indentation ends at so many columns.
DEEPEST, MOST_INDENT = 24, 80


def tokens(page: str) -> Iterator[tuple[str, str, dict]]:
    """('text', data, {}), ('open', tag, attributes), ('close', tag, {})."""
    at, n = 0, len(page)
    while at < n:
        low = page.find("<", at)
        if low < 0:
            yield "text", html.unescape(page[at:]), {}
            return
        if low > at:
            yield "text", html.unescape(page[at:low]), {}
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4) if not page.startswith("<!-->", low) else low + 2
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", low):
            end = page.find("]]>", low)
            yield "text", page[low + 9 : n if end < 0 else end], {}
            at = n if end < 0 else end + 3
            continue
        if page[low + 1 : low + 2] in ("!", "?"):
            end = page.find(">", low)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, low)
        if m is None:
            if re.match(r"</?[A-Za-z]", page[low : low + 3]):  # a tag that never ends: the rest of the line is its attributes
                end = page.find(">", low)
                if end < 0:
                    return
                m_name = re.match(r"</?([A-Za-z][^\s/>]*)", page[low:end])
                yield ("close" if page[low + 1] == "/" else "open"), m_name[1].lower(), {}
                at = end + 1
                continue
            yield "text", "<", {}
            at = low + 1
            continue
        tag, at = m[1].lower(), m.end()
        if page[low + 1] == "/":
            yield "close", tag, {}
            continue
        attrs = {}
        if m[2] and not m[2].isspace():
            for a in _ATTR.finditer(m[2]):
                attrs.setdefault(a[1].lower(), html.unescape(next((x for x in a.groups()[1:] if x is not None), "")))
        yield "open", tag, attrs
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = n if end is None else end.start()
            if tag in ("textarea", "title"):
                yield "text", html.unescape(page[at:stop]), {}
            elif tag == "xmp":
                yield "text", page[at:stop], {}
            at = stop


def styled(style: str) -> tuple[bool, str | None]:
    """(display is none, visibility or None): of several declarations the last holds, important ones before others."""
    found: dict[str, tuple[bool, str]] = {}
    for m in _STYLE.finditer(style):
        name, value, important = m[1].lower(), m[2].lower(), bool(m[3])
        if important or not found.get(name, (False, ""))[0]:
            found[name] = (important, value)
    seen = found.get("visibility", (False, "inherit"))[1]
    return found.get("display", (False, ""))[1] == "none", seen if seen in ("visible", "hidden", "collapse") else None


def width(line: str) -> int:
    """Columns of a line in a fixed-width font."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


class Flow:
    """Lines of a block context under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []  # the open line
        self.space = False  # a collapsed blank waits
        self.gap = False  # a blank line waits
        self.prefix = ""  # of the next line
        self.indent = ""

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *rest = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.end_line(True)
                self._put(line)
            return
        data = _BLANK.sub(" ", data)
        if data.startswith(" "):
            self.space = True
        self._put(data.strip(" "))
        if data.endswith(" "):
            self.space = True

    def _put(self, part: str) -> None:
        if part:
            if self.space and self.words:
                self.words.append(" ")
            self.space = False
            self.words.append(part)

    def end_line(self, always: bool = False) -> None:
        if self.words or always:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((self.indent + self.prefix + "".join(self.words)).rstrip())
            if self.prefix:
                self.indent, self.prefix = (self.indent + " " * width(self.prefix))[:MOST_INDENT], ""
        self.words, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end_line()
        if spaced and not self.prefix:
            self.gap = True

    def add_lines(self, lines: list[str]) -> None:
        self.block(True)
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines += [(self.indent + x).rstrip() for x in lines]
        self.gap = True

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[Flow, int, int]]] = []
        self.above: Flow | None = None

    def cell(self, span: int, down: int) -> Flow:
        if not self.rows:
            self.rows.append([])
        flow = Flow()
        self.rows[-1].append((flow, span, down))
        return flow

    def _placed(self) -> list[list[tuple[int, int, list[str], int]]]:
        """Per row that has text, its cells as (first column, columns, lines, width)."""
        until: list[int] = []  # the row where each column is free again
        out = []
        for nth, row in enumerate(self.rows):
            at, cells = 0, []
            for flow, span, down in row:
                while at < len(until) and until[at] > nth:
                    at += 1
                span = max(1, min(span, MOST_COLUMNS - at))
                until += [0] * (at + span - len(until))
                if down != 1:
                    until[at : at + span] = [nth + down if down else len(self.rows)] * span
                lines = flow.done()
                cells.append((at, span, lines, max([0, *map(width, lines)])))
                at += span
            if any(lines for _, _, lines, _ in cells):
                out.append(cells)
        return out

    def done(self) -> list[str]:
        rows = self._placed()
        wide = [0] * max([0, *(at + span for cells in rows for at, span, _, _ in cells)])
        for cells in rows:
            for at, span, _, w in cells:
                if span == 1 and w <= WIDEST:
                    wide[at] = max(wide[at], w)
        for cells in rows:  # what a spanning cell lacks goes to its last column
            for at, span, _, w in cells:
                if span > 1 and w <= WIDEST * span:
                    lack = w - sum(wide[at : at + span]) - 2 * (span - 1)
                    wide[at + span - 1] += max(0, min(lack, WIDEST))
        starts = [0]
        for w in wide:
            starts.append(starts[-1] + w + 2)
        filled = sum(starts[cells[-1][0]] * max(len(lines) for _, _, lines, _ in cells) for cells in rows)
        aligned = filled <= 2000 + BLANKS * sum(len(line) for cells in rows for _, _, lines, _ in cells for line in lines)
        out = list(self.above.done()) if self.above else []
        for cells in rows:
            cells = cells if aligned else [c for c in cells if c[2]]
            for k in range(max(len(lines) for _, _, lines, _ in cells)):
                parts, upto = [], 0
                for at, _, lines, _ in cells:
                    part = lines[k] if k < len(lines) else ""
                    if aligned and part:
                        gap = max(starts[at] - upto, 2 if parts else 0)
                        parts.append(" " * gap + part)
                        upto += gap + width(part)
                    elif part:
                        parts.append("  " + part if parts else part)
                out.append("".join(parts).rstrip())
        return out


class Element:
    __slots__ = ("tag", "hidden", "unseen", "keep", "flow", "table", "count", "indent", "shut")

    def __init__(self, tag: str, parent: "Element | None"):
        self.tag = tag
        self.hidden = parent.hidden if parent else False
        self.unseen = parent.unseen if parent else False  # visibility: its text doesn't show, a descendant's may
        self.keep = parent.keep if parent else False
        self.flow = parent.flow if parent else Flow()
        self.table = parent.table if parent else None
        self.count: int | None = None
        self.indent: str | None = None
        self.shut = False  # closed details: only a summary shows


class Renderer:
    def __init__(self) -> None:
        self.open = [Element("#root", None)]
        self.places: dict[str, list[int]] = {}  # tag -> places of its open elements
        self.blocks: list[int] = []  # places of open block elements
        self.lists: list[Element] = []

    @property
    def top(self) -> Element:
        return self.open[-1]

    def _last(self, tags: set | frozenset) -> int:
        return max((places[-1] for t in tags if (places := self.places.get(t))), default=0)

    def _find(self, tags: set | frozenset, beyond: set) -> int | None:
        """The place of the last open element with one of the tags, unless one beyond which none is looked for comes after it."""
        i = self._last(tags)
        return i if i and i >= self._last(beyond) else None

    def _spaced(self, tag: str) -> bool:
        """Whether blank lines go around the block; not around a list inside a list item."""
        return tag in SPACED and not (tag in LISTS and self.places.get("li"))

    def _push(self, e: Element) -> None:
        if e.tag in BLOCK:
            self.blocks.append(len(self.open))
        self.places.setdefault(e.tag, []).append(len(self.open))
        self.open.append(e)

    def _close_to(self, i: int) -> None:
        while len(self.open) > i:
            e = self.open.pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()
            if e.tag != "#closed":
                self.places[e.tag].pop()
            if self.lists and self.lists[-1] is e:
                self.lists.pop()
            self._leave(e)

    def _leave(self, e: Element) -> None:
        if e.hidden:
            return
        if e.tag == "table" and e.table is not None:
            self.top.flow.add_lines(e.table.done())
        elif e.tag in BLOCK:
            e.flow.block(self._spaced(e.tag))
            if e.tag == "li" and e.flow.prefix:  # an empty item
                e.flow.prefix = ""
        if e.indent is not None:
            e.flow.indent = e.indent

    def start(self, tag: str, attrs: dict) -> None:
        if tag in IMPLIED:
            tags, beyond = IMPLIED[tag]
            while (i := self._find(tags, beyond)) is not None:
                self._close_to(i)
        elif tag not in HEAD_ONLY and self.top.tag == "head":
            self._close_to(len(self.open) - 1)
        if tag in ENDS_P and (i := self._find({"p"}, {"table", "td", "th", "button"})) is not None:
            self._close_to(i)
        if tag in ("html", "body") and self.places.get(tag):
            return
        parent = self.top
        e = Element(tag, parent)
        if parent.shut and tag != "summary":
            e.hidden = True
        gone, seen = styled(attrs["style"]) if "style" in attrs else (False, None)
        if seen:
            e.unseen = seen != "visible"
        if tag in UNSEEN or "hidden" in attrs and attrs["hidden"].lower() != "until-found" or gone or tag == "input" and attrs.get("type", "").lower() == "hidden" or tag == "dialog" and "open" not in attrs:
            e.hidden = True
        if tag == "details" and "open" not in attrs:
            e.shut = True
        if tag in VOID:
            if not e.hidden:
                if tag == "br":
                    e.flow.end_line(True)
                elif tag == "hr":
                    e.flow.block(True)
                elif tag == "wbr":
                    pass
                elif tag == "input" and attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url") and attrs.get("value") and not e.unseen:
                    e.flow.text(f" {attrs['value']} ", False)
            return
        self._push(e)
        if e.hidden:
            return
        if tag == "table" and len(self.places["table"]) > DEEPEST:
            e.flow.block(True)
            e.table = None
        elif tag == "table":
            e.flow.block(True)
            e.table = Table()
            e.flow = Flow()  # text between cells
            e.table.above = e.flow
        elif tag == "tr" and e.table is not None:
            e.table.rows.append([])
        elif tag in ("td", "th") and e.table is not None:
            e.flow = e.table.cell(max(1, _number(attrs.get("colspan", ""), MOST_COLUMNS)), _number(attrs.get("rowspan", ""), 65534))
            e.table = None
        elif tag in BLOCK:
            e.flow.block(self._spaced(tag))
            if tag in ("pre", "textarea"):
                e.keep = True
            elif tag in LISTS:
                self.lists.append(e)
                e.count = int(attrs["start"]) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", attrs.get("start", "")) else 1
            elif tag == "li":
                e.indent = e.flow.indent
                mark = self.lists[-1] if self.lists else None
                if mark is not None and mark.tag == "ol":
                    if re.fullmatch(r"-?[0-9]{1,9}", attrs.get("value", "")):
                        mark.count = int(attrs["value"])
                    if not e.unseen:
                        e.flow.prefix = f"{mark.count}. "
                    mark.count += 1
                elif not e.unseen:
                    e.flow.prefix = "- "
            elif tag in ("dd", "blockquote"):
                e.indent = e.flow.indent
                e.flow.indent = (e.flow.indent + "    ")[:MOST_INDENT]
        elif tag == "textarea":
            e.keep = True

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
            return
        if tag == "p" and self._find({"p"}, {"table", "td", "th"}) is None:
            self.start("p", {})
        if tag in ("html", "body") or tag in VOID:
            return
        beyond = set() if tag in ("table", "tr", "td", "th", "thead", "tbody", "tfoot") else {"td", "th", "table"}
        i = self._find({tag}, beyond)
        if i is None:
            return
        if tag not in BLOCK and tag not in UNSEEN and self.blocks and self.blocks[-1] > i:
            self.places[tag].pop()
            self.open[i].tag = "#closed"  # a misnested inline element ends without closing the blocks inside it
            if not self.open[i].hidden:
                return
        self._close_to(i)

    def text(self, data: str) -> None:
        e = self.top
        if e.tag == "head":
            if not data.strip():
                return
            self._close_to(len(self.open) - 1)
            e = self.top
        if not e.hidden and not e.shut and not e.unseen:
            e.flow.text(data, e.keep)


def _number(text: str, most: int) -> int:
    return min(most, int(text)) if text.isascii() and text.isdigit() and len(text) < 7 else 1


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    r = Renderer()
    for kind, value, attrs in tokens(page):
        if kind == "text":
            r.text(value)
        elif kind == "open":
            r.start(value, attrs)
        else:
            r.end(value)
    r._close_to(1)
    lines = r.open[0].flow.done()
    while lines and not lines[-1]:
        lines.pop()
    first = next((i for i, x in enumerate(lines) if x), 0)
    return "\n".join(lines[first:])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, 512):
            batch = whole.slice(low, 512)
            texts = [render(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names=["page_id", "text", "n_lines"])


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_lines) of every row."""
    ship(pages.sparkSession)
    rows = pages.select(named(id_col).cast("long").alias("page_id"), named(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_render, "page_id long, text string, n_lines long")
