"""Layout-aware text of HTML pages.

A tokenizer feeds a tree builder that supplies implied tags (open paragraphs,
items, cells, rows and options end where the next one begins; cells get a row,
stray end tags are dropped) and keeps the open elements with their visibility.
The renderer lays out what a reader with a text browser would see: block
spacing with collapsing margins, collapsed white space (but in ``pre``), list
markers with hanging indents, and tables with aligned cells.

Invisible are ``HIDDEN`` elements, the ``hidden`` attribute, ``display:none``,
``visibility:hidden`` (which a descendant can undo), and the content of closed
``details`` and ``dialog`` elements. All other text is emitted.

There is no recursion and each character is scanned a bounded number of times,
so depth and length of a page are not limited. Cells wrap at ``WRAP`` characters,
between words; a longer word stands in a line of its own below, so every column of
every table is aligned, and one wide cell cannot multiply the output. Nested blocks
are indented, each by ``INDENT``; as text browsers do, the margin stays where it is
once it has reached ``MOST_INDENT`` (markers and text of deeper blocks are shown in
full at that margin).

Defined cases: a null page has null text; an empty one, or one without visible
text, has empty text; a tag that the page's end cuts off is dropped with the
rest, as browsers do; repeated rows are rendered each; an empty table stays empty.
All columns are kept; one named like the added one is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm.common import pieces

#: Characters of a table cell's line, and of the indentation of a block and of all blocks around it.
WRAP = 60
INDENT, MOST_INDENT = 4, 80
MOST_COLSPAN, MOST_ROWSPAN = 1000, 65534

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "area audio base canvas datalist embed head iframe link meta noembed noframes noscript object param rp script "
    "source style svg template title track video".split()
)
RAW = frozenset("iframe noembed noframes noscript script style title xmp textarea".split())
#: Of these the text is shown as it stands.
SHOWN_RAW = frozenset("xmp textarea".split())
BLOCKS = frozenset(
    "address article aside body blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre "
    "search section summary table ul xmp caption".split()
)
SPACED = frozenset("blockquote dl figure fieldset h1 h2 h3 h4 h5 h6 hr listing menu ol p pre ul dir table xmp".split())
ENDS_P = BLOCKS - frozenset("p body html option optgroup caption legend".split()) | {"p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
PRE = frozenset("pre listing xmp textarea plaintext".split())
#: What a start tag ends: the elements it closes, and those that its search does not cross.
IMPLIED = {
    "li": (frozenset(["li"]), LISTS | CELLS | {"table"}),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"]) | CELLS),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"]) | CELLS),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup", "table"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "table"])),
    "tr": (frozenset(["tr", "caption"]) | CELLS, frozenset(["table"])),
    "td": (CELLS | {"caption"}, frozenset(["table", "tr"])),
    "th": (CELLS | {"caption"}, frozenset(["table", "tr"])),
    "thead": (SECTIONS | CELLS | {"tr", "caption"}, frozenset(["table"])),
    "tbody": (SECTIONS | CELLS | {"tr", "caption"}, frozenset(["table"])),
    "tfoot": (SECTIONS | CELLS | {"tr", "caption"}, frozenset(["table"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
P_SCOPE = CELLS | frozenset("table caption html button object template marquee".split())
TABLE_PARTS = SECTIONS | CELLS | frozenset("table tr caption".split())

_MARKUP = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|/[^a-zA-Z>][^>]*+(?:>|\Z)|/>"
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)(>|\Z))",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility|white-space)\s*:\s*([\w-]+)")
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        found.setdefault(m[1].lower(), html.unescape(value))
    return found


def number_in(value: str | None, otherwise: int) -> int:
    m = _NUMBER.match(value or "")
    return int(m[1]) if m else otherwise


class Flow:
    """Lines of a block: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent = ""
        self.marker: str | None = None
        self.gap = 0
        self.spaced = True

    def words(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if self.spaced and text[:1] == " ":
            text = text[1:]
        if text:
            self.line.append(text)
            self.spaced = text[-1] == " "

    def as_is(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line.append(first)
        for more in rest:
            self.end_line(keep=True)
            self.line.append(more)
        self.spaced = False

    def end_line(self, keep: bool = False) -> None:
        """End the current line if it has text, or in any case if ``keep``."""
        text = "".join(self.line).rstrip(" ")
        self.line.clear()
        self.spaced = True
        if text or keep:
            self.put([text])

    def put(self, lines: list[str]) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        for text in lines:
            head = self.indent
            if self.marker is not None:
                head = self.indent[: max(0, len(self.indent) - len(self.marker))] + self.marker
                self.marker = None
            self.lines.append((head + text).rstrip(" "))

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def end(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def wrapped(line: str) -> list[str]:
    """A line in lines of at most WRAP characters, cut at spaces; longer words stay whole."""
    out = []
    while len(line) > WRAP:
        inner = len(line) - len(line.lstrip(" "))
        at = line.rfind(" ", inner, WRAP + 1)
        if at < 0 and (at := line.find(" ", max(inner, WRAP))) < 0:
            break
        out.append(line[:at].rstrip(" "))
        line = line[at:].lstrip(" ")
    return [*out, line]


class Table:
    """Cells of a table, laid out when it ends."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[Flow, int, int]]] = []

    def cell(self, colspan: int, rowspan: int) -> Flow:
        if not self.rows:
            self.rows.append([])
        flow = Flow()
        self.rows[-1].append((flow, colspan, rowspan))
        return flow

    def layout(self) -> list[str]:
        taken: dict[int, int] = {}  # column: rows that a cell above still covers
        placed: list[list[tuple[int, int, list[str]]]] = []
        widths: dict[int, int] = {}
        for row in self.rows:
            column, out, now = 0, [], dict(taken)
            for flow, colspan, rowspan in row:
                while now.get(column, 0):
                    column += 1
                lines = [part for line in flow.end() for part in (wrapped(line) if len(line) > WRAP else (line,))]
                out.append((column, colspan, lines))
                if colspan == 1:
                    widths[column] = max(widths.get(column, 0), max((len(x) for x in lines if len(x) <= WRAP), default=0))
                if rowspan > 1:
                    taken.update(dict.fromkeys(range(column, column + colspan), rowspan))
                column += colspan
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
            placed.append(out)
        used = sorted({c for out in placed for c, _, _ in out})
        starts, at = {}, 0
        for column in used:
            starts[column] = at
            if widths.get(column):
                at += widths[column] + 2
        lines: list[str] = []
        for out in placed:
            for k in range(max((len(cell) for _, _, cell in out), default=0)):
                text = ""
                for column, _, cell in out:
                    if k < len(cell) and cell[k]:
                        if text and len(text) + 2 > starts[column]:
                            # what reaches into this column ends its line
                            lines.append(text)
                            text = ""
                        text += " " * (starts[column] - len(text)) + cell[k]
                lines.append(text)
        return lines


class Element:
    __slots__ = ("counter", "flow", "gap", "hidden", "indent", "pre", "shut", "table", "tag", "unseen")

    def __init__(self, tag: str, hidden: bool, unseen: bool, pre: bool) -> None:
        self.tag, self.hidden, self.unseen, self.pre = tag, hidden, unseen, pre
        self.shut = False
        self.counter = 0
        self.gap = 0
        self.indent: str | None = None
        self.flow: Flow | None = None
        self.table: Table | None = None


class Page:
    """Tree builder and renderer of one page."""

    def __init__(self) -> None:
        self.flow = Flow()
        self.open = [Element("#root", False, False, False)]
        self.count: dict[str, int] = {}
        self.tables: list[Table] = []

    def render(self, source: str) -> str:
        at = 0
        while True:
            m = _MARKUP.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                if source.startswith("<![CDATA[", m.start()) and self.count.get("svg", 0) + self.count.get("math", 0):
                    self.text(source[m.start() + 9 : at].removesuffix("]]>"), raw=True)
                continue
            if not m[4]:
                break
            tag = m[2].lower()
            if m[1]:
                self.end_tag(tag)
                continue
            self.start_tag(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
                stop = end.start() if end else len(source)
                if tag in SHOWN_RAW:
                    content = source[at:stop]
                    self.text(content if tag == "xmp" else html.unescape(content), raw=True)
                at = stop
                if end is None:
                    break
            elif tag in ("pre", "listing") and source.startswith("\n", at):
                at += 1
            elif tag == "plaintext":
                self.text(source[at:], raw=True)
                break
        self.close_to(1)
        return "\n".join(self.flow.end())

    def text(self, text: str, raw: bool = False) -> None:
        top = self.open[-1]
        if top.hidden or top.unseen or top.shut or not text:
            return
        if "&" in text and not raw:
            text = html.unescape(text)
        if top.pre:
            self.flow.as_is(text)
        else:
            self.flow.words(text)

    # tree building

    def find(self, tags: frozenset[str], stop: frozenset[str]) -> int:
        """Index of the innermost open element of ``tags``, not beyond ``stop``; 0 if none."""
        if not any(self.count.get(t) for t in tags):
            return 0
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                return i
            if tag in stop:
                return 0
        return 0

    def close_to(self, size: int) -> None:
        while len(self.open) > size:
            self.leave(self.open.pop())

    def start_tag(self, tag: str, rest: str) -> None:
        if tag in ("html", "body", "head") and self.count.get(tag):
            return
        if tag in ENDS_P and (i := self.find(frozenset(["p"]), P_SCOPE)):
            self.close_to(i)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.close_to(len(self.open) - 1)
        if tag == "body" and (i := self.find(frozenset(["head"]), frozenset())):
            self.close_to(i)
        elif self.open[-1].tag == "head" and tag not in HIDDEN:
            self.close_to(len(self.open) - 1)
        if rule := IMPLIED.get(tag):
            while i := self.find(*rule):
                self.close_to(i)
        if tag in CELLS and self.tables and self.open[-1].tag in SECTIONS | {"table"}:
            self.enter("tr", "")
        self.enter(tag, rest)
        if tag in VOID:
            self.leave(self.open.pop())

    def end_tag(self, tag: str) -> None:
        if tag == "br":
            self.start_tag("br", "")
        if tag in ("body", "html", "br"):
            return
        stop = frozenset(["table"]) if tag in TABLE_PARTS else CELLS | {"table", "caption"}
        tags = HEADINGS if tag in HEADINGS else frozenset([tag])
        if i := self.find(tags, stop - tags):
            self.close_to(i)

    # layout

    def enter(self, tag: str, rest: str) -> None:
        above = self.open[-1]
        low = rest.lower()
        own = attributes(rest) if low.strip(" /\n\t\r\f") and (tag in ("ol", "li", "td", "th", "details", "dialog") or "style" in low or "hidden" in low) else {}
        style = dict(_STYLE.findall(own.get("style", "").lower())) if own else {}
        e = Element(tag, above.hidden or above.shut and tag != "summary", above.unseen, above.pre or tag in PRE)
        if tag in HIDDEN or "hidden" in own and own["hidden"].lower() != "until-found" or style.get("display") == "none":
            e.hidden = True
        if "visibility" in style:
            e.unseen = style["visibility"] in ("hidden", "collapse")
        if "white-space" in style:
            e.pre = style["white-space"].startswith("pre") and style["white-space"] != "pre-line"
        if tag == "details" and "open" not in own:
            e.shut = True
        elif tag == "dialog" and "open" not in own:
            e.hidden = True
        elif tag != "summary" and above.shut:
            e.shut = True
        self.open.append(e)
        self.count[tag] = self.count.get(tag, 0) + 1
        if e.hidden:
            return
        flow = self.flow
        if tag == "br":
            flow.end_line(keep=not flow.spaced or not flow.line and bool(flow.lines))
        elif tag == "table":
            flow.block(1)
            e.table = Table()
            self.tables.append(e.table)
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in CELLS and self.tables:
            e.flow, spans = flow, (own.get("colspan"), own.get("rowspan"))
            colspan = min(MOST_COLSPAN, max(1, number_in(spans[0], 1)))
            rowspan = min(MOST_ROWSPAN, max(1, number_in(spans[1], 1)))
            self.flow = self.tables[-1].cell(colspan, rowspan)
        elif tag in BLOCKS or tag in CELLS or tag == "tr" or style.get("display") == "block":
            inside = tag in LISTS and any(self.count.get(t, 0) > (t == tag) for t in LISTS)
            e.gap = 1 if tag in SPACED and not inside else 0
            flow.block(e.gap)
            e.indent = flow.indent
            step = " " * INDENT if len(flow.indent) < MOST_INDENT else ""
            if tag in ("blockquote", "dd"):
                flow.indent += step
            elif tag == "ol":
                e.counter = number_in(own.get("start"), 1)
            elif tag == "li":
                flow.indent += step
                flow.marker = self.item_marker(own).rjust(INDENT)

    def item_marker(self, own: dict[str, str]) -> str:
        for e in reversed(self.open[:-1]):
            if e.tag == "ol":
                e.counter = number_in(own.get("value"), e.counter)
                e.counter += 1
                return f"{e.counter - 1}. "
            if e.tag in LISTS or e.tag in CELLS:
                break
        return "* "

    def leave(self, e: Element) -> None:
        self.count[e.tag] -= 1
        if e.hidden:
            return
        if e.flow is not None:
            self.flow = e.flow
        elif e.table is not None:
            self.tables.remove(e.table) if self.tables[-1] is not e.table else self.tables.pop()
            lines = e.table.layout()
            self.flow.block(1)
            if lines:
                self.flow.put(lines)
            self.flow.gap = 1
        elif e.indent is not None:
            self.flow.block(e.gap)
            self.flow.indent = e.indent
            if e.tag == "li":
                self.flow.marker = None


def text_of(source: str | None) -> str | None:
    return None if source is None else Page().render(source)


TEXT = "htmltext__text"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = [text_of(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, TEXT])


def with_text(pages: DataFrame) -> DataFrame:
    """All rows and columns of ``pages`` (with a string ``html``), and TEXT."""
    pages = pages.drop(TEXT)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in pages.schema])
    return pages.mapInArrow(_render, schema.add(TEXT, T.StringType()))
