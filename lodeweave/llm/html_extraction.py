"""HTML extraction by layout-aware rendering.

A tree builder with implied tags keeps the stack of open elements; a renderer turns what is visible
into lines: inline text with white space collapsed, blank lines between blocks, bullets and numbers
for lists, and tables with aligned cells. Both are loops over one stack, so deep nesting is no
recursion. Tags are read by the standard's tokenizer rules: a quote opens a string only as the first
character of an attribute's value. ``display: none`` and ``hidden`` take a whole subtree away;
``visibility`` is inherited and can be undone below; of details and dialogs that are not open only the
summary shows. Alternative texts and form values are not text. Options are lines; text areas and xmp are
preformatted; formulas and the labels of drawings are inline text, in the order of the source. Not text
are what browsers keep for those that cannot show something better (noscript, object, audio, video,
canvas, datalist, iframe, noembed, noframes), annotations of formulas, and titles, descriptions,
definitions and text outside of text elements in drawings.

Layout costs a bounded number of characters a line, so the result is linear in the page: indents grow
to ``MOST_INDENT`` columns, a column of a table pads to ``WIDE``, a table's line is padded with at most
``PAD`` characters in all, and cells of tables nested over ``DEEP`` deep stand one below the other. Text is
never cut by this.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Element classes of the HTML standard, as far as layout needs them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title plaintext".split())
HIDDEN = set("head script style template noscript iframe object audio video canvas datalist title noembed noframes".split())
SHOWN_RAW = {"textarea", "xmp", "plaintext"}
PRE = {"pre"} | SHOWN_RAW
#: Elements whose content is not HTML, with what is not shown of it.
FOREIGN = {"svg": set("title desc defs metadata style script".split()), "math": set("annotation annotation-xml style script".split())}
#: Elements of foreign content that hold HTML again, and HTML elements that end foreign content.
ISLANDS = set("svg:foreignobject svg:desc svg:title math:annotation-xml math:mi math:mo math:mn math:ms math:mtext".split())
BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre xmp plaintext figure fieldset hr".split())
BLOCK = SPACED | set("html body div section article aside header footer nav main address dt dd li form figcaption legend details summary center caption hgroup search dialog dir select option optgroup textarea".split())
CLOSES_P = SPACED | set("div section article aside header footer nav main address form figcaption details summary center dt dd li dialog dir hgroup search".split())
TABLE_PARTS = set("caption colgroup thead tbody tfoot tr td th".split())
FENCE = {"table", "td", "th", "caption", "button", "object", "template", "html"}

#: The most columns and rows that the standard lets a cell span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
MOST_INDENT, WIDE, PAD, DEEP = 60, 60, 200, 8

_VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+"
_ATTRIBUTES = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE})?+)?+)*+"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^>]++(?:>|\Z)|</>|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s\"'>][^\s>]*+))?+)?+", re.S)
SHOWS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


def _attributes(attrs: str) -> dict[str, str]:
    """Names in lower case with their values; of equal names the first counts."""
    given: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        given.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return given


def _self_closing(attrs: str) -> bool:
    """If a tag's ``/`` ends it, rather than an unquoted value."""
    if not attrs.endswith("/"):
        return False
    last = None
    for last in ATTRIBUTE.finditer(attrs):
        pass
    return last is None or last.end() < len(attrs)


def _said(given: dict[str, str], foreign: bool) -> dict[str, str]:
    """What an element says of its display and visibility, by attribute (in drawings) or style."""
    said = {k: given[k].strip().lower() for k in ("display", "visibility") if k in given} if foreign else {}
    strong: set[str] = set()
    if "style" in given:
        for m in SHOWS.finditer(re.sub(r"(?s)/\*.*?(?:\*/|\Z)", " ", given["style"])):
            name = m[1].lower()
            if m[3] or name not in strong:
                said[name] = m[2].lower()
                if m[3]:
                    strong.add(name)
    return said


class _Box:
    """Lines being laid out: the page, or one table cell."""

    __slots__ = ("blank", "bullet", "indent", "line", "lines", "width")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = 0
        self.indent: list[int] = []
        self.width = 0
        self.bullet = ""

    def deepen(self, n: int) -> None:
        self.indent.append(n)
        self.width += n

    def back(self) -> None:
        self.width -= self.indent.pop()

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *more = s.replace("\r\n", "\n").split("\n")
            self.line.append(first)
            for x in more:
                self.flush(True)
                self.line.append(x)
            return
        s = SPACES.sub(" ", s)
        if not self.line or self.line[-1][-1:] in ("", " "):
            s = s.lstrip(" ")
        if s:
            self.line.append(s)

    def flush(self, forced: bool = False) -> None:
        """End the line; ``forced`` keeps an empty one."""
        s = "".join(self.line).rstrip(" \t")
        self.line = []
        if not s and not forced:
            return
        if self.lines:
            self.lines += [""] * self.blank
        self.blank = 0
        lead = " " * min(self.width, MOST_INDENT)
        if self.bullet and s:
            lead = lead[: max(0, len(lead) - len(self.bullet))] + self.bullet
            self.bullet = ""
        self.lines.append((lead + s).rstrip(" \t"))

    def space(self, n: int) -> None:
        self.flush()
        self.blank = max(self.blank, n)

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _span(value: str | None, most: int) -> int:
    return min(most, max(1, int(value[:9]))) if value and value.isascii() and value.isdigit() else 1


def _columns(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Every row's cells as (first column, columns, lines); a column that a cell above still covers is passed over."""
    covered: list[list[int]] = []  # [first column, column after the last, row after the last], in order, none touching
    out = []
    for r, row in enumerate(rows):
        covered = [x for x in covered if x[2] > r]
        at, k, placed, deep = 0, 0, [], []
        for lines, cols, tall in row:
            while k < len(covered) and covered[k][0] <= at:
                at = max(at, covered[k][1])
                k += 1
            placed.append((at, cols, lines))
            if tall > 1:
                deep.append([at, at + cols, r + tall])
            at += cols
        if deep:
            joined: list[list[int]] = []
            for x in sorted(covered + deep):
                if joined and joined[-1][1] == x[0] and joined[-1][2] == x[2]:
                    joined[-1][1] = x[1]
                else:
                    joined.append(x)
            covered = joined
        out.append(placed)
    return out


def _laid_out(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """A table's rows of (lines, colspan, rowspan) as aligned text, with at most ``PAD`` characters of padding a line."""
    grid = _columns(rows)
    starts = sorted({c for row in grid for c, _, _ in row})
    widths = dict.fromkeys(starts, 0)
    for row in grid:
        for c, cols, lines in row:
            if cols == 1:
                widths[c] = max(widths[c], min(WIDE, max(map(len, lines), default=0)))
    place = {c: i for i, c in enumerate(starts)}
    offset = [0]  # where each column that some cell starts in begins, if all is padded
    for c in starts:
        offset.append(offset[-1] + widths[c] + 3)
    out = []
    for row in grid:
        by_line: list[list[tuple[int, str]]] = []
        for c, _, lines in row:
            for i, x in enumerate(lines):
                if i == len(by_line):
                    by_line.append([])
                by_line[i].append((place[c], x))
        for cells in by_line:
            parts: list[str] = []
            left, at, end = PAD, 0, 0  # padding left, columns passed, end of the last cell's text
            for c, x in cells:
                if not x:
                    continue
                gap = offset[c] - end
                if gap < 3 * (c > 0):
                    parts.append(" | " if parts else "")
                    gap = 0
                elif gap <= left:
                    left -= gap
                    for j in range(at, c):  # the separators of the columns between
                        parts.append(" " * (offset[j + 1] - 3 - max(end, offset[j])) + " | ")
                        end = offset[j + 1]
                elif parts:
                    parts.append(" | ")
                parts.append(x)
                at, end = c, max(end, offset[c]) + len(x)
            if parts:
                out.append("".join(parts).rstrip())
    return [x for x in out if x.strip(" |")]


class _Element:
    __slots__ = ("delta", "name", "realm", "shown", "state", "visible")

    def __init__(self, name: str, delta: int, state: object, shown: bool, visible: bool, realm: str) -> None:
        self.name, self.delta, self.state, self.shown, self.visible, self.realm = name, delta, state, shown, visible, realm


class _Page:
    """The stack of open elements, and the boxes being filled. ``realm`` of an element's content is svg, math or HTML ("")."""

    def __init__(self) -> None:
        self.stack: list[_Element] = []
        self.at: dict[str, list[int]] = {}  # where on the stack the elements of a name are
        self.blocks: list[int] = []  # where the blocks are
        self.hidden = self.pre = self.tables = 0
        self.boxes = [_Box()]

    # the stack ----------------------------------------------------------------------------

    def realm(self) -> str:
        return self.stack[-1].realm if self.stack else ""

    def visible(self) -> bool:
        return not self.stack or self.stack[-1].visible

    def find(self, names: set[str], fence: set[str]) -> int:
        """Where the last open element of these names is, or -1 if an element of the fence is above it."""
        i = max([own[-1] for n in names if (own := self.at.get(n))], default=-1)
        if i < 0 or not fence:
            return i
        return i if i >= max([own[-1] for n in fence if (own := self.at.get(n))], default=-1) else -1

    def close_from(self, i: int) -> None:
        while i >= 0 and len(self.stack) > i:
            self.pop()

    def start(self, name: str, attrs: str) -> None:
        if self.realm():
            if name not in BREAKOUT:
                if not _self_closing(attrs):
                    self.push(f"{self.realm()}:{name}", attrs)
                return
            while self.realm():
                self.pop()
        if name in ("html", "body"):
            return
        if name != "head" and self.stack and self.stack[-1].name == "head" and name not in (RAW - SHOWN_RAW) | VOID | {"template", "noscript"}:
            self.pop()  # the body is implied
        if name in CLOSES_P:
            self.close_from(self.find({"p"}, FENCE))
        if name in ("h1", "h2", "h3", "h4", "h5", "h6") and self.stack and re.fullmatch("h[1-6]", self.stack[-1].name):
            self.pop()
        if name == "li":
            self.close_from(self.find({"li"}, FENCE | {"ul", "ol", "menu"}))
        elif name in ("dt", "dd"):
            self.close_from(self.find({"dt", "dd"}, FENCE | {"dl"}))
        elif name in ("option", "optgroup"):
            self.close_from(self.find({"option"} if name == "option" else {"option", "optgroup"}, FENCE | {"select"}))
        elif name in TABLE_PARTS:
            table = self.find({"table"}, {"template"})
            if table < 0:
                return  # a table part outside a table is no element
            last = {"td": {"tr"}, "th": {"tr"}, "tr": {"tbody", "thead", "tfoot"}}.get(name, set())
            while len(self.stack) > table + 1 and self.stack[-1].name not in last:
                self.pop()
            if name == "tr" and self.stack[-1].name == "table":
                self.push("tbody", "")
            elif name in ("td", "th") and self.stack[-1].name != "tr":
                if self.stack[-1].name == "table":
                    self.push("tbody", "")
                self.push("tr", "")
        if name in VOID:
            if not self.hidden:
                if name == "br":
                    self.boxes[-1].flush(True)
                elif name == "hr":
                    self.boxes[-1].space(1)
            return
        if name in FOREIGN and _self_closing(attrs):
            return
        self.push(name, attrs)

    def push(self, name: str, attrs: str) -> None:
        realm, visible = self.realm(), self.visible()
        delta = int(name in HIDDEN or bool(realm) and name.partition(":")[2] in FOREIGN[realm])
        given: dict[str, str] = {}
        if attrs and not attrs.isspace():
            given = _attributes(attrs)
            said = _said(given, bool(realm) or name in FOREIGN)
            delta = int(delta or (said["display"] == "none" if "display" in said else "hidden" in given))
            if said.get("visibility") in ("hidden", "collapse"):
                visible = False
            elif said.get("visibility") in ("visible", "initial"):
                visible = True
        above = self.stack[-1] if self.stack else None
        if name == "dialog" and "open" not in given:
            delta = 1
        elif name == "summary" and above and above.name == "details" and above.state == "closed":
            above.state = "summed up"
            delta -= above.delta  # shown although what surrounds it is not
        self.hidden += delta
        shown, state = not self.hidden, None
        if shown:
            box = self.boxes[-1]
            if name in BLOCK:
                box.space(1 if name in SPACED and not (name in ("ul", "ol", "menu") and box.indent) else 0)
            if name == "ol":
                first = given.get("start", "1")
                state = [int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1]
            elif name == "li":
                top = self.find({"ul", "ol", "menu"}, FENCE)
                count = self.stack[top].state if top >= 0 and self.stack[top].name == "ol" else None
                bullet = "- "
                if count:
                    bullet = f"{count[0]}. "
                    count[0] += 1
                box.deepen(len(bullet))
                box.bullet = bullet if visible else ""
            elif name in ("blockquote", "dd"):
                box.deepen(2)
            elif name in PRE:
                self.pre += 1
            elif name in ("svg:text", "math:mtd"):
                box.text(" ", False)
            elif name == "table":
                self.tables += 1
                state = [] if self.tables <= DEEP else None
            elif self.tables > DEEP and name in ("td", "th", "caption"):
                box.flush()
            elif name == "tr":
                state = []
            elif name in ("td", "th", "caption"):
                self.boxes.append(_Box())
                state = (_span(given.get("colspan"), MOST_COLUMNS), _span(given.get("rowspan"), MOST_ROWS))
            if name == "details" and "open" not in given:
                self.hidden += 1
                delta, state = delta + 1, "closed"
        realm = name if name in FOREIGN else "" if name in ISLANDS else realm
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(_Element(name, delta, state, shown, visible, realm))

    def pop(self) -> None:
        e = self.stack.pop()
        name = e.name
        if not name:
            return  # it ended before
        self.at[name].pop()
        if name in BLOCK:
            self.blocks.pop()
        self.hidden -= e.delta
        if not e.shown:
            return
        box = self.boxes[-1]
        if name in ("td", "th", "caption") and e.state is None:
            box.flush()
        elif name in ("td", "th", "caption"):
            lines = self.boxes.pop().done()
            table = self.find({"tr"} if name != "caption" else {"table"}, set())
            if table >= 0 and isinstance(self.stack[table].state, list):
                self.stack[table].state.append((lines, *e.state) if name != "caption" else [(lines, MOST_COLUMNS, 1)])
        elif name == "tr":
            table = self.find({"table"}, set())
            if table >= 0 and e.state and isinstance(self.stack[table].state, list):
                self.stack[table].state.append(e.state)
        elif name == "table":
            box.space(1)
            for line in _laid_out(e.state or []):
                box.line = [line]
                box.flush()
            box.blank = 1
            self.tables -= 1
        elif name in BLOCK:
            box.space(1 if name in SPACED and not (name in ("ul", "ol", "menu") and box.indent) else 0)
            if name in ("li", "blockquote", "dd"):
                box.back()
                if name == "li":
                    box.bullet = ""
            elif name in PRE:
                self.pre -= 1
        elif name in ("svg:text", "math:mtd"):
            box.text(" ", False)

    def end(self, name: str) -> None:
        if any(self.at.get(r) for r in FOREIGN):
            i = max(self.find({f"{r}:{name}"}, set()) for r in FOREIGN)
            if i > self.find({name}, FENCE):
                self.close_from(i)
                return
        if name in ("p", "br"):
            if name == "br" or self.find({"p"}, FENCE) < 0:
                self.start(name, "")
        if name in TABLE_PARTS or name == "table":
            i = self.find({name}, {"table"} - {name})
        elif name in BLOCK or name in HIDDEN or name in FOREIGN:
            i = self.find({name}, FENCE)
        else:  # an inline element may end across blocks, which stay open
            i = self.find({name}, FENCE | {"li"})
            if i >= 0 and self.blocks and self.blocks[-1] > i:
                e = self.stack[i]
                self.hidden -= e.delta
                self.at[name].pop()
                e.name, e.delta = "", 0
                return
        self.close_from(i)

    def text(self, s: str) -> None:
        top = self.stack[-1] if self.stack else None
        if top and top.name == "head":
            if s.isspace():
                return
            self.pop()
            top = self.stack[-1] if self.stack else None
        if self.hidden or not self.visible() or self.realm() == "svg" and not self.at.get("svg:text"):
            return
        if top and top.name in ("table", "tbody", "thead", "tfoot", "tr"):
            if s.isspace():
                return
            self.boxes[-1].text(s, False)  # text between cells is moved before the table
            return
        self.boxes[-1].text(s, self.pre > 0)

    def done(self) -> str:
        self.close_from(0)
        return "\n".join(self.boxes[0].done())


def render(source: str | None) -> str:
    """The visible text of a page."""
    page, raw, at, source = _Page(), "", 0, source or ""
    while at < len(source):
        if raw:  # everything up to the end tag is text of the raw element
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(source, at) if raw != "plaintext" else None
            end = m.start() if m else len(source)
            if raw in SHOWN_RAW:
                s = re.sub(r"\A\r?\n", "", source[at:end]) if raw == "textarea" else source[at:end]
                page.text(entities.unescape(s) if raw == "textarea" else s)
            at, raw = end, ""
            continue
        if page.realm() and source.startswith("<![CDATA[", at):
            end = source.find("]]>", at)
            page.text(source[at + 9 : end if end >= 0 else len(source)])
            at = end + 3 if end >= 0 else len(source)
            continue
        m = TOKEN.match(source, at)
        at = m.end()
        name = m[2]
        if name is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                page.text(entities.unescape(s) if "&" in s else s)
        else:
            name = name.lower()
            if m[1]:
                page.end(name)
            else:
                html = not page.realm()
                page.start(name, m[3])
                if html and name in RAW and (name in SHOWN_RAW or not _self_closing(m[3])):
                    raw = name
    return page.done()


def extract(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, text and n_lines per row: the whole visible text of every page.

    A null or empty page gives an empty text; markup that never closes is closed at the end; long pages
    take one pass; repeated rows and null keys pass through; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [render(x.as_py()) for x in part.column(1)]
                lines = [t.count("\n") + 1 if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], ["key", "text", "n_lines"])

    kind = pages.schema[key].dataType.simpleString()
    return mapped(pages.select(F.col(key).alias("key"), F.col(html).alias("html")), run, f"key {kind}, text string, n_lines long").withColumnRenamed("key", key)
