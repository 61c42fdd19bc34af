"""Visible text of HTML pages, laid out: blocks, lists and tables keep their shape.

A page is cut into tags and text by one pattern.  Tags open and close elements on a stack,
with the end tags that HTML implies, so every piece of text has its place in the tree, its
visibility and its box.  Boxes collect lines: blocks break them, list items indent theirs,
table cells are gathered by row and set in columns when their table closes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<end>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|[\"'])*+)>|(?P<text>[^<]+|<)",
    re.S,
)
_BEGUN = re.compile(r"</?[A-Za-z]")
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")

_words = lambda s: frozenset(s.split())
#: Fixed values, from the HTML standard: which elements are void, raw, not shown, blocks, and end a paragraph.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title xmp iframe noembed noframes noscript")
UNSEEN = _words("head script style template noscript iframe noembed noframes object audio video canvas datalist param title area base link meta source track")
#: Inside pictures and formulas only these are not shown.
FOREIGN = {"svg": _words("title desc metadata defs"), "math": _words("annotation annotation-xml")}
SPACED = _words("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset")
BLOCK = SPACED | _words("html body address article aside center details dialog dd dir div dt figcaption footer form header hgroup hr legend li main menu nav option optgroup search section summary caption tr thead tbody tfoot td th")
ENDS_P = _words("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt")
HEAD = _words("base link meta title style script noscript template head")
CELLS, GROUPS = _words("td th"), _words("thead tbody tfoot")
#: What a start tag ends, and where the search for it stops.
IMPLIED = {
    "li": (_words("li"), _words("ul ol menu dir table td th")),
    "dt": (_words("dt dd"), _words("dl table td th")),
    "dd": (_words("dt dd"), _words("dl table td th")),
    "option": (_words("option"), _words("select datalist")),
    "optgroup": (_words("option optgroup"), _words("select")),
    "td": (CELLS | {"caption"}, _words("tr table")),
    "th": (CELLS | {"caption"}, _words("tr table")),
    "tr": (_words("tr caption"), _words("table")),
    **{g: (GROUPS | {"caption", "tr"}, _words("table")) for g in GROUPS},
}


class Box:
    """Lines of text; blank lines between blocks come once."""

    def __init__(self):
        self.lines, self.now, self.blank = [], [], False

    def say(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            if first:
                self._begin()
                self.now.append(first)
            for line in rest:
                self.line(True)
                if line:
                    self.now.append(line)
            return
        text = _SPACE.sub(" ", text)
        if not self.now or self.now[-1][-1:] == " ":
            text = text.lstrip(" ")
        if text:
            self._begin()
            self.now.append(text)

    def _begin(self) -> None:
        if self.blank and not self.now:
            if self.lines:
                self.lines.append("")
            self.blank = False

    def line(self, always: bool = False) -> None:
        """End the line; ``always`` ends an empty one as well."""
        text = "".join(self.now).rstrip()
        if text or always:
            self._begin()
            self.lines.append(text)
        self.now = []

    def space(self) -> None:
        self.line()
        self.blank = True

    def put(self, lines: list[str]) -> None:
        self.line()
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines += lines

    def end(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Element:
    __slots__ = ("box", "cells", "gone", "hidden", "number", "pre", "rows", "span", "tag")

    def __init__(self, tag, box, gone=False, hidden=False, pre=False):
        self.tag, self.box, self.gone, self.hidden, self.pre = tag, box, gone, hidden, pre
        self.number, self.rows, self.span, self.cells = None, None, (1, 1), None


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _number(text: str, most: int) -> int:
    m = re.match(r"\s*\+?([0-9]{1,9})", text or "")
    return max(1, min(int(m[1]), most)) if m else 1


#: Most characters that a column of a table is wide.
WIDEST = 500


def set_table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table of cells ``(lines, columns, rows)``, each column as wide as its widest cell.

    Cells that reach over rows are kept as intervals, and only columns in which a cell
    begins take room, so spans cost nothing by their length.  A column is at most ``WIDEST``
    wide: a longer line of a cell pushes aside what follows in its own line, and all other
    lines stay aligned.  A line that would be blank but for a few characters, far more than
    50 blanks for each, as under thousands of cells that reach down to it, starts at the left.
    """
    grid: list[list[tuple[int, list[str], int]]] = []
    held: list[tuple[int, int, int]] = []  # first and end column, and the row that ends it
    for r, row in enumerate(rows):
        held = [h for h in held if h[2] > r]
        at, k, own = 0, 0, []
        for lines, across, down in row:
            while k < len(held) and held[k][0] <= at:
                at = max(at, held[k][1])
                k += 1
            own.append((at, lines, across))
            at += across
        held = sorted(held + [(c, c + across, r + down) for (c, _, across), (_, _, down) in zip(own, row, strict=True) if down > 1])
        grid.append(own)
    width: dict[int, int] = {}
    for own in grid:
        for c, lines, across in own:
            width[c] = max([width.get(c, 0), *((min(len(x), WIDEST) for x in lines) if across == 1 else ())])
    starts, room = sorted(width), [0]
    for c in starts:
        room.append(room[-1] + width[c] + 2)
    before = lambda c: room[bisect_left(starts, c)]
    out = []
    for own in grid:
        for k in range(max([len(lines) for _, lines, _ in own], default=0)):
            text, at = [], 0
            said = [lines[k] for _, lines, _ in own if k < len(lines) and lines[k]]
            if before(own[-1][0]) > 50 * sum(map(len, said)) + 4_000:
                out += ["  ".join(said)] if said else []
                continue
            for c, lines, across in own:
                text.append(" " * (before(c) - before(at)) + (lines[k] if k < len(lines) else "").ljust(max(0, before(c + across) - before(c) - 2)) + "  ")
                at = c + across
            if line := "".join(text).rstrip():
                out.append(line)
    return out


class Page:
    def __init__(self):
        self.root = Element("#root", Box())
        self.stack = [self.root]
        self.open: dict[str, int] = {}  # how many elements of a tag are open

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if "&" in text:
            text = unescape(text)
        if top.tag == "head" and text.strip():
            self.close_to(len(self.stack) - 1)
            top = self.stack[-1]
        if top.gone or top.hidden or (top.tag == "details" and top.number == -1):
            return
        if top.rows is not None or top.cells is not None or top.tag in GROUPS:
            if not text.strip():
                return
            top = next(e for e in reversed(self.stack) if e.rows is None and e.cells is None and e.tag not in GROUPS)  # stray text stands before its table
        top.box.say(text, top.pre)

    def close_to(self, size: int) -> None:
        while len(self.stack) > size:
            e = self.stack.pop()
            self.open[e.tag] -= 1
            self._close(e)

    def _find(self, wanted, stop) -> int:
        if not any(self.open.get(t) for t in wanted):
            return 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in wanted:
                return k
            if self.stack[k].tag in stop:
                return 0
        return 0

    def start(self, tag: str, attrs: str) -> None:
        if self.stack[-1].tag == "head" and tag not in HEAD:
            self.close_to(len(self.stack) - 1)
        if tag in ("html", "body") and self._find({tag}, ()):
            return
        if tag in ENDS_P and (k := self._find({"p"}, CELLS | {"table", "caption", "button", "object"})):
            self.close_to(k)
        if tag in IMPLIED:
            wanted, stop = IMPLIED[tag]
            while k := self._find(wanted, stop):
                self.close_to(k)
            if tag in CELLS and self.stack[-1].cells is None and (k := self._find({"table"}, ())):
                self.close_to(k + 1 if self.stack[-1].tag not in GROUPS else len(self.stack))
                self.start("tr", "")
        got = _attributes(attrs) if attrs.strip(" \t\n\r\f/") else {}
        if tag == "br":
            top = self.stack[-1]
            if not (top.gone or top.hidden):
                top.box.line(True)
            return
        top = self.stack[-1]
        style = _SPACE.sub("", got.get("style", "").lower())
        shown = re.search(r"(?:^|;)visibility:(\w+)", style)
        closed = top.tag == "details" and top.number == -1 and tag != "summary"
        gone = top.gone or tag in UNSEEN or "hidden" in got or closed or bool(re.search(r"(?:^|;)display:none", style)) or (tag == "dialog" and "open" not in got)
        hidden = shown[1] in ("hidden", "collapse") if shown else top.hidden
        foreign = [t for t in FOREIGN if self.open.get(t)]
        if foreign and not gone:
            gone = any(tag in FOREIGN[t] for t in foreign)
            if tag == "text":
                top.box.line()
        if foreign and attrs.endswith("/"):
            return
        if tag in VOID:
            if tag == "hr" and not gone:
                top.box.line()
            elif tag == "input" and not gone and not hidden and got.get("type", "text").lower() not in ("hidden", "password", "checkbox", "radio", "file", "range", "color", "image"):
                top.box.say(got.get("value", ""), top.pre)
            return
        new = Element(tag, top.box, gone, hidden, top.pre or tag in ("pre", "textarea", "xmp", "listing"))
        self.stack.append(new)
        self.open[tag] = self.open.get(tag, 0) + 1
        if gone:
            return
        if tag in SPACED and not (tag in ("ul", "ol") and self.open.get("li")):
            top.box.space()
        elif tag in BLOCK:
            top.box.line()
        if tag in ("ul", "ol", "menu", "dir"):
            new.number = _number(got["start"], 10**9) if tag == "ol" and "start" in got else 1 if tag == "ol" else 0
        elif tag == "details":
            new.number = 0 if "open" in got else -1
        elif tag == "table":
            new.rows = []
        elif tag == "tr":
            new.cells = []
        elif tag in CELLS:
            new.span = (_number(got.get("colspan"), 1000), _number(got.get("rowspan"), 65534))
        if tag in CELLS or tag in ("li", "dd", "blockquote", "caption", "table"):
            new.box = Box()

    def end(self, tag: str) -> None:
        if tag in ("body", "html"):
            return  # what follows still belongs to the body
        if tag in ("br", "p") and not self._find({tag}, CELLS | {"table"}):
            if tag == "br":
                self.start("br", "")
            return
        stop = () if tag in CELLS | GROUPS | {"table", "tr", "caption"} else CELLS | {"table", "caption"}
        if tag in CELLS | GROUPS | {"tr"}:
            stop = {"table"}
        if k := self._find({tag}, stop):
            self.close_to(k)

    def _close(self, e: Element) -> None:
        if e.gone:
            return
        above = self.stack[-1]
        if e.tag in CELLS:
            lines = e.box.end()
            if above.cells is not None:
                above.cells.append((lines, *e.span))
            else:
                above.box.put(lines)
        elif e.tag == "tr":
            table = next((x for x in reversed(self.stack) if x.rows is not None), None)
            if table is not None and e.cells:
                table.rows.append(e.cells)
            elif e.cells:
                above.box.put(set_table([e.cells]))
        elif e.tag == "table":
            own = e.box.end()
            above.box.put(own + set_table(e.rows))
            above.box.space()
        elif e.tag == "caption":
            above.box.put(e.box.end())
        elif e.tag == "li":
            lines = e.box.end()
            mark = "- "
            if above.number:
                mark = f"{above.number}. "
                above.number += 1
            if lines:
                above.box.put([mark + lines[0], *((" " * len(mark) + x) if x else "" for x in lines[1:])])
        elif e.tag in ("dd", "blockquote"):
            if e.tag == "blockquote":
                above.box.space()
            above.box.put([("    " + x) if x else "" for x in e.box.end()])
            if e.tag == "blockquote":
                above.box.space()
        elif e.tag in SPACED and not (e.tag in ("ul", "ol") and self.open.get("li")):
            above.box.space()
        elif e.tag in BLOCK:
            above.box.line()


def visible_text(html: str) -> str:
    """All text that the page shows."""
    page, at = Page(), 0
    while m := _TOKEN.match(html, at):
        if m["text"] == "<" and _BEGUN.match(html, at):  # a tag that never ends: what follows is text, read once
            page.text(html[at:])
            break
        at = m.end()
        if m["text"] is not None:
            page.text(m["text"])
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["end"]:
                page.end(tag)
                continue
            page.start(tag, m["attrs"])
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                inside = html[at : close.start() if close else len(html)]
                last = html.find(">", close.end()) if close else -1
                at = last + 1 if last >= 0 else len(html)
                if tag in ("textarea", "title") and page.stack[-1].tag == tag:
                    page.text(inside.removeprefix("\n"))
                page.end(tag)
    page.close_to(1)
    return "\n".join(page.root.box.end())


def _extract(batches, keep: int):
    for batch in batches:
        said = [None if t is None else visible_text(t) for t in batch.column(keep).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(said, pa.string())], names=[*batch.schema.names[:keep], "said"])


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of every row, and ``text``: what its page shows.

    A null page has a null text, an empty one an empty text.  Rows repeat as in the input;
    an empty table gives an empty one.  Names in ``keep`` may be ``text``.  Pages of any
    length are read whole; where a tag never ends, what follows it is text.
    """
    wide = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_col).cast("string").alias("html"))
    n = len(keep)
    kinds = "".join(f"k{i} {f.dataType.simpleString()}, " for i, f in enumerate(wide.schema.fields[:-1]))
    got = wide.mapInArrow(lambda it: _extract(it, n), kinds + "said string")
    return got.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("said").alias("text"))


def report(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col, text, n_chars, n_lines`` of every page."""
    got = extract(pages, [id_col], html_col)
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return got.select(id_col, "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text").isNotNull(), lines).alias("n_lines"))
