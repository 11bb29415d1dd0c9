"""HTML to text, laid out: every visible character, as blocks, lists and aligned tables.

A tokenizer and a tree builder that supplies implied tags (an open paragraph
ends before a block, an item before the next, a cell before the next cell or
row) make a tree; visibility rules prune it; a layout pass writes block
spacing, list markers with indents, preformatted text as it is, and tables
with cells padded to their columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetraflow.llm._shared import slices

#: Layout only, no text depends on them: tables nested deeper are laid out as blocks, indents grow no wider.
MAX_TABLES, MAX_INDENT = 150, 300
#: Spans reach no farther than this column. Blanks that indent a page's lines and align its cells: so many, and so many for each of its characters.
MAX_COLUMNS, PADDING, PADDING_EACH = 1000, 10_000, 4
GAP = "  "

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table ul xmp caption tr thead tbody tfoot td th".split()
)
_SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul xmp fieldset hr".split())
_ENDS_P = _BLOCKS - frozenset("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split()) | {"dd", "dt", "li"}
_HIDDEN = frozenset("head script style title template noscript iframe noembed noframes datalist object audio video canvas".split())
#: Of pictures and formulas, what a reader does not see; the names mean nothing elsewhere.
_UNSEEN = frozenset("annotation annotation-xml desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient".split())
#: Ordinary elements stand inside these; elsewhere in a picture or formula the tags of the second kind end it.
_HOLDS_HTML = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
_ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split()
)
_CLOSED = re.compile(r"(?:^|[\s\"']|(?:^|\s)[^\s=]+)/$")
_ROWS, _CELLS = frozenset("thead tbody tfoot".split()), frozenset("td th".split())
#: A start tag ends these open elements, unless one of the second kind stands between.
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table".split())),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset("td th caption".split()), frozenset("table tr".split())),
    "th": (frozenset("td th caption".split()), frozenset("table tr".split())),
    **{x: (_ROWS | frozenset("tr td th caption colgroup".split()), frozenset(["table"])) for x in _ROWS},
    "body": (frozenset(["head"]), frozenset()),
}
#: What a "<" begins: a tag's name, a comment, a declaration or an end without a name; anything else is text.
_OPENS = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*+)|!--|[!?]|/(?=[^A-Za-z]))", re.S)
#: The rest of a tag up to its ">", which a quoted value may hold.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+>""", re.S)
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_NEEDS_SQUEEZE = re.compile(r"[\t\n\r\f]|  ")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*+"|'[^']*+'|[^\s"'>]+))?""", re.S)
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children", "within")

    def __init__(self, tag: str, attributes: str = "", within: str = "") -> None:
        """within: svg or math for that element and what stands in it as part of the picture or formula."""
        self.tag, self.attributes, self.children, self.within = tag, attributes, [], within

    def get(self, name: str) -> str | None:
        """An attribute's value, "" if it has none, null if it isn't there."""
        if not self.attributes or name not in self.attributes.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape((m[2] or "").strip("\"'"))
        return None

    def visible(self) -> bool:
        if self.tag in _HIDDEN or self.within and self.tag in _UNSEEN or self.tag == "dialog" and self.get("open") is None:
            return False
        if not self.attributes:
            return True
        if self.get("hidden") is not None:
            return False
        style = self.get("style")
        return not (style and _INVISIBLE.search(style))


def build(html: str) -> Node:
    """The tree of a page, at any depth, in one pass forward.

    A tag that the page's end cuts off is dropped. Once a value's quote stays
    open to the end, quotes mean nothing from there on and tags end at the
    first ">"; so no part of a page is searched again and again.
    """
    root = Node("#root")
    stack, at, size = [root], 0, len(html)
    quotes = True
    places: dict[str, list[int]] = {}  # of the open elements, by tag

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def nearest(tags: frozenset) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def end_implied(ends: frozenset, scope: frozenset) -> None:
        while (i := nearest(ends)) and i >= nearest(scope):
            cut(i)

    def text(chunk: str) -> None:
        if stack[-1].tag == "head":
            if not chunk.strip():
                return
            cut(len(stack) - 1)
        stack[-1].children.append(unescape(chunk) if "&" in chunk else chunk)

    while at < size:
        found = _OPENS.search(html, at)
        if not found:
            text(html[at:])
            break
        if found.start() > at:
            text(html[at : found.start()])
        at, name = found.end(), found[2]
        if name is None:
            comment = found[0] == "<!--"
            close = html.find("-->", found.start() + 2) if comment else html.find(">", at)
            at = size if close < 0 else close + (3 if comment else 1)
            continue
        rest = _REST.match(html, at) if quotes else None
        if rest is None:
            close = html.find(">", at)
            if close < 0:
                break
            quotes = False
        close = rest.end() - 1 if rest else close
        attributes, at = html[at:close], close + 1
        name = name.lower()
        if found[1]:
            if name == "br":
                stack[-1].children.append(Node("br"))
                continue
            i = places[name][-1] if places.get(name) else 0
            if i and name not in ("body", "html") and (name in _CELLS or name in ("tr", "table") or name in _ROWS or i > nearest(_CELLS)):
                cut(i)
            continue
        if stack[-1].tag == "head" and name not in _IN_HEAD:
            cut(len(stack) - 1)
        within = "" if stack[-1].tag in _HOLDS_HTML else stack[-1].within
        if within and name in _ENDS_FOREIGN:
            while stack[-1].within and stack[-1].tag not in _HOLDS_HTML:
                cut(len(stack) - 1)
            within = ""
        within = name if name in ("svg", "math") else within
        if name in _IMPLIED:
            end_implied(*_IMPLIED[name])
        if name in _ENDS_P:
            end_implied(frozenset(["p"]), frozenset(["table", "td", "th", "caption", "button", "object", "li", "div"]) if name != "li" else frozenset(["table", "td", "th", "li"]))
        node = Node(name, attributes, within)
        stack[-1].children.append(node)
        if name in _VOID or within and _CLOSED.search(attributes):
            continue
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            body = html[at : close.start() if close else size]
            if name in ("textarea", "xmp"):
                node.children.append(unescape(body.removeprefix("\n")) if name == "textarea" else body)
            at = html.find(">", close.end()) + 1 if close else size
            at = at or size
            continue
        if name == "pre" and html.startswith("\n", at):
            at += 1
        push(node)
    return root


class Page:
    """Lines as they are laid out."""

    def __init__(self, padding: list[int], depth: int = 0) -> None:
        """padding: the blanks that are left for indents and aligned cells, one number that a page's parts share."""
        self.padding, self.depth = padding, depth  # depth: tables around it
        self.lines: list[str] = []
        self.open: list[str] = []
        self.gap = False
        self.marker = ""
        self.indent = ""

    def flush(self) -> None:
        if self.open:
            line = "".join(self.open).strip(" ")
            self.open.clear()
            if line:
                self.emit(line)

    def emit(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.padding[0] -= len(self.indent)
        indent = self.indent if self.padding[0] >= 0 else ""
        if self.marker:
            line = f"{indent[: -len(self.marker)]}{self.marker}{line}"
            self.marker = ""
        else:
            line = indent + line
        self.lines.append(line)

    def inline(self, text: str) -> None:
        if _NEEDS_SQUEEZE.search(text):
            text = _BLANKS.sub(" ", text)
        if text[:1] == " " and (not self.open or self.open[-1][-1:] == " "):
            text = text[1:]
        if text:
            self.open.append(text)

    def space(self) -> None:
        self.flush()
        self.gap = True


def _number(text: str | None, usual: int) -> int:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,6}", text.strip()) else usual


def _run(steps: Iterator) -> None:
    """A layout step and those it yields, each in full where it is yielded, without recursion."""
    todo = [steps]
    while todo:
        deeper = next(todo[-1], None)
        if deeper is None:
            todo.pop()
        else:
            todo.append(deeper)


def _lay(page: Page, node: Node, pre: bool = False) -> Iterator:
    for child in node.children:
        if isinstance(child, str):
            if pre:
                parts = child.replace("\r\n", "\n").split("\n")
                for i, part in enumerate(parts):
                    if i:
                        page.emit("".join(page.open)) if page.open else page.lines.append("")
                        page.open.clear()
                    if part:
                        page.open.append(part)
            else:
                page.inline(child)
            continue
        tag = child.tag
        if tag == "br":
            if page.open:
                page.flush()
            continue
        if tag == "wbr" or tag in _VOID and tag != "hr" or not child.visible():
            continue
        if tag not in _BLOCKS:
            apart = child.within == "svg" and tag in ("text", "svg")  # labels of a picture stand apart
            if tag == "textarea" or apart:
                page.inline(" ")
            yield _lay(page, child, pre or tag == "textarea")
            if apart:
                page.inline(" ")
            continue
        spaced = tag in _SPACED and not (tag in ("ul", "ol") and page.indent)
        page.space() if spaced else page.flush()
        if tag == "table":
            yield _table(page, child)
        elif tag in ("pre", "xmp"):
            yield _lay(page, child, True)
            if page.open:
                page.emit("".join(page.open))
                page.open.clear()
        elif tag in ("ul", "ol", "menu", "dir"):
            yield _list(page, child, pre)
        elif tag == "li":
            yield _item(page, child, "- ", pre)
        elif tag in ("blockquote", "dd"):
            kept, page.indent = page.indent, (page.indent + "  ")[:MAX_INDENT]
            yield _lay(page, child, pre)
            page.flush()
            page.indent = kept
        else:
            yield _lay(page, child, pre)
        page.space() if spaced else page.flush()


def _list(page: Page, node: Node, pre: bool) -> Iterator:
    number, step = _number(node.get("start"), 1), -1 if node.get("reversed") is not None else 1
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            if child.visible():
                number = _number(child.get("value"), number)
                yield _item(page, child, f"{number}. " if node.tag == "ol" else "- ", pre)
                number += step
        else:
            holder = Node("#part")
            holder.children.append(child)
            yield _lay(page, holder, pre)
    page.flush()


def _item(page: Page, node: Node, marker: str, pre: bool) -> Iterator:
    page.flush()
    kept, page.indent, page.marker = page.indent, (page.indent + " " * len(marker))[:MAX_INDENT], marker
    yield _lay(page, node, pre)
    page.flush()
    page.indent, page.marker = kept, ""


def _rows(table: Node) -> Iterator[Node | str]:
    """Rows in order; anything else that stands in the table comes as it is."""
    loose: Node | None = None
    for child in table.children:
        if isinstance(child, Node) and child.tag in _CELLS:
            if loose is None:
                loose = Node("tr")
            loose.children.append(child)
            continue
        if loose is not None:
            yield loose
            loose = None
        if isinstance(child, Node) and child.tag in _ROWS:
            if child.visible():
                yield from _rows(child)
        elif isinstance(child, Node) or child.strip():
            yield child
    if loose is not None:
        yield loose


def _table(page: Page, table: Node) -> Iterator:
    if page.depth >= MAX_TABLES:
        yield _lay(page, table)
        return
    grid: list[list[tuple[list[str], int]]] = []
    down: dict[int, int] = {}
    for row in _rows(table):
        if not isinstance(row, Node) or row.tag != "tr":
            if isinstance(row, str) or row.visible():
                holder = Node("#part")
                holder.children.append(row)
                yield _lay(page, holder)
                page.flush()
            continue
        if not row.visible():
            continue
        cells, column = [], 0
        for cell in row.children:
            if isinstance(cell, str) and not cell.strip() or isinstance(cell, Node) and not cell.visible():
                continue
            while down.get(column, 0):
                down[column] -= 1
                cells.append(([], 1))
                column += 1
            inner = Page(page.padding, page.depth + 1)
            holder = Node("#part")
            holder.children = cell.children if isinstance(cell, Node) and cell.tag in _CELLS else [cell]
            yield _lay(inner, holder)
            inner.flush()
            known = isinstance(cell, Node)
            span = max(1, min(MAX_COLUMNS - column, _number(cell.get("colspan"), 1))) if known else 1
            rows = max(1, min(65534, _number(cell.get("rowspan"), 1))) if known else 1
            cells.append((inner.lines, span))
            if rows > 1 and column + span <= MAX_COLUMNS and page.padding[0] > 0:
                for i in range(span):
                    down[column + i] = rows - 1
            column += span
        for later in [x for x in down if x >= column and down[x]]:
            down[later] -= 1
        page.padding[0] -= len(down)  # cells kept free below others are blanks too
        if page.padding[0] < 0:
            down.clear()
        grid.append(cells)
    _emit_grid(page, grid)


def _emit_grid(page: Page, grid: list[list[tuple[list[str], int]]]) -> None:
    """Rows with cells padded to their columns; without padding, each cell below the one before, once the page has no blanks left for it."""
    widths: dict[int, int] = {}
    for cells in grid:
        at = 0
        for lines, span in cells:
            if span == 1:
                widths[at] = max(widths.get(at, 0), *map(len, lines), 0)
            at += span
    upto = [0]  # the sum of the widths before each column
    for i in range(max((sum(span for _, span in cells) for cells in grid), default=0)):
        upto.append(upto[-1] + widths.get(i, 0))
    for cells in grid:
        padded, at, last = [], 0, 0
        for lines, span in cells:
            padded.append((lines, upto[at + span] - upto[at] + len(GAP) * (span - 1)))
            at += span
            last = len(padded) if lines else last
        del padded[last:]
        height = max((len(lines) for lines, _ in padded), default=0)
        blanks = height * sum(width + len(GAP) for _, width in padded) - sum(len(x) for lines, _ in padded for x in lines)
        if blanks > page.padding[0]:
            if height > 1:
                for lines, _ in padded:
                    for line in lines:
                        page.emit(line)
            else:
                page.emit(GAP.join(lines[0] for lines, _ in padded if lines))
            continue
        page.padding[0] -= max(0, blanks)
        for k in range(height):
            line = GAP.join([(lines[k] if k < len(lines) else "").ljust(width) for lines, width in padded]).rstrip(" ")
            if line:
                page.emit(line)


def render(html: str | None) -> str:
    """The visible text of a page; empty for null and empty ones."""
    if not html:
        return ""
    page = Page([PADDING + PADDING_EACH * len(html)])
    _run(_lay(page, build(html)))
    page.flush()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return "\n".join(page.lines)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars, n_lines) per row of ``pages``.

    Needs page_id and html; other columns are ignored. Null and empty pages
    give an empty text; plain text is laid out as one block; unclosed elements
    and comments end with the page, and a tag that its end cuts off is dropped.
    Time and output are linear in the page: cells are aligned as long as the
    page has blanks for it (PADDING), then written one below the other. Repeated rows and null ids pass; whole pages
    are read, at any depth of nesting. Formulas and the labels of pictures are
    text. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = [render(x) for x in batch.column(1).to_pylist()]
            counts = [pa.array([len(x) for x in texts], pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *counts], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
