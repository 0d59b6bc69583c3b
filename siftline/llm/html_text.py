"""HTML extraction by layout-aware rendering.

A small tree builder closes what HTML lets authors leave open, visibility rules leave out what a reader would not
see, and the tree is laid out as text: blocks on lines of their own with the blank lines that their margins make,
list items with markers and indents, table cells in aligned columns.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.staging import byte_batches, fresh

# HTML's own vocabulary; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript".split())
UNSEEN = frozenset(
    "head script style template noscript iframe noembed noframes title meta link base audio video canvas object datalist map area param source track "  # the rest is what SVG and MathML hold unseen
    "metadata desc defs symbol clippath mask annotation annotation-xml".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table caption tr ul xmp".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir xmp".split())
CLOSES_P = BLOCK - frozenset("html body dt dd li caption tr legend option optgroup summary".split()) | {"summary"}
LISTS = frozenset("ul ol menu dir".split())
#: An opening tag closes the nearest of the first set, unless one of the second is nearer.
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"body"}), "h1": ({"h1", "h2", "h3", "h4", "h5", "h6"}, BLOCK - {"h1", "h2", "h3", "h4", "h5", "h6"}),
}
IMPLIED |= {f"h{n}": IMPLIED["h1"] for n in range(2, 7)}
#: Closing tags don't reach through these.
SCOPE = frozenset("table td th caption html template button".split())
IN_HEAD = frozenset("base link meta script style title noscript template head html".split())

_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_HIDDEN = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(visible|hidden|collapse)", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    """``shown``: what the element's own visibility says, None where it says nothing and the parent's holds. ``start``, ``value``
    and ``back`` number lists; ``span`` and ``down`` say how many columns and rows a cell takes."""

    __slots__ = ("back", "children", "down", "hidden", "name", "open", "shown", "span", "start", "value")

    def __init__(self, name: str):
        self.name, self.children, self.hidden, self.open, self.shown, self.span, self.down = name, [], False, False, None, 1, 1
        self.start, self.value, self.back = None, None, False


def _number(value: str | None, default: int | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?\d{1,6}", value.strip()) else default


def _described(node: Node, source: str) -> None:
    """What a tag's attributes say about visibility, list numbers and spans."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(source)))}
    node.hidden = "hidden" in found or bool(_HIDDEN.search(found.get("style", ""))) or (node.name == "input" and found.get("type", "").lower() == "hidden")
    seen = _VISIBILITY.findall(found.get("style", ""))
    node.shown = seen[-1].lower() == "visible" if seen else None
    node.open = "open" in found
    node.start, node.value, node.back = _number(found.get("start"), None), _number(found.get("value"), None), "reversed" in found
    node.span = max(1, min(100, _number(found.get("colspan"), 1)))
    node.down = _number(found.get("rowspan"), 1)
    if node.name == "img" and found.get("alt"):
        node.children.append(found["alt"])
    if node.name == "input" and found.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number") and found.get("value"):
        node.children.append(found["value"])


class _Builder:
    """Open elements, and for each name where in the stack it is open, so that no tag has to walk the stack."""

    def __init__(self):
        self.root = Node("html")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}

    def is_open(self, name: str) -> bool:
        return bool(self.places.get(name))

    def _nearest(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> None:
        self.places[self.stack.pop().name].pop()

    def close(self, names, barrier=frozenset()) -> None:
        """Close the nearest open element of ``names``, with all inside it, unless the barrier is nearer."""
        at = self._nearest(names)
        if at and at >= self._nearest(barrier):
            while len(self.stack) > at:
                self.pop()

    def leave_head(self) -> None:
        if self.stack[-1].name == "head":
            self.pop()

    def open(self, name: str, source: str) -> None:
        if name in ("html", "body") and self.is_open(name):
            return
        if name not in IN_HEAD:
            self.leave_head()
        if name in CLOSES_P:
            self.close({"p"}, SCOPE)
        if name in IMPLIED:
            self.close(*IMPLIED[name])
        if name in ("td", "th") and self.stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            self.open("tr", "")
        node = Node(name)
        if source:
            _described(node, source)
        self.stack[-1].children.append(node)
        if name not in VOID:
            self.push(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.open("br", "")
        elif name == "p" and not self.is_open("p"):
            self.open("p", "")
            self.pop()
        elif name not in ("html", "body") and name not in VOID:
            self.close({name}, SCOPE - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {name})

    def text(self, data: str) -> None:
        if data:
            if self.stack[-1].name == "head":
                if not data.strip():
                    return
                self.leave_head()
            self.stack[-1].children.append(data)


class _Source:
    """A page read from left to right. What isn't found once isn't looked for again, so reading takes linear time."""

    def __init__(self, text: str):
        self.text, self.absent = text, set()

    def find(self, what: str, at: int) -> int:
        """Where ``what`` stands next, or the text's length."""
        if what in self.absent:
            return len(self.text)
        found = self.text.find(what, at)
        if found < 0:
            self.absent.add(what)
            return len(self.text)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag begun before ``at``, quoted ones not counting; a quote that never ends is none."""
        n = len(self.text)
        while True:
            at = _PLAIN.match(self.text, at).end()
            if at >= n or self.text[at] == ">":
                return at
            end = self.find(self.text[at], at + 1)
            at = end + 1 if end < n else at + 1


def tree(source: str) -> Node:
    """The document's tree; end tags without a start and unknown tags do no harm. A tag that the text's end cuts off is left out."""
    build, page, at, n = _Builder(), _Source(source), 0, len(source)
    while at < n:
        begin = page.find("<", at)
        follow = source[begin + 1 : begin + 2]
        if follow not in ("!", "?", "/") and not (follow.isascii() and follow.isalpha()):  # a sign of its own
            build.text(html.unescape(source[at : begin + 1]))
            at = begin + 1
            continue
        build.text(html.unescape(source[at:begin]))
        if source.startswith("<!--", begin):
            at = page.find("-->", begin + 4) + 3
            continue
        tag = _TAG_NAME.match(source, begin)
        if tag is None:  # a declaration, an instruction, or an end tag without a name
            at = page.find(">", begin) + 1
            continue
        end = page.tag_end(tag.end())
        if end >= n:
            break
        name, at = tag[1].lower(), end + 1
        if follow == "/":
            build.end(name)
            continue
        build.open(name, source[tag.end() : end].strip())
        if name in RAW:
            last = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
            body = source[at : last.start() if last else n]
            build.text(html.unescape(body) if name in ("textarea", "title") else body)
            build.close({name})
            at = page.find(">", last.end()) + 1 if last else n
    return build.root


class _Page:
    """Lines of text under way. ``gap``: line ends owed before the next text (2: a blank line)."""

    def __init__(self):
        self.lines, self.now, self.gap, self.blank, self.indent, self.marker, self.kept = [], [], 0, False, 0, "", 0

    def word(self, data: str) -> None:
        if self.kept:
            for i, line in enumerate(data.split("\n")):
                if i:
                    self.line()
                if line:
                    self.put(line)
            return
        parts = _BLANK.split(data)
        if len(parts) > 1 and not parts[0]:
            self.blank = True
        body = " ".join(p for p in parts if p)
        if body:
            self.put((" " if self.blank and self.now else "") + body)
            self.blank = False
        if len(parts) > 1 and not parts[-1]:
            self.blank = True

    def put(self, data: str) -> None:
        if self.gap:
            if self.lines or self.now:
                self.flush()
                if self.gap > 1 and self.lines and self.lines[-1]:
                    self.lines.append("")
            self.gap, data = 0, data if self.kept else data.lstrip(" ")
        if not self.now:
            self.now.append(" " * max(0, self.indent - len(self.marker)) + self.marker)
            self.marker = ""
        self.now.append(data)

    def flush(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.blank = False

    def line(self) -> None:
        """A line end that stands in the text itself."""
        if self.gap:
            self.gap = max(self.gap, 1)
            return
        if self.now:
            self.flush()
        elif self.lines:
            self.lines.append("")

    def block(self, gap: int) -> None:
        self.gap, self.blank = max(self.gap, gap), False

    def text(self) -> str:
        self.flush()
        return "\n".join(self.lines).strip("\n")


def _table_rows(table: Node) -> tuple[list[Node], list[list[Node]]]:
    captions, rows, todo = [], [], [table]
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node.hidden:
            continue
        if node.name == "caption":
            captions.append(node)
        elif node.name == "tr":
            rows.append([c for c in node.children if isinstance(c, Node) and c.name in ("td", "th") and not c.hidden])
        elif node.name in ("table", "tbody", "thead", "tfoot"):
            todo += reversed(node.children)
    return captions, rows


def _strays(table: Node) -> list:
    """What stands in a table outside its cells; it is shown before the table."""
    out, todo = [], [table]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if node.strip():
                out.append(node)
        elif node.name in ("table", "tbody", "thead", "tfoot", "tr") and not node.hidden:
            todo += reversed(node.children)
        elif node.name not in ("td", "th", "caption", "colgroup", "col") and not node.hidden:
            out.append(node)
    return out


def _on_grid(rows: list[list[Node]]) -> list[list[Node]]:
    """``rows`` with an empty cell for each column that a cell above still takes, before the cells that stand after it.

    Where that would be far more cells than the table has, rows stay as they are.
    """
    left, most = {}, PADDING + PADDING_PER_CHARACTER * sum(map(len, rows))
    out = []
    for row in rows:
        taken, c, laid = dict(left), 0, []
        for cell in row:
            while taken.get(c, 0) > 0:
                laid.append(Node("td"))
                c += 1
            laid.append(cell)
            if cell.down != 1:
                left |= {c + i: cell.down if cell.down > 1 else len(rows) for i in range(cell.span)}
            c += cell.span
        most -= len(laid)
        if most < 0:
            return rows
        out.append(laid)
        left = {i: n - 1 for i, n in left.items() if n > 1}
        most -= len(left)
    return out


#: Blanks that aligning a table's columns may add: so many, and so many for each character of its cells.
PADDING, PADDING_PER_CHARACTER = 400, 4


def _widths(rows: list[list[tuple[list[str], int]]]) -> dict[int, int]:
    """Each column's width: that of its widest one-column cell."""
    width: dict[int, int] = {}
    for row in rows:
        c = 0
        for lines, span in row:
            if span == 1:
                width[c] = max([width.get(c, 0), *map(len, lines)])
            c += span
    return width


def _rooms(row: list[tuple[list[str], int]], width: dict[int, int]) -> list[int]:
    out, c = [], 0
    for _, span in row:
        out.append(sum(width.get(i, 0) for i in range(c, c + span)) + 3 * (span - 1))
        c += span
    return out


def _aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Cells' lines side by side in columns of one width.

    Where that would take far more blanks than the cells have characters (one long or tall cell among many short
    ones), each row's cells follow one another as lines of their own instead; no text is lost either way.
    """
    width = _widths(rows)
    characters = sum(len(line) - line.count(" ") for row in rows for lines, _ in row for line in lines)
    blanks = 0
    for row in rows:
        tall = max([len(lines) for lines, _ in row], default=0)
        blanks += sum(room * tall - sum(map(len, lines)) for (lines, _), room in zip(row, _rooms(row, width), strict=True)) + 3 * tall * (len(row) - 1)
        if blanks > PADDING + PADDING_PER_CHARACTER * characters:
            return [line for row in rows for lines, _ in row for line in lines if line]
    out = []
    for row in rows:
        rooms = _rooms(row, width)
        for k in range(max([len(lines) for lines, _ in row], default=0)):
            out.append(" | ".join((lines[k] if k < len(lines) else "").ljust(room) for (lines, _), room in zip(row, rooms, strict=True)).rstrip())
    return out


_MOST_NESTED_TABLES = 20


def render(node: Node, nested: int = 0, shown: bool = True) -> str:
    """The visible text below ``node``. Tables nested deeper than twenty times are laid out like plain blocks."""
    page = _Page()
    lists: list[list] = []
    seen = [shown]
    todo: list = [("see", node)]
    while todo:
        what, x = todo.pop()
        if what == "do":
            x()
            continue
        if isinstance(x, str):
            if seen[-1]:
                page.word(x)
            continue
        name = x.name
        if x.hidden or name in UNSEEN or (name == "dialog" and not x.open):
            continue
        after = []
        if x.shown is not None and x.shown != seen[-1]:
            seen.append(x.shown)
            after.append(seen.pop)
        if name == "br":
            if x.shown is not None and after:
                seen.pop()
            page.line()
            continue
        gap = 2 if name in SPACED and not (name in LISTS and lists) else 1 if name in BLOCK else 0
        if gap:
            page.block(gap)
            after.append(lambda g=gap: page.block(g))
        children = x.children
        if name == "hr" and seen[-1]:
            page.put("----")
        elif name in ("pre", "xmp", "textarea"):
            page.kept += 1
            after.append(lambda: setattr(page, "kept", page.kept - 1))
            if children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
        elif name in LISTS:
            items = sum(isinstance(c, Node) and c.name == "li" for c in children)
            lists.append([name == "ol", x.start if x.start is not None else items if x.back else 1, -1 if x.back else 1])
            after.append(lists.pop)
        elif name == "li":
            kind = lists[-1] if lists else [False, 1, 1]
            kind[1] = x.value if x.value is not None else kind[1]
            page.marker = f"{kind[1]}. " if kind[0] else "- "
            kind[1] += kind[2]
            deeper = max(2, len(page.marker))
            page.indent += deeper
            after.append(lambda d=deeper: (setattr(page, "indent", page.indent - d), setattr(page, "marker", "")))
        elif name in ("dd", "blockquote"):
            page.indent += 2
            after.append(lambda: setattr(page, "indent", page.indent - 2))
        elif name == "details" and not x.open:
            children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
        elif name in ("td", "th"):
            page.block(1)
        elif name == "q" and seen[-1]:
            page.word('"')
            after.append(lambda: page.word('"'))
        elif name == "table" and nested < _MOST_NESTED_TABLES:
            captions, rows = _table_rows(x)
            inherited = seen[-1]
            cells = [[(render_children(c, nested + 1, inherited if c.shown is None else c.shown).split("\n"), c.span) for c in row] for row in _on_grid(rows)]
            lines = _aligned(cells)

            def show(lines=lines):
                for i, line in enumerate(lines):
                    if i:
                        page.block(1)
                    page.kept += 1
                    if line:
                        page.put(line)
                    page.kept -= 1

            children = [*_strays(x), *captions]
            after.append(show)
            after.append(lambda: page.block(1))
        todo += [("do", f) for f in after]
        todo += [("see", c) for c in reversed(children)]
    return page.text()


def render_children(cell: Node, nested: int, shown: bool) -> str:
    inner = Node("div")
    inner.children = cell.children
    return render(inner, nested, shown)


def visible_text(source: str | None) -> str:
    return render(tree(source)) if source else ""


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages``' columns but ``column``, and ``text``, what a reader of the page would see.

    Null and empty pages give empty text; broken markup is read as far as it goes, and text without tags is text.
    Very long pages are read whole, in linear time; a table whose columns can't be aligned without far more blanks
    than text has its cells on lines of their own. Repeated rows each come back; a column ``text`` that pages have
    already is replaced, all others are carried. An empty table gives an empty table.
    """
    source = fresh("html", pages)
    kept = [c for c in pages.columns if c.lower() not in (column.lower(), "text")]

    def run(batches):
        for batch in batches:
            for part in byte_batches(batch, source):
                text = [visible_text(x) for x in part.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(text, pa.string())], names=[*kept, "text"])

    table = pages.select(*(pages[c] for c in kept), pages[column].cast("string").alias(source))
    return table.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != source) + ", text string")
