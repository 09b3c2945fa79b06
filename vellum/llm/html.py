"""Operator 10: layout-aware HTML to text.

A tokenizer feeds a tree builder that supplies implied end tags, ignores stray ones and knows void and raw-text
elements. What isn't visible is taken out (scripts, styles, comments, templates, `hidden`, closed <details> and <dialog>,
`display:none` and `visibility:hidden` in attributes or in the page's style sheets, as far as their selectors name single
elements by tag, classes and id; what is made visible again inside stays). Rendering collapses white space except in
<pre>, puts one line break around blocks and a blank line around paragraphs, headings, lists and tables, marks and
indents list items, and aligns table cells in columns. Text inside <svg> and <math> is kept, less definitions, metadata
and annotations; each label has a line of its own. All visible text is kept.

Tokenizer, builder and renderer take time in proportion to the page, malformed or not, and use no recursion, so nesting may
be of any depth; layout follows it to a limit only (LEVELS of indents, TABLES within tables, WIDEST cell), text beyond it stays.
A `<` that begins no tag that ends is text. Null or empty pages give empty text, a very long page is one slice. Repeated rows
and null ids are rendered row by row. An empty table gives no rows. Only id and `text` come out (an id column named
`text` comes out as `id`).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_name, quoted, slices

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link area param source track select".split()) - {"select"}
#: Inside <svg> and <math>: what isn't drawn, what has a line of its own, and whose parts don't touch.
UNDRAWN = frozenset("defs metadata desc symbol clippath mask marker pattern annotation annotation-xml".split())
LABELS = frozenset("text foreignobject mtr mlabeledtr".split())
PARTED = frozenset("mfrac msub msup msubsup munder mover munderover mroot mtr mlabeledtr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An opening tag -> the open elements that it ends, and the elements at which looking for them stops.
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
IN_HEAD = frozenset("base link meta script style title template noscript head".split())
#: An end tag for these is looked for only as far as the next enclosing cell or table.
FENCES = frozenset({"td", "th", "table", "caption"})

#: What follows "<": a comment, a declaration or instruction, or a tag's name.
_opening = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_comment_end = re.compile(r"--!?>")
_run = re.compile(r"[^=>]*(?:(>)|=\s*([\"'])?|\Z)")
_attr = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_block_comment = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_compound = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_marks = re.compile(r"[.#][\w-]+").findall
_shown = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)", re.I)
_space = re.compile(r"[ \t\n\r\f]+")
#: Lists and quotations within more levels than this aren't indented further, tables within more tables are plain rows.
LEVELS, TABLES = 40, 12
#: A longer cell doesn't widen its column.
WIDEST = 120


class Node:
    __slots__ = ("attrs", "children", "foreign", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: bool = False):
        self.tag, self.attrs, self.children, self.foreign = tag, attrs, [], foreign


def _attrs(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_attr.finditer(source)))}


class Source:
    """A page's markup. Finding the ends of all tags takes time in proportion to its length."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.quotes = True

    def tag_end(self, at: int) -> int:
        """Where the tag's `>` is, from `at`, a place behind its name; -1 if there is none. A `>` in a quoted value is no end."""
        if at > self.last[">"]:
            return -1
        start = at
        while self.quotes:
            m = _run.match(self.page, at)
            at = m.end()
            if m[1]:
                return at - 1
            if m[2] and at <= self.last[m[2]]:
                at = self.page.find(m[2], at) + 1
            elif at == len(self.page):
                self.quotes = False  # a value without an end runs to the page's end: once is enough
        return self.page.find(">", start)


class Stack:
    """The open elements, and for each tag where it is open."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """Where the innermost of these is open; 0 if none is."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def close(self, tags: frozenset[str], stops: frozenset[str]) -> None:
        """Ends these elements as far as the innermost stop; with a cell goes its row, if it is named too."""
        while (place := self.last(tags)) > self.last(stops):
            self.cut(place)


#: What an end tag can't reach through: cells and tables; for parts of tables, tables only.
_parts_of_tables = frozenset({"table", "tr", "tbody", "thead", "tfoot", "td", "th"})


def parse(page: str) -> Node:
    root = Node("html", {})
    stack, source = Stack(root), Source(page)
    at, look, low, body = 0, 0, None, False

    def text(data: str) -> None:
        if data:
            if stack.top.tag == "head" and not data.isspace():
                stack.cut(len(stack.nodes) - 1)
            stack.top.children.append(unescape(data) if "&" in data else data)

    while m := _opening.search(page, look):
        begin = m.start()
        if m[1]:
            end = _comment_end.search(page, m.end())
            text(page[at:begin])
            at = look = end.end() if end else len(page)
            continue
        if m[2]:
            end = page.find(">", m.end())
            text(page[at:begin])
            at = look = end + 1 if end >= 0 else len(page)
            continue
        end = source.tag_end(m.end())
        if end < 0:  # no tag ends any more: what is left is text
            break
        text(page[at:begin])
        at = look = end + 1
        tag, own = m[4].lower(), page[m.end() : end]
        if m[3]:
            if tag == "br":
                stack.top.children.append(Node("br", {}))
            elif tag == "p" and not stack.places["p"]:
                stack.top.children.append(Node("p", {}))
            elif tag not in ("html", "body"):
                place = stack.last((tag,))
                if place and place >= stack.last(("table",) if tag in _parts_of_tables else FENCES):
                    stack.cut(place)
            continue
        if tag == "html":
            root.attrs = _attrs(own) | root.attrs
            continue
        if tag == "body" and body:
            continue
        body = body or tag == "body"
        if stack.top.tag == "head" and tag not in IN_HEAD:
            stack.cut(len(stack.nodes) - 1)
        if tag in IMPLIED:
            stack.close(*IMPLIED[tag])
        if tag in ENDS_P:
            stack.close(_p, _p_stops)
        if tag in ("td", "th") and stack.top.tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            stack.top.children.append(row)
            stack.push(row)
        node = Node(tag, _attrs(own), tag in ("svg", "math") or stack.top.foreign and stack.top.tag != "foreignobject")
        stack.top.children.append(node)
        if tag in VOID or node.foreign and own.endswith("/"):
            continue
        if tag in RAW:
            if low is None:
                low = page.lower()
                low = low if len(low) == len(page) else page
            end = low.find(f"</{tag}", at) if tag != "plaintext" else -1
            end = len(page) if end < 0 else end
            data = page[at:end]
            if data:
                node.children.append(unescape(data) if tag in ("textarea", "title") else data)
            close = page.find(">", end)
            at = look = len(page) if close < 0 else close + 1
            continue
        stack.push(node)
    text(page[at:])
    return root


_p, _p_stops = frozenset({"p"}), FENCES | {"button"}


class Sheet:
    """Rules of a page's style sheets that show or hide: selectors are lists of single elements (tag, classes, id)."""

    def __init__(self, sheets: list[str]):
        rules: dict[tuple, dict[str, str]] = {}
        for sheet in sheets:
            depth = 0
            for part in _block_comment.sub(" ", sheet).split("}"):
                pieces = part.split("{")
                depth += len(pieces) - 1
                if depth == 1 and len(pieces) > 1 and (said := {k.lower(): v.lower() for k, v in _shown.findall(pieces[-1])}):
                    for selector in pieces[-2].split(","):
                        if selector.strip() and (c := _compound.fullmatch(selector.strip())):
                            key = ((c[1] or "*").lower(), frozenset(_marks(c[2])))
                            rules[key] = rules.pop(key, {}) | said  # at the end: the latest
                depth = max(0, depth - 1)
        self.by_key: dict[str, list[tuple]] = {}
        self.known: dict[tuple, dict[str, str]] = {}
        for number, ((tag, marks), said) in enumerate(rules.items()):
            weight = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), tag != "*", number)
            self.by_key.setdefault(min(marks, default=tag), []).append((weight, tag, marks, said))

    def ruled(self, tag: str, classes: str, name: str) -> dict[str, str]:
        key = (tag, classes, name)
        if key not in self.known:
            marks = {f".{c}" for c in classes.split()} | ({f"#{name}"} if name else set())
            found = [r for k in ("*", tag, *marks) for r in self.by_key.get(k, ()) if r[1] in ("*", tag) and r[2] <= marks]
            out: dict[str, str] = {}
            for _, _, _, said in sorted(found, key=lambda r: r[0]):
                out |= said
            self.known[key] = out
        return self.known[key]

    def said(self, node: Node) -> dict[str, str]:
        """display and visibility of an element, as far as anything states them."""
        out = self.ruled(node.tag, node.attrs.get("class", ""), node.attrs.get("id", "").strip()) if self.by_key else {}
        if "style" in node.attrs:
            out = out | {k.lower(): v.lower() for k, v in _shown.findall(node.attrs["style"])}
        return out


def _sheets(root: Node) -> list[str]:
    todo, out = [root], []
    while todo:
        node = todo.pop()
        if node.tag == "style":
            out += [c for c in node.children if isinstance(c, str)]
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def prune(root: Node) -> None:
    """Takes out of the tree what isn't visible: it isn't displayed, or it is hidden and nothing in it is made visible again."""
    sheet = Sheet(_sheets(root))
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, veiled, done = todo.pop()
        if done:
            node.children = [c for c in node.children if isinstance(c, str) or c.tag]
            if veiled and not node.children and node.tag not in ("td", "th"):
                node.tag = ""
            continue
        kept: list[Node | str] = []
        inner: list[tuple[Node, bool, bool]] = []
        closed = node.tag == "details" and "open" not in node.attrs
        summary = False
        for c in node.children:
            if isinstance(c, str):
                if not veiled and not closed:
                    kept.append(c)
                continue
            a = c.attrs
            if c.tag in UNSEEN or c.tag == "input" and a.get("type", "").lower() == "hidden" or c.tag == "dialog" and "open" not in a:
                continue
            if c.foreign and (c.tag in UNDRAWN or a.get("display", "").strip() == "none"):
                continue
            if closed and (c.tag != "summary" or summary):
                continue
            summary = summary or c.tag == "summary"
            said = sheet.said(c) if a or sheet.by_key else {}
            shown = said.get("display", "none" if "hidden" in a else "")
            if shown == "none":
                continue
            seen = said.get("visibility") or (a.get("visibility", "").strip() if c.foreign else "")
            hides = seen in ("hidden", "collapse") or veiled and seen != "visible"
            if hides and c.tag in VOID:
                continue
            kept.append(c)
            inner.append((c, hides, False))
        node.children = kept
        todo.append((node, veiled, True))
        todo += inner


class Out:
    """Text with pending white space: inline spaces collapse, block borders become one or two line breaks."""

    def __init__(self):
        self.parts: list[str] = []
        self.space = False
        self.breaks = 0
        self.indent = ""
        self.mark: str | None = None

    def border(self, lines: int) -> None:
        self.space = False
        if self.mark is None:
            self.breaks = max(self.breaks, lines)

    def _start(self) -> None:
        if self.parts and self.breaks:
            self.parts.append("\n" * self.breaks)
        if self.breaks or not self.parts:
            lead = self.indent if self.mark is None else self.indent[: -len(self.mark)] + self.mark
            if lead:
                self.parts.append(lead)
            self.mark = None
        self.breaks, self.space = 0, False

    def words(self, data: str) -> None:
        clean = _space.sub(" ", data)
        if clean == " ":
            self.space = True
            return
        if not clean:
            return
        spaced = clean[0] == " " or self.space
        fresh = self.breaks or not self.parts
        self._start()
        if spaced and not fresh:
            self.parts.append(" ")
        self.parts.append(clean.strip(" "))
        self.space = clean[-1] == " "

    def lines(self, data: str) -> None:
        """Text whose lines stay as they are."""
        for k, line in enumerate(data.split("\n")):
            if k:
                self.parts.append("\n")
                self.parts.append(self.indent if line else "")
            elif line:
                self._start()
            if line:
                self.parts.append(line)

    def text(self) -> str:
        return "\n".join(line.rstrip() for line in "".join(self.parts).split("\n")).strip("\n")


def _grid(rows: list[list[tuple[str, int]]]) -> str:
    """Cells (text, span) in aligned columns; a cell of several lines takes several lines."""
    widths: dict[int, int] = {}
    for row in rows:
        col = 0
        for cell, span in row:
            if span == 1:
                widths[col] = max(widths.get(col, 0), *(min(len(x), WIDEST) for x in cell.split("\n")))
            col += span
    out = []
    for row in rows:
        cells = [cell.split("\n") for cell, _ in row]
        for k in range(max(map(len, cells), default=0)):
            line, col = [], 0
            for lines, (_, span) in zip(cells, row, strict=True):
                held = [widths[col + i] for i in range(span) if col + i in widths]
                width = sum(held) + 3 * (len(held) - 1)
                line.append((lines[k] if k < len(lines) else "").ljust(width))
                col += span
            out.append(" | ".join(line).rstrip())
    return "\n".join(out)


def render(root: Node) -> str:
    """A stack of steps stands for the recursion; a table's cells are rendered into outputs of their own."""
    out = Out()
    steps: list[tuple] = [("open", root)]
    lists: list[list] = []
    pre = inside = 0
    while steps:
        kind, *rest = steps.pop()
        if kind == "open":
            node = rest[0]
            if isinstance(node, str):
                if pre:
                    out.lines(node)
                else:
                    out.words(node)
                continue
            tag = node.tag
            if tag == "br":
                out.space = False
                if out.parts and not out.breaks:
                    out.breaks = 1
                elif out.breaks:
                    out.breaks = min(2, out.breaks + 1)
                continue
            if tag == "img":
                if node.attrs.get("alt", "").strip():
                    out.words(f"[{node.attrs['alt'].strip()}]")
                continue
            if tag == "input":
                if node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text") and node.attrs.get("value"):
                    out.words(node.attrs["value"])
                continue
            if tag == "table" and inside < TABLES:
                out.border(2)
                inside += 1
                steps.append(("table", node, out, [], lists, pre))
                lists, pre = [], 0
                steps.append(("rows", node, steps[-1][3]))
                continue
            edge = 2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1 if tag in BLOCK or node.foreign and tag in LABELS else 0
            if edge:
                out.border(edge)
            old = out.indent
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                deep = len(old) >= 2 * LEVELS
                if out.mark is None:
                    out.mark = mark
                    out.breaks = max(out.breaks, 1)
                elif not deep:  # a list that opens an item: its marks share the line
                    out.mark += mark
                if not deep:
                    out.indent = old + " " * len(mark)
            elif tag in ("blockquote", "dd") and len(old) < 2 * LEVELS:
                out.indent = old + "  "
            pre += tag in ("pre", "xmp", "textarea", "plaintext")
            steps.append(("close", node, edge, old))
            parted = node.foreign and tag in PARTED
            for c in reversed(node.children):
                steps.extend([("open", c), ("open", " ")] if parted else [("open", c)])
        elif kind == "close":
            node, edge, old = rest
            out.indent = old
            pre -= node.tag in ("pre", "xmp", "textarea", "plaintext")
            if node.tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if node.tag == "li" and out.mark is not None:
                out.mark = None
            if edge:
                out.border(edge)
        elif kind == "rows":  # finds the cells of one table
            node, rows = rest
            todo = []
            for c in node.children:
                if isinstance(c, str):
                    if c.strip():
                        todo.append(("cell", Node("td", {}), c, rows, True))
                elif c.tag in ("tbody", "thead", "tfoot", "colgroup"):
                    todo.append(("rows", c, rows))
                elif c.tag == "tr":
                    todo.append(("row", c, rows))
                else:  # captions, and what doesn't belong here: a line of its own
                    todo.append(("cell", c, None, rows, True))
            steps.extend(reversed(todo))
        elif kind == "row":
            node, rows = rest
            rows.append([])
            steps.extend(("cell", c, None, rows, False) for c in reversed(node.children) if not (isinstance(c, str) and not c.strip()))
        elif kind == "cell":
            node, data, rows, alone = rest
            if alone:
                rows.append([])
            steps.append(("end cell", node, rows, alone, out))
            out = Out()
            steps.extend(("open", c) for c in ([data] if data is not None else [node] if isinstance(node, str) else reversed(node.children)))
        elif kind == "end cell":
            node, rows, alone, outer = rest
            span = node.attrs.get("colspan", "1") if isinstance(node, Node) else "1"
            rows[-1].append((out.text(), 10_000 if alone else min(1000, int(span)) if re.fullmatch(r"[1-9]\d{0,5}", span) else 1))
            out = outer
        else:  # "table"
            _, outer, rows, lists, pre = rest
            out = outer
            inside -= 1
            grid = _grid([[(cell, 2 if span == 10_000 else span) for cell, span in row] for row in rows if any(cell for cell, _ in row)])
            if grid:
                out.lines(grid)
            out.border(2)
    return out.text()


def to_text(source: str | None) -> str:
    if not source:
        return ""
    root = parse(source)
    prune(root)
    return render(root)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text."""
    kind = pages.schema[id_col].dataType.simpleString()
    out = own_name(id_col, ["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([to_text(h) for h in part.column(1).to_pylist()], pa.string())], names=[out, "text"])

    return pages.select(F.col(quoted(id_col)), F.col(quoted(html_col)).cast("string").alias("html")).mapInArrow(run, f"{quoted(out)} {kind}, text string")
