"""Layout-aware rendering of web pages to text.

A tree builder reads the tags, supplying those that the markup leaves out (a new
paragraph ends the last, a new cell ends the last cell, headings end paragraphs, a
table row without a body gets one). Visibility rules drop what a reader would not see
(scripts, styles, templates, ``hidden``, ``display: none``, closed details). The
rest is laid out: blocks on lines of their own, a blank line between those that have
margins, list items with their marks, indented by depth, table cells in aligned
columns, preformatted text as it is, other white space collapsed.

Rows are independent, so a page is rendered where it is read, in Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Content that is text up to its own end tag, whatever it looks like.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never shown. Pages are read as by a reader whose scripts do not run.
UNSEEN = frozenset("head title script style template noembed noframes iframe object audio video canvas datalist dialog".split())
#: Not shown within these.
FOREIGN = frozenset(["svg", "math"])
_FOREIGN_UNSEEN = frozenset("desc metadata annotation annotation-xml".split())
#: Blocks, and how many blank lines they keep from their neighbours.
MARGIN = {t: 0 for t in "html body div section article aside header footer nav main address form fieldset legend li dt dd center details summary caption tr thead tbody tfoot option optgroup figcaption search hgroup text foreignobject mtr".split()}
MARGIN |= {t: 1 for t in "p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre hr table figure xmp listing".split()}
#: An opening tag ends an open element of these, up to the nearest of its bounds.
_CLOSES_P = "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul"
IMPLIED = {t: (frozenset(["p"]), frozenset("td th caption table button object".split())) for t in _CLOSES_P.split()}
IMPLIED |= {
    "li": (frozenset(["li"]), frozenset("ul ol menu table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
IMPLIED |= {"tbody": IMPLIED["thead"], "tfoot": IMPLIED["thead"], "body": (frozenset(["head"]), frozenset())}
#: An end tag looks for its element no further than these.
_SCOPE = frozenset("table td th caption html template".split())
_HEAD = frozenset("head base link meta script style title template noscript".split())

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(raw: str) -> dict[str, str]:
    if not raw.strip(" \t\n\r\f/"):
        return {}
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(page: str) -> Node:
    """The tree of a page. Anything is accepted; nothing is reported."""
    root = Node("html", {})
    stack = [root]
    # Where the open elements of each tag are in the stack, so that none is looked for.
    places: dict[str, list[int]] = {"html": [0]}
    at = 0

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def text(a: int, b: int) -> None:
        if b > a:
            part = page[a:b]
            if "&" in part:
                part = html.unescape(part)
            if stack[-1].tag == "head" and part.strip():
                cut(len(stack) - 1)
            stack[-1].children.append(part)

    def open_(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        return node

    def close_implied(tag: str) -> None:
        ends, bounds = IMPLIED[tag]
        i = last(ends)
        if i > max(0, last(bounds)):
            cut(i)
            # A row ends the cells, then the row before it.
            if tag in ("tr", "thead", "tbody", "tfoot"):
                close_implied(tag)

    pos = page.find("<")
    while pos >= 0:
        m = _TAG.match(page, pos)
        if m is None:
            pos = page.find("<", pos + 1)
            continue
        text(at, m.start())
        at = m.end()
        if m["name"] is not None:
            tag = m["name"].lower()
            if m["end"]:
                if tag == "p" and not places.get("p"):
                    open_("p", {})
                elif tag == "br":
                    open_("br", {})
                i = last([tag])
                if i > 0 and (tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") or i >= last(_SCOPE)):
                    cut(i)
            else:
                attrs = _attributes(m["attrs"])
                if tag in ("html", "body") and places.get(tag):
                    # A second one only adds what the first lacks.
                    own = stack[places[tag][0]]
                    own.attrs = {**attrs, **own.attrs}
                else:
                    if stack[-1].tag == "head" and tag not in _HEAD:
                        cut(len(stack) - 1)
                    if tag in IMPLIED:
                        close_implied(tag)
                    if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                        push(open_("tr", {}))
                    if tag in _FOREIGN_UNSEEN and last(FOREIGN) >= 0:
                        attrs["hidden"] = ""
                    node = open_(tag, attrs)
                    empty = m["attrs"].rstrip().endswith("/") and (tag in FOREIGN or last(FOREIGN) >= 0)
                    if empty:
                        pass
                    elif tag in RAW:
                        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                        stop = end.start() if end else len(page)
                        if stop > at:
                            body = page[at:stop]
                            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
                        at = end.end() if end else len(page)
                    elif tag not in VOID:
                        push(node)
        pos = page.find("<", at)
    text(at, len(page))
    return root


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN and not (node.tag == "dialog" and "open" in a):
        return False
    if not a:
        return True
    if "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    return not ("style" in a and _HIDDEN.search(a["style"]))


class Lines:
    """Lines of text; collapses white space within and keeps margins between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # white space is due before the next word
        self.margin = 0  # blank lines due before the next line
        self.lead = ""  # mark of a list item before its first word
        self.indent = ""

    def write(self, part: str) -> None:
        body = part.strip(" \t\n\r\f")
        if not body:
            self.space = self.space or bool(self.now)
            return
        if self.now and (self.space or part[0] in " \t\n\r\f"):
            self.now.append(" ")
        self.now.append(_SPACE.sub(" ", body))
        self.space = part[-1] in " \t\n\r\f"

    def end(self) -> None:
        if self.now:
            self.put("".join(self.now))
        self.now, self.space = [], False

    def put(self, line: str) -> None:
        if self.lines:
            self.lines.extend([""] * self.margin)
        self.margin = 0
        first, self.lead = self.lead, ""
        self.lines.append((self.indent[: len(self.indent) - len(first)] + first if first else self.indent) + line)

    def block(self, margin: int) -> None:
        self.end()
        self.margin = max(self.margin, margin)


_SECTIONS = frozenset(["thead", "tbody", "tfoot"])
_PARTS = _SECTIONS | {"tr", "td", "th"}


def _enters(node: Node) -> bool:
    """Whether rows and cells below a node can be those of the table around it."""
    return node.tag not in ("table", "td", "th", "caption") and not (node.tag == "details" and "open" not in node.attrs) and visible(node)


def _holders(table: Node) -> set[int]:
    """Ids of the nodes, the table's own sections and rows among them, with rows or cells of it below."""
    above: dict[int, Node] = {}
    held: set[int] = set()
    todo = [table]
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, str):
                continue
            if c.tag in _PARTS:
                up = node
                while up is not None and id(up) not in held:
                    held.add(id(up))
                    up = above.get(id(up))
            if _enters(c):
                above[id(c)] = node
                todo.append(c)
    return held


def _split(table: Node) -> tuple[list[list[Node]], Node]:
    """Rows of cells, through whatever is wrapped around them, and all else but direct captions."""
    held, rows, rest = _holders(table), [], Node("div", {})
    # What is read on, the row its cells go to, where all else goes.
    todo: list[list] = [[iter(table.children), None, rest]]
    while todo:
        frame = todo[-1]
        c = next(frame[0], None)
        if c is None:
            todo.pop()
            # Without anything in it, what is left of a row or wrapper is nothing.
            if todo and not frame[2].children:
                todo[-1][2].children.pop()
        elif isinstance(c, str):
            if frame[2].children or c.strip(" \t\n\r\f"):
                frame[2].children.append(c)
        elif not visible(c) or c.tag == "col" or (c.tag == "caption" and len(todo) == 1):
            continue
        elif c.tag in ("td", "th"):
            if frame[1] is None:
                frame[1] = []
                rows.append(frame[1])
            frame[1].append(c)
        elif c.tag in ("tr", "colgroup") or c.tag in _SECTIONS or (id(c) in held and _enters(c)):
            inside = c.tag in _PARTS or c.tag == "colgroup"
            left = Node("div", {}) if inside else Node(c.tag, c.attrs)
            frame[2].children.append(left)
            row = None if inside else frame[1]
            if c.tag == "tr":
                row = []
                rows.append(row)
            todo.append([iter(c.children), row, left])
        else:
            frame[2].children.append(c)
    return rows, rest


def _lay_table(grid: list[list[Node]], out: Lines, depth: int) -> None:
    """Cells in columns as wide as their widest line; a cell of many lines spreads down."""
    rows = []
    for row in grid:
        cells = []
        for cell in row:
            part = Lines()
            _lay(cell, part, depth + 1, "")
            part.end()
            span = cell.attrs.get("colspan", "1")
            cells.append(part.lines)
            cells.extend([[]] * (min(int(span), 1000) - 1 if span.isascii() and span.isdigit() and int(span) > 1 else 0))
        if any(cells):
            rows.append(cells)
    width: dict[int, int] = {}
    for cells in rows:
        for i, lines in enumerate(cells):
            width[i] = max(width.get(i, 0), *(len(x) for x in lines), 0)
    for cells in rows:
        for k in range(max(len(c) for c in cells)):
            line = "  ".join((c[k] if k < len(c) else "").ljust(width[i]) for i, c in enumerate(cells) if width[i])
            out.put(line.rstrip())


#: Nesting up to which blocks have lines and places of their own.
MAX_DEPTH = 200


def _first_number(node: Node) -> int:
    start = node.attrs.get("start", "1")
    return int(start) if start.lstrip("-").isascii() and start.lstrip("-").isdigit() and len(start) < 10 else 1


def _label(node: Node) -> str:
    return node.attrs.get("alt" if node.tag == "img" else "value", "")


def _deep(node: Node) -> Iterator[str]:
    """What is seen below a node, in one line: text, labels, list marks and rules."""
    todo: list = [node]
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            yield one
            continue
        if one.tag in ("img", "input"):
            yield _label(one)
        elif one.tag == "hr":
            yield "---"
        closed, number, parts = one.tag == "details" and "open" not in one.attrs, _first_number(one), []
        for c in one.children:
            if isinstance(c, str):
                parts.extend([] if closed else [c])
            elif visible(c) and not (closed and c.tag != "summary"):
                if c.tag == "li":
                    parts.append(f"{number}." if one.tag == "ol" else "-")
                    number += 1
                space = c.tag in MARGIN or c.tag == "br"
                parts.extend([" ", c, " "] if space else [c])
        todo.extend(reversed(parts))


def _flat(node: Node) -> Iterator[str]:
    """All visible text below a node, without recursion."""
    todo = [node]
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            yield one
        elif one is node or visible(one):
            if one is not node and (one.tag == "br" or one.tag in MARGIN):
                yield "\n"
            todo.extend(reversed(one.children))


def _lay(node: Node, out: Lines, depth: int, listed: str) -> None:
    if depth > MAX_DEPTH:
        out.write("".join(_deep(node)))
        return
    number = _first_number(node) if node.tag == "ol" else 1
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if not closed:
                out.write(child)
            continue
        if not visible(child) or (closed and child.tag != "summary"):
            continue
        tag = child.tag
        if tag == "br":
            if out.now:
                out.end()
            else:
                out.margin = max(out.margin, 1)
            continue
        if tag in ("img", "input"):
            label = _label(child)
            if label.strip():
                out.write(label)
            continue
        margin = MARGIN.get(tag)
        if margin is None:
            if tag in ("td", "th") and out.now:
                out.space = True
            _lay(child, out, depth + 1, listed)
            continue
        if tag in ("ul", "ol", "menu") and listed:
            margin = 0
        out.block(margin)
        if tag == "hr":
            out.put("---")
        elif tag in ("pre", "listing", "xmp", "textarea"):
            body = "".join(_flat(child)) if tag != "xmp" else "".join(c for c in child.children if isinstance(c, str))
            body = body.replace("\r\n", "\n").strip("\n")
            for line in body.split("\n") if body else []:
                out.put(line.rstrip())
        elif tag == "table":
            captions = [c for c in child.children if isinstance(c, Node) and c.tag == "caption" and visible(c)]
            for c in captions:
                _lay(c, out, depth + 1, listed)
                out.end()
            grid, loose = _split(child)
            _lay_table(grid, out, depth)
            _lay(loose, out, depth + 1, listed)
        elif tag == "li":
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            before = out.indent
            out.indent, out.lead = before + " " * len(mark), mark
            _lay(child, out, depth + 1, listed)
            out.end()
            out.indent, out.lead = before, ""
        elif tag in ("blockquote", "dd"):
            before = out.indent
            out.indent = before + "  "
            _lay(child, out, depth + 1, listed)
            out.end()
            out.indent = before
        else:
            _lay(child, out, depth + 1, tag if tag in ("ul", "ol", "menu") else listed)
        out.block(margin)


def render(page: str | None) -> str:
    """The text a reader sees; of a null or empty page, nothing."""
    if not page:
        return ""
    out = Lines()
    _lay(parse(page.replace("\0", "")), out, 0, "")
    out.end()
    return "\n".join(out.lines)


def extract(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """key, text, n_chars, n_lines for every row; repeated rows stay, an empty table is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [render(p) for p in part["html"].to_pylist()]
                lines = [len(t.split("\n")) if t else 0 for t in texts]
                columns = [part["key"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(lines, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "text", "n_chars", "n_lines"])

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "key long, text string, n_chars long, n_lines long").withColumnRenamed("key", key)


def op2(spark, sf_dir):
    from .common import table

    return extract(table(spark, sf_dir, "pages"))
