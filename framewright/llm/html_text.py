"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied tags (void elements; ends of p, li, dt, dd, option, rows and
cells; html, head and body) make a tree; a walk over it emits all visible text. Blocks stand on lines of
their own, paragraphs and headings between blank lines, list items behind ``- `` or their number and
indented by depth (up to ``DEEP`` levels), ``pre`` as it is, and table cells in aligned columns two spaces apart, a cell that spans rows
in the first of them (tables within over ``NESTED`` others are laid out as blocks). Of a ``select`` the chosen option is seen, or all of a
list of several lines.

Not visible: head, script, style, template, noscript, iframe, svg and the like; elements with ``hidden``, with
``display:none`` or ``visibility:hidden`` in their style, hidden inputs, and a ``dialog`` that isn't open.

Defined results. Null or empty html: empty text. Broken markup never fails: a lone ``<`` and a tag that never ends are text, unclosed
elements end with their parent, an end tag without a start is ignored. A tag whose quotes never close ends at the next ``>``, and after
``PATIENCE`` such tags quotes are no longer looked at. Repeated rows: a row each. Very deep
and very long pages: whole; the work is linear in the page (nothing is recursive, and nothing is searched for twice). Empty table: empty result.
Other columns pass through.
"""

from __future__ import annotations

import functools
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes svg math object audio video canvas datalist title meta link base param source track".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu pre blockquote table figure".split())
CLOSE_P = BLOCK - frozenset("body html li dd dt legend caption tbody tfoot thead tr".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
# What a start tag ends, and the elements that the search for it doesn't leave.
ENDS: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
} | {k: (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})) for k in ("tbody", "thead", "tfoot")}
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
DEEP, NESTED, PATIENCE = 40, 20, 64
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        for k, a, b, c in ATTR.findall(self.attrs):
            if k.lower() == name:
                return html.unescape(a or b or c)
        return None

    def seen(self) -> bool:
        if self.tag in UNSEEN:
            return False
        if not self.attrs:
            return self.tag != "dialog"
        low = self.attrs.lower()
        if "hidden" not in low and "none" not in low and self.tag != "dialog":
            return True
        if self.get("hidden") is not None or HIDES.search(self.get("style") or ""):
            return False
        if self.tag == "dialog" and self.get("open") is None:
            return False
        return not (self.tag == "input" and (self.get("type") or "").lower() == "hidden")


def tokens(page: str):
    """(start, end, name, attributes) of each tag and comment; names of comments are empty, those of end tags begin with a slash.

    ``send`` gets the place to go on from, after text that holds no tags.
    """
    at, last, impatient = 0, page.rfind(">"), 0
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        if page.startswith(("<!", "<?"), at):
            mark = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(mark, at + 2)
            end = len(page) if end < 0 else end + len(mark)
            yield at, end, "", ""
            at = end
            continue
        m = NAME.match(page, at + 1)
        if m is None or m.end() > last:
            at += 1
            continue
        rest = REST.match(page, m.end()) if impatient < PATIENCE else None
        end = rest.end() if rest else page.index(">", m.end()) + 1
        impatient += rest is None and impatient < PATIENCE
        skip = yield at, end, m[0].lower(), page[m.end() : end - 1]
        at = end if skip is None else skip


class Open:
    """The open elements, and where those of each name stand."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            self.at[self.nodes.pop().tag].pop()

    def last(self, names) -> int:
        """The place of the innermost element of such a name, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def close(self, names, barrier) -> None:
        """End the elements of such names within the innermost barrier."""
        floor = self.last(barrier)
        while (k := self.last(names)) > max(floor, 0):
            self.cut(k)


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    stack = Open(root)
    body: Node | None = None
    at = 0

    def to_body():
        nonlocal body
        if body is None:
            stack.cut(1)
            body = Node("body")
            root.children.append(body)
            stack.push(body)

    def text(s: str) -> None:
        if s:
            if body is None and stack.nodes[-1].tag in ("head", "html"):
                if s.isspace():
                    return
                to_body()
            stack.nodes[-1].children.append(html.unescape(s) if "&" in s else s)

    scan = tokens(page)
    tag = next(scan, None)
    while tag is not None:
        start, end, name, attrs = tag
        text(page[at:start])
        at = end
        skip = None
        if name.startswith("/"):
            name = name[1:]
            if name == "p" and stack.last("p") < 0:
                stack.nodes[-1].children.append(Node("p"))
            elif name == "br":
                stack.nodes[-1].children.append(Node("br"))
            elif name not in ("html", "body"):
                floor = 0 if name in LAYOUT else stack.last(("body", "table", "td", "th"))
                if name in LAYOUT and "body" in stack.at:
                    floor = stack.last(("body",))
                k = stack.last((name,))
                if k > 0 and (k > floor or (k == floor and name in LAYOUT)):
                    stack.cut(k)
        elif name == "html":
            root.attrs = root.attrs or attrs
        elif name == "body":
            to_body()
            body.attrs = body.attrs or attrs
        elif name == "head":
            if body is None and len(stack.nodes) == 1:
                stack.push(Node("head"))
                root.children.append(stack.nodes[-1])
        elif name:
            if body is None and name not in HEAD_ONLY:
                to_body()
            if name in CLOSE_P:
                stack.close(("p",), ("table", "td", "th", "caption", "button", "object"))
            if name in ENDS:
                stack.close(*ENDS[name])
            node = Node(name, attrs)
            stack.nodes[-1].children.append(node)
            if name in RAW:
                close = _raw_end(name).search(page, at)
                inner = page[at : close.start() if close else len(page)]
                node.children.append(html.unescape(inner) if name == "textarea" else inner)
                at = skip = close.end() if close else len(page)
            elif name not in VOID and (not attrs.endswith("/") or name not in ("svg", "math", "path", "use")):
                stack.push(node)
        tag = _go_on(scan, skip)
    text(page[at:])
    return root


#: End tags that reach over the cells and tables within them.
LAYOUT = frozenset("table tr tbody thead tfoot td th head caption".split())


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}[^>]*>", re.I)


def _go_on(scan, skip):
    try:
        return scan.send(skip)
    except StopIteration:
        return None


class Writer:
    """Lines of text: inline text gathers until a block begins or ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.blank = False
        self.indent, self.mark = "", ""

    def put(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.inline.append(first)
            for line in rest:
                self._line("".join(self.inline).rstrip(), keep=True)
                self.inline = [line]
        else:
            self.inline.append(s)

    def _line(self, s: str, keep: bool = False) -> None:
        if s or keep:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append((self.indent + self.mark + s).rstrip() if s or self.mark else "")
            self.mark = " " * len(self.mark) if not self.mark.isspace() else self.mark

    def end(self, pre: bool = False, hard: bool = False) -> None:
        """End the line in hand; ``hard``: even if it is empty."""
        if self.inline:
            s = "".join(self.inline)
            self.inline = []
            self._line(s.rstrip() if pre else " ".join(s.split()), keep=hard and not pre)
        elif hard:
            self._line("", keep=True)

    def text(self) -> str:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def table_lines(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Cells (text, columns, rows) in columns of even width; a cell's lines stand below each other."""
    taken: dict[int, int] = {}  # the row from which a column is free again
    placed: list[list[tuple[int, str, int]]] = []
    for r, row in enumerate(rows):
        at, out = 0, []
        for cell, span, down in row:
            while taken.get(at, 0) > r:
                at += 1
            out.append((at, cell, span))
            if down > 1:
                for k in range(at, at + span):
                    taken[k] = r + down
            at += span
        placed.append(out)
    width: dict[int, int] = {}
    for row in placed:
        for at, cell, span in row:
            if span == 1:
                width[at] = max(width.get(at, 0), max((len(x) for x in cell.split("\n")), default=0))
    columns = max(width, default=0) + 1
    start = [0]  # where each column begins
    for k in range(columns):
        start.append(start[-1] + width.get(k, 0) + 2)
    place = lambda k: start[k] if k <= columns else start[-1]
    out = []
    for row in placed:
        cells = [(at, c.split("\n")) for at, c, _ in row]
        for k in range(max((len(c) for _, c in cells), default=0)):
            line = ""
            for at, c in cells:
                if k < len(c) and c[k]:
                    line = line.ljust(place(at)) if len(line) <= place(at) else line + "  "
                    line += c[k]
            out.append(line.rstrip())
    return out


def _span(node: Node, name: str) -> int:
    try:
        return max(1, min(1000, int(node.get(name) or 1)))
    except ValueError:
        return 1


def _options(node: Node) -> list:
    """What is seen of a select: the chosen option, or the first; all where it shows several lines."""
    todo, found = list(reversed(node.children)), []
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and x.tag == "option":
            if x.seen():
                found.append(x)
        elif isinstance(x, Node) and x.seen():
            todo += reversed(x.children)
    if node.get("multiple") is not None or _span(node, "size") > 1:
        return found
    return [next((x for x in found if x.get("selected") is not None), found[0])] if found else []


def render(page: str | None) -> str:
    """All visible text of a page, laid out."""
    if not page:
        return ""
    w = Writer()
    lists: list[list] = []  # kind and next number
    saved: list = []  # (writer, lists) outside of tables and cells
    tables: list[list[list[tuple[str, int, int]]]] = []
    inside = 0  # tables around what is being read, laid out or not
    pre = 0
    todo: list = [build(page)]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            w.put(node, pre > 0)
            continue
        if isinstance(node, tuple):  # the end of an element
            node, before = node
            tag = node.tag
            if tag in ("td", "th") and before == "cell":
                cell = w.text()
                w, lists = saved.pop()
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((cell, _span(node, "colspan"), _span(node, "rowspan")))
                continue
            if tag == "table":
                inside -= 1
            if tag == "table" and before == "grid":
                w.end()
                w.blank = True
                for line in table_lines(tables.pop()):
                    w._line(line)
                w.blank = True
                continue
            w.end(pre=pre > 0)
            if tag == "pre":
                pre -= 1
            if tag in ("ul", "ol", "menu") and lists:
                lists.pop()
            if tag == "li":
                w.mark, w.indent = before
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                w.blank = True
            continue
        if not node.seen():
            continue
        tag, before = node.tag, None
        if tag == "br":
            w.end(pre=pre > 0, hard=True)
            continue
        if tag == "hr":
            w.end()
            w._line("---")
            continue
        if tag == "select":
            todo.extend(x for o in reversed(_options(node)) for x in (" ", *reversed(o.children), " "))
            continue
        grid = 0 < inside <= NESTED
        if tag == "table":
            inside += 1
        if tag in ("td", "th") and grid:
            saved.append((w, lists))
            w, lists, before = Writer(), [], "cell"
        elif tag == "table" and inside <= NESTED:
            w.end()
            tables.append([])
            before = "grid"
        elif tag == "tr" and grid:
            tables[-1].append([])
        elif tag in BLOCK or tag in ("td", "th"):
            w.end(pre=pre > 0)
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                w.blank = True
            if tag == "pre":
                pre += 1
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, 1])
            if tag == "li":
                before = w.mark, w.indent
                kind = lists[-1] if lists else ["ul", 1]
                w.indent = "  " * max(0, min(len(lists), DEEP) - 1)
                w.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
        else:  # inline
            todo.extend(reversed(node.children))
            continue
        todo.append((node, before))
        todo.extend(reversed(node.children))
    return w.text()


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the rendered text in ``out_col`` instead of the html."""
    ship(pages.sparkSession)

    @F.arrow_udf("string")
    def rendered(s):
        return pa.array((render(x) for at in range(0, len(s), 200) for x in s.slice(at, 200).to_pylist()), pa.string())

    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    return pages.select(*keep, rendered(F.coalesce(pages[html_col].cast("string"), F.lit(""))).alias(out_col))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
