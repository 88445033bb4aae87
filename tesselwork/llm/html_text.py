"""Layout-aware text of HTML: a tree with implied tags, visibility rules, and a renderer of blocks, lists and tables.

All visible text of a page comes out, in order (what styles hide is in ``css``; scripts are taken as on, and not run): blocks on lines of their own with blank lines where a browser leaves
margins, list items behind their markers, table cells aligned in columns. Every step works with a stack of its own,
so deeply nested pages need no deep recursion, and takes time in proportion to the page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselwork.llm.css import Styles, on_screen

# Element classes of the HTML standard.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("textarea title".split())
UNSEEN = frozenset("script style template noscript iframe noembed noframes audio video canvas object area base link meta param source track".split())
#: Not displayed unless a style says otherwise.
NOT_DISPLAYED = frozenset("head title datalist rp".split())
ROWS = frozenset("tr tbody thead tfoot".split())
SVG_UNSEEN = frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter metadata desc title".split())
MATH_UNSEEN = frozenset("annotation annotation-xml".split())
MATH_APART = frozenset("mfrac mroot munder mover munderover mtr mtable".split())  # whose parts stand apart
#: Tags that end an open svg or math, and those in which HTML may stand.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
FOREIGN = frozenset("svg math".split())
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
BLOCKS = CLOSES_P | frozenset("html body caption legend optgroup option tr td th tbody thead tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre listing xmp figure table hr fieldset".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
SCOPE = frozenset("table td th caption html template button object".split())
#: tag -> (open tags that it closes, tags that bound the search)
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th html".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th html".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th html".split())),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup html".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset("select datalist html".split())),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset("table tbody thead tfoot html".split())),
    "td": (frozenset("td th caption".split()), frozenset("tr table html".split())),
    "th": (frozenset("td th caption".split()), frozenset("tr table html".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset("table html".split())),
    "thead": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset("table html".split())),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset("table html".split())),
    "caption": (frozenset("caption colgroup".split()), frozenset("table html".split())),
    "colgroup": (frozenset("caption colgroup".split()), frozenset("table html".split())),
}
IMPLIED["rp"] = IMPLIED["rt"] = (frozenset("rt rp".split()), frozenset("ruby html".split()))

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*+)>")  # where a quote is never closed
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW | RCDATA}
_BLANK = re.compile(r"[ \t\n\r\f]+")

#: A column is as wide as its widest line, at most so many characters. A longer line is never cut: what stands right of
#: it in its row begins a line below, in its own column, so that columns are aligned in all rows of any table and no
#: long cell pads all the others.
MOST_WIDE = 60


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _tokens(html: str) -> Iterator[tuple]:
    """("text", str), ("open", tag, attrs, closed) and ("close", tag); comments and declarations are skipped."""
    at, end = 0, len(html)
    while at < end:
        cut = html.find("<", at)
        if cut < 0:
            cut = end
        if cut > at:
            yield "text", unescape(html[at:cut])
            at = cut
            continue
        if html.startswith("<!--", at):
            close = html.find("-->", at + 4)
            at = end if close < 0 else close + 3
            continue
        if html.startswith(("<!", "<?"), at):
            close = html.find(">", at)
            at = end if close < 0 else close + 1
            continue
        m = _TAG.match(html, at) or _LOOSE.match(html, at)
        if not m:
            yield "text", "<"
            at += 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            yield "close", tag
            continue
        yield "open", tag, _attributes(m[3]) if m[3].strip(" /") else {}, m[3].endswith("/")
        if tag in RAW or tag in RCDATA:
            m = _END[tag].search(html, at)
            close = m.start() if m else end
            body, at = html[at:close], close
            if body:
                yield "raw" if tag in RAW else "text", body if tag in RAW else unescape(body)
        elif tag == "plaintext":
            yield "text", html[at:]
            return


def parse(html: str) -> tuple[Node, Node, list[str]]:
    """The tree, the body with its attributes only, and the texts of the style elements that are for screens."""
    root, body = Node("html"), Node("body")
    stack, styles, headed = [root], [], False
    open_: Counter = Counter()  # so that only tags that are open are looked for

    def pop_to(depth: int) -> None:
        open_.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    def find(tags: frozenset, stop: frozenset) -> int:
        if not any(open_[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stop:
                return 0
        return 0

    def push(tag: str, attrs: dict | None = None) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        stack.append(node)
        open_[tag] += 1
        return node

    paragraph = frozenset(["p"])
    for token in _tokens(html):
        kind = token[0]
        if kind == "raw":
            if stack[-1].tag == "style":
                a = stack[-1].attrs
                if not (open_["template"] or open_["noscript"]) and a.get("type", "").strip().lower() in ("", "text/css") and on_screen(a.get("media", "")):
                    styles.append(token[1])
            elif stack[-1].tag == "xmp":
                stack[-1].children.append(token[1])
            continue
        if kind == "text":
            if stack[-1].tag == "head" and token[1].strip():
                pop_to(len(stack) - 1)
            stack[-1].children.append(token[1])
            continue
        tag = token[1]
        if kind == "close":
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            wanted = frozenset([tag])
            bound = frozenset(["html"]) if tag in SCOPE else SCOPE
            depth = find(wanted, bound)
            if depth:
                pop_to(depth)
            elif tag == "p":
                push("p")
                pop_to(len(stack) - 1)
            continue
        attrs, closed = token[2], token[3]
        if tag == "html" or tag == "body":
            if stack[-1].tag == "head":
                pop_to(len(stack) - 1)
            top = root if tag == "html" else body
            top.attrs = {**attrs, **top.attrs}
            continue
        if tag == "head":
            if not headed and len(stack) == 1:
                push("head", attrs)
                headed = True
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            pop_to(len(stack) - 1)
        if tag in BREAKS_OUT and (open_["svg"] or open_["math"]):
            while depth := find(FOREIGN, HOLDS_HTML):
                pop_to(depth)
        if tag in CLOSES_P and (depth := find(paragraph, SCOPE)):
            pop_to(depth)
        if tag in IMPLIED:
            closes, stop = IMPLIED[tag]
            while depth := find(closes, stop):
                pop_to(depth)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push("tr")
        if tag.startswith("h") and len(tag) == 2 and tag[1] in "123456" and re.fullmatch("h[1-6]", stack[-1].tag):
            pop_to(len(stack) - 1)
        push(tag, attrs)
        if tag in VOID or (closed and (tag in ("path", "g", "use", "rect", "circle") or (open_["svg"] or open_["math"]) and not open_["foreignobject"])):
            pop_to(len(stack) - 1)
    return root, body, styles


class Shown:
    """What of an element shows. States are (visible, in svg, its text or math, bits that ancestors match, bits that the parent matches)."""

    TOP = (True, "", 0, 0)

    def __init__(self, styles: list[str]):
        self.styles = Styles(styles)

    def __call__(self, node: Node, state: tuple) -> tuple | None:
        """The state of an element in one of ``state``; none if nothing of it is displayed."""
        a, tag = node.attrs, node.tag
        visible, inside, above, parent = state
        if tag in UNSEEN or inside == "svg" and tag in SVG_UNSEEN or inside == "math" and tag in MATH_UNSEEN:
            return None
        if tag == "input" and a.get("type", "").lower() == "hidden":
            return None
        shown = not (tag in NOT_DISPLAYED or "hidden" in a and a["hidden"] != "until-found" or tag == "dialog" and "open" not in a)
        if tag == "mphantom" and inside == "math":
            visible = False
        if self.styles.steps or "style" in a:
            said, own = self.styles(tag, a, above, parent, tag == "html")
            display, visibility = said.get("display", "revert"), said.get("visibility", "inherit")
            if display not in ("revert", "revert-layer"):
                shown = display != "none"
            if visibility in ("visible", "initial"):
                visible = True
            elif visibility in ("hidden", "collapse"):
                visible = False
                shown = shown and not (visibility == "collapse" and tag in ROWS)
            above, parent = above | own, own
        if not shown:
            return None
        if tag in FOREIGN:
            inside = tag
        elif inside == "svg" and tag == "text":
            inside = "text"
        elif tag == "foreignobject":
            inside = ""
        return visible, inside, above, parent


class Canvas:
    """Lines of text; collapses blanks, and leaves one blank line at most between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.prefix: list[str] = []
        self.marker = ""
        self.gap = 0  # 1: a new line is due; 2: a blank line is due
        self.blank = True  # whether the line ends in a blank or has begun nothing

    def write(self, text: str) -> None:
        text = _BLANK.sub(" ", text)
        if self.blank and text.startswith(" "):
            text = text[1:]
        if not text:
            return
        self._begin()
        self.now.append(text)
        self.blank = text.endswith(" ")

    def _begin(self) -> None:
        if self.gap:
            if self.now:
                self._end()
            if self.gap == 2 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
        if not self.now:
            self.now.append("".join(self.prefix) + self.marker)
            if self.marker:
                self.prefix.append(" " * len(self.marker))
                self.marker = ""

    def _end(self) -> None:
        self.lines.append("".join(self.now).rstrip())
        self.now, self.blank = [], True

    def block(self, spaced: bool) -> None:
        self.gap, self.blank = max(self.gap, 2 if spaced else 1), True

    def newline(self) -> None:
        self._begin()
        self._end()

    def raw(self, lines: list[str], strip: bool = True) -> None:
        for line in lines:
            self._begin()
            self.now.append(line)
            self._end()

    def done(self) -> list[str]:
        if self.now:
            self._end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in text)


def _number(text: str, default: int, most: int) -> int:
    m = re.match(r"\s*(-?[0-9]{1,9})", text)
    return min(most, int(m[1])) if m else default


class Table:
    """Rows of cells with spans; laid out in columns as wide as their widest line, up to MOST_WIDE."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.caption: list[str] = []

    def layout(self) -> list[str]:
        spots: list[dict[int, tuple[int, list[str]]]] = []
        taken: dict[int, int] = {}  # column -> rows that a cell from above still fills
        widths: dict[int, int] = {}
        for row in self.rows:
            at, here, after = 0, {}, {c: n - 1 for c, n in taken.items() if n > 1}
            for across, down, lines in row:
                while taken.get(at, 0) > 0:
                    at += 1
                here[at] = (across, lines)
                if across == 1:
                    widths[at] = max(widths.get(at, 0), min(MOST_WIDE, max(map(width, lines), default=0)))
                if down > 1:
                    after.update({at + k: down - 1 for k in range(across)})
                at += across
            taken = after
            spots.append(here)
        columns = sorted({c for here in spots for c in here})
        for here in spots:  # a cell over several columns widens the last of them where it needs to
            for c, (across, lines) in here.items():
                if across > 1:
                    own = columns[bisect_left(columns, c) : bisect_left(columns, c + across)]
                    short = min(MOST_WIDE, max(map(width, lines), default=0)) - sum(widths.get(k, 0) for k in own) - 2 * (len(own) - 1)
                    widths[own[-1]] = widths.get(own[-1], 0) + max(0, short)
        starts, x = {}, 0
        for c in columns:
            starts[c] = x
            x += widths.get(c, 0) + 2
        out = list(self.caption)
        for here in spots:
            made: list[tuple[list[str], int]] = []  # per line: its parts and their width
            for c in sorted(here):
                line = 0
                for text in here[c][1]:
                    while line < len(made) and made[line][1] and made[line][1] + 2 > starts[c]:  # a longer cell to the left fills this line
                        line += 1
                    if line == len(made):
                        made.append(([], 0))
                    if text:
                        parts, used = made[line]
                        made[line] = ([*parts, " " * (starts[c] - used), text], starts[c] + width(text))
                    line += 1
            out += ["".join(parts).rstrip() for parts, _ in made]
        return out


def _marker(node: Node, index: int) -> str:
    kind = node.attrs.get("type", "1")
    if kind in ("a", "A") and index > 0:
        letters, n = "", index
        while n:
            n, r = divmod(n - 1, 26)
            letters = chr(97 + r) + letters
        return (letters if kind == "a" else letters.upper()) + ". "
    return f"{index}. "


def render(root: Node, body: Node, shows: Shown) -> list[str]:
    """Lines of the visible text. Frames on the stack are (node, children still to come, what to do at the end, whether blanks are kept, state)."""
    canvas = Canvas()
    stack: list = []
    tables: list[Table] = []
    counters: list = []  # per open list: the next number, or None

    def enter(node: Node, outer: tuple) -> None:
        nonlocal canvas
        tag = node.tag
        state = shows(node, outer)
        if state and node is root:
            state = shows(body, state)
        if not state:
            return
        visible, inside = state[:2]
        if tag == "br":
            if visible:
                canvas.newline()
            else:
                canvas.block(False)
            return
        if tag == "wbr":
            return
        if tag == "input":
            if visible and node.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "tel", "url", "number"):
                canvas.write(node.attrs.get("value", ""))
            return
        children = iter(node.children)
        if tag == "details" and "open" not in node.attrs:
            children = iter([c for c in node.children if isinstance(c, Node) and c.tag == "summary"])
        before, leave = canvas, None
        if tag == "table":
            canvas.block(True)
            tables.append(Table())

            def leave():
                nonlocal canvas
                canvas = before
                lines = tables.pop().layout()
                if lines:
                    canvas.raw(lines)
                canvas.block(True)

            canvas = Canvas()  # text that stands in a table outside of its cells comes before it
            loose = canvas
            close = leave

            def leave():
                extra = loose.done()
                if extra:
                    before.raw(extra)
                    before.block(False)
                close()

        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in ("td", "th") and tables:
            if not tables[-1].rows:
                tables[-1].rows.append([])
            row, cell = tables[-1].rows[-1], Canvas()
            across, down = _number(node.attrs.get("colspan", ""), 1, 1000), _number(node.attrs.get("rowspan", ""), 1, 65_534)
            canvas = cell
            held = counters[:]
            counters.clear()

            def leave():
                nonlocal canvas
                row.append((max(1, across), max(1, down), cell.done()))
                canvas = before
                counters[:] = held

        elif tag == "caption" and tables:
            table, canvas = tables[-1], Canvas()
            own = canvas

            def leave():
                nonlocal canvas
                table.caption += own.done()
                canvas = before

        elif tag in ("ul", "ol", "menu", "dir"):
            canvas.block(not counters)
            first = _number(node.attrs.get("start", ""), 1, 10**9)
            counters.append([node, first] if tag == "ol" else [node, None])

            def leave():
                counters.pop()
                canvas.block(not counters)

        elif tag == "li":
            canvas.block(False)
            if canvas.marker and visible:  # an item that begins with a list shows both markers on one line
                canvas._begin()
            mark = "* "
            if counters and counters[-1][1] is not None:
                index = _number(node.attrs.get("value", ""), counters[-1][1], 10**9)
                mark, counters[-1][1] = _marker(counters[-1][0], index), index + 1
            depth = len(canvas.prefix)
            if visible:
                canvas.marker = mark

            def leave():
                if before.marker and visible:  # an empty item
                    before.newline()
                del before.prefix[depth:]
                before.block(False)

        elif tag in ("blockquote", "dd"):
            canvas.block(tag == "blockquote")
            depth = len(canvas.prefix)
            canvas.prefix.append("    ")

            def leave():
                del before.prefix[depth:]
                before.block(tag == "blockquote")

        elif tag in ("pre", "listing", "xmp", "textarea", "plaintext"):
            canvas.block(tag != "textarea")

            def leave():
                before.block(tag != "textarea")

        elif tag == "q" and visible:
            canvas.write("“")

            def leave():
                before.write("”")

        elif inside == "text" and (tag == "text" or {"x", "y", "dy"} & node.attrs.keys()):  # placed on its own
            canvas.block(False)

            def leave():
                before.block(False)

        elif inside == "math" and stack[-1][0].tag in MATH_APART or tag == "math":
            canvas.write(" ")

            def leave():
                before.write(" ")

        elif tag in BLOCKS:
            canvas.block(tag in SPACED)

            def leave():
                before.block(tag in SPACED)

        keeps = bool(stack and stack[-1][3]) or tag in ("pre", "listing", "xmp", "textarea", "plaintext")
        stack.append((node, children, leave, keeps, state))

    enter(root, Shown.TOP)
    while stack:
        node, children, leave, keeps, state = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if leave:
                leave()
        elif isinstance(child, Node):
            enter(child, state)
        elif not state[0] or state[1] == "svg":
            continue
        elif keeps:
            parts = child.expandtabs(8).replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for i, part in enumerate(parts):
                if i:
                    canvas.newline()
                if part:
                    canvas._begin()
                    canvas.now.append(part)
                    canvas.blank = False
        else:
            canvas.write(child)
    return canvas.done()


def text_of(html: str | None) -> str:
    """All visible text of a page; nothing for null."""
    if not html:
        return ""
    root, body, styles = parse(html)
    lines = render(root, body, Shown(styles))
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Return page_id, text, n_chars and n_lines for every row.

    Null and empty pages give an empty text of no lines. Rows with a null id and repeated rows are kept. An empty
    table gives no rows. Other columns of ``pages`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [text_of(t) for t in b.column(1).to_pylist()]
            cols = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
