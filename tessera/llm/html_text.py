"""Layout-aware text of web pages.

A page's markup becomes a tree, with end tags that authors may leave out
implied; hidden parts are left out by their elements, attributes, inline styles
and simple rules of style elements; the rest is written as text with the blocks'
spacing, list markers and tables whose cells are aligned in columns, spans
included. Everything visible is kept, navigation and footers included, and
nesting has no limit: open elements are found by name, and the tree is walked
without recursion. Only how deep a layout shows is limited, since indents of
indents would make the text's length grow as its square: beyond DEEPEST_LAYOUT
levels, inner lists are not indented further and inner tables are written as
blocks.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object svg math audio video canvas datalist xmp noembed noframes param source track area base link meta title dialog".split())
#: Blank lines around these, and a new line around the second.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCKS = frozenset("html body div section article header footer nav aside main address form fieldset li dt dd tr caption thead tbody tfoot figcaption details summary legend option center hgroup search menu optgroup".split()) | PARAGRAPHS
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section search summary table ul".split())
#: A start tag of the key ends open elements among the first set, up to one of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: An end tag does not reach past these.
SCOPES = {"li": {"ul", "ol", "menu"}, "p": {"table", "td", "th", "caption", "button"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_HEAD_TAGS = frozenset("head title meta link base script style template noscript".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SHOWN = re.compile(r"(?:^|[;\s{])(display|visibility)\s*:\s*([a-z-]+)", re.I)
_USED = re.compile(r"hidden|display|visibility|type|start|value|alt|open|span", re.I)
_NAMED = re.compile(r"class|id", re.I)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-z][a-z0-9]*|)([.#][\w-]+|)", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
# Fixed values of the HTML standard: the largest spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
DEEPEST_LAYOUT = 24


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(text: str, named: bool) -> dict:
    """Only what the layout needs is looked for; names and classes only where a style rule may ask for them."""
    if not text or not (_USED.search(text) or named and _NAMED.search(text)):
        return {}
    return {m[1].lower(): html.unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in reversed(list(_ATTRIBUTE.finditer(text)))}


class Styles:
    """Rules for display and visibility whose selectors are an element, a class, an id, or an element with one of them.

    Other selectors, and blocks within at-rules, are passed over.
    """

    def __init__(self):
        self.rules: dict[tuple[str, str], dict[str, tuple]] = {}

    def read(self, sheet: str) -> None:
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)
        # the outer braces of @media and the like hold further braces
        sheet = re.sub(r"@[^{};]*(?:;|\{(?:[^{}]|\{[^{}]*\})*\})", "", sheet)
        for m in _RULE.finditer(sheet):
            for name, value in _SHOWN.findall(m[2]):
                for selector in m[1].split(","):
                    one = _SELECTOR.fullmatch(selector.strip())
                    if one and one[0]:
                        key, weight = (one[1].lower(), one[2]), ("#" in one[2], "." in one[2], bool(one[1]))
                        own = self.rules.setdefault(key, {})
                        own[name.lower()] = (weight, len(self.rules), value.lower())

    def of(self, node: Node) -> dict[str, str]:
        """The element's own display and visibility, the heaviest and then the latest rule's, or the inline one's."""
        a, best = node.attributes, {}
        if self.rules:
            names = ["", *("." + c for c in a.get("class", "").split()), *(["#" + a["id"]] if a.get("id") else [])]
            for key in ((tag, name) for tag in ("", node.tag) for name in names):
                for what, rule in self.rules.get(key, {}).items():
                    best[what] = max(best.get(what, rule), rule)
        found = {what: rule[2] for what, rule in best.items()}
        if a.get("style"):
            found |= {name.lower(): value.lower() for name, value in _SHOWN.findall(a["style"])}
        return found


def parse(source: str) -> tuple[Node, Styles]:
    """The page's tree, and the rules of its style elements."""
    root, styles = Node("#root", {}), Styles()
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack the open elements of each name are

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(length: int) -> None:
        while len(stack) > length:
            places[stack.pop().tag].pop()

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags, limits) -> None:
        """Ends open elements down to the outermost of ``tags`` that is within the innermost of ``limits``."""
        limit = innermost(limits)
        found = [own[i] for own in map(places.get, tags) if own and (i := bisect.bisect_right(own, limit)) < len(own)]
        if found:
            cut(min(found))

    at, end, begin = 0, len(source), 0
    tags = _TAG
    while at < end:
        begin = source.find("<", begin)
        if begin < 0 or begin + 1 >= end:
            stack[-1].children.append(source[at:])
            break
        after = source[begin + 1]
        if after in "!?" or (after == "/" and not source[begin + 2 : begin + 3].isalpha()):
            if begin > at:
                stack[-1].children.append(source[at:begin])
            if source.startswith("<!--", begin):
                quick = source.startswith((">", "->"), begin + 4)
                stop = None if quick else _COMMENT_END.search(source, begin + 4)
                at = source.find(">", begin) + 1 if quick else stop.end() if stop else end
            else:
                at = source.find(">", begin) + 1 or end
            begin = at
            continue
        if not (after == "/" or (after.isascii() and after.isalpha())):
            begin += 1  # text
            continue
        m = tags.match(source, begin)
        if m is None:
            if begin > at:
                stack[-1].children.append(source[at:begin])
            at = begin
            # a quote that never ends: from here on tags end at the next >
            tags = _LOOSE_TAG
            m = tags.match(source, begin)
            if m is None:
                break
        if begin > at:
            stack[-1].children.append(source[at:begin])
        at = begin = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not places.get("p"):
                stack[-1].children.append(Node("p", {}))
            elif places.get(tag) and places[tag][-1] > innermost(SCOPES.get(tag, ())):
                cut(places[tag][-1])
            continue
        if tag in CLOSES_P and places.get("p"):
            close(("p",), SCOPES["p"])
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if stack[-1].tag == "head" and tag not in _HEAD_TAGS:
            cut(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            push(row)
        node = Node(tag, _attributes(m[3], bool(styles.rules)))
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = _RAW_ENDS[tag].search(source, at)
            node.children.append(source[at : stop.start() if stop else end])
            at = begin = stop.end() if stop else end
            if tag == "style":
                styles.read(node.children[0])
        elif tag == "plaintext":
            node.children.append(source[at:])
            break
        else:
            push(node)
    return root, styles


def seen(node: Node, styles: Styles, inherited: bool) -> bool | None:
    """Whether the element's own text is visible; None if nothing inside of it can be."""
    a = node.attributes
    if node.tag in HIDDEN and not (node.tag == "dialog" and "open" in a):
        return None
    if not a and not styles.rules:
        return inherited
    if node.tag == "input" and a.get("type", "").lower() == "hidden":
        return None
    own = styles.of(node)
    if own.get("display", "none" if "hidden" in a else "") == "none":
        return None
    visibility = own.get("visibility")
    return inherited if visibility in (None, "inherit", "unset") else visibility not in ("hidden", "collapse")


class Writer:
    """Collects lines; blank lines between blocks never double."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.marker = ""
        self.blank = 0  # blank lines of verbatim text, written if more text follows

    def text(self, words: str) -> None:
        spaced = _BLANK.sub(" ", words)
        if spaced == " " or not spaced:
            self.space = self.space or (spaced == " " and bool(self.line))
            return
        if not self.line:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            if self.marker:
                self.line.append(self.marker)
                self.marker = ""
            spaced = spaced.lstrip(" ")
        elif self.space and not spaced.startswith(" "):
            self.line.append(" ")
        self.space = spaced.endswith(" ")
        self.line.append(spaced[:-1] if self.space else spaced)

    def raw(self, line: str) -> None:
        self.stop(1)
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append(line.rstrip())

    def verbatim(self, words: str) -> None:
        """Text of which every blank counts; only newlines end its lines."""
        first, *more = words.split("\n")
        for i, part in enumerate([first, *more]):
            if i:
                if self.line:
                    self.lines.append("".join(self.line).rstrip())
                    self.line = []
                else:
                    self.blank += 1
            if part:
                if not self.line:
                    if self.gap > 1 and self.lines:
                        self.lines.append("")
                    self.lines.extend([""] * self.blank if self.gap <= 1 else [])
                    self.gap = self.blank = 0
                    if self.marker:
                        self.line.append(self.marker)
                        self.marker = ""
                elif self.space:
                    self.line.append(" ")
                self.space = False
                self.line.append(part)

    def stop(self, gap: int) -> None:
        """Ends the line; ``gap`` 2 asks for a blank line before the next."""
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space, self.blank = False, 0
        self.gap = max(self.gap, gap)

    def done(self) -> str:
        self.stop(1)
        return "\n".join(self.lines)


def _width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "").strip()
    return min(int(value), most) if re.fullmatch(r"[0-9]{1,9}", value) else 1


def _run(task):
    """Runs a generator that yields generators and is sent their results; none of them deepens Python's stack."""
    stack, value = [task], None
    while stack:
        try:
            asked = stack[-1].send(value)
            stack.append(asked)
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _aligned(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """The lines of rows of cells (columns, rows, lines), their columns aligned; a cell's lines stand below each other.

    A cell lies in the first columns that no cell of an earlier row reaches down
    into. A cell over several columns widens the last of them only if it must.
    """
    taken: dict[int, tuple[int, int]] = {}  # first column of a cell: the first row that is free again, the column after it
    placed = []
    for number, row in enumerate(rows):
        at, own = 0, []
        for columns, deep, lines in row:
            while taken.get(at, (0, 0))[0] > number:
                at = taken[at][1]
            own.append((at, at + columns, lines))
            if deep != 1:
                taken[at] = number + deep if deep else len(rows), at + columns
            at += columns
        placed.append(own)
    # columns in which no cell begins are part of the one before
    begins = sorted({a for own in placed for a, _, _ in own})
    placed = [[(bisect.bisect_left(begins, a), bisect.bisect_left(begins, b), lines) for a, b, lines in own] for own in placed]
    widths = [0] * len(begins)
    for a, b, lines in sorted((cell for own in placed for cell in own), key=lambda cell: cell[1] - cell[0]):
        lacking = max(map(_width, lines)) - sum(widths[a:b]) - 2 * (b - a - 1)
        widths[b - 1] += max(lacking, 0)
    starts = [0]
    for width in widths:
        starts.append(starts[-1] + width + 2)
    out = []
    for own in placed:
        for k in range(max((len(lines) for _, _, lines in own), default=0)):
            line, at = [], 0
            for a, _, lines in own:
                if k < len(lines) and lines[k]:
                    line += [" " * (starts[a] - at), lines[k]]
                    at = starts[a] + _width(lines[k])
            out.append("".join(line).rstrip())
    return out


def _table(node: Node, styles: Styles, shown: bool, depth: int):
    """A table's lines: captions and what else stands beside its rows, then the rows."""
    rows, lines = [], []

    def gather(at: Node, shown: bool):
        for child in at.children:
            if isinstance(child, str):
                if shown and child.strip():
                    lines.append(_BLANK.sub(" ", html.unescape(child)).strip())
                continue
            own = seen(child, styles, shown)
            if own is None:
                continue
            if child.tag == "tr":
                cells = []
                for cell in child.children:
                    if isinstance(cell, str):
                        if own and cell.strip():
                            cells.append((1, 1, [_BLANK.sub(" ", html.unescape(cell)).strip()]))
                    elif (inner := seen(cell, styles, own)) is not None:
                        text = yield _rendered(cell, styles, inner, depth)
                        cells.append((max(_span(cell, "colspan", MOST_COLUMNS), 1), _span(cell, "rowspan", MOST_ROWS), text.split("\n")))
                rows.append(cells)
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield gather(child, own)
            else:
                text = yield _rendered(child, styles, own, depth)
                lines.extend(x for x in text.split("\n") if x)

    yield gather(node, shown)
    return lines + _aligned(rows)


def _rendered(node: Node, styles: Styles, shown: bool, depth: int = 0):
    """The visible text of what is inside of an element; ``depth`` tables are around it."""
    out = Writer()
    yield _walk(out, node, styles, shown, 0, node.tag in _VERBATIM, depth)
    return out.done()


_VERBATIM = ("pre", "textarea", "xmp", "plaintext", "listing")


def _walk(out: Writer, at: Node, styles: Styles, shown: bool, lists: int, pre: bool, depth: int):
    number = None
    if at.tag == "ol":
        start = at.attributes.get("start", "1")
        number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    for place, child in enumerate(at.children):
        if isinstance(child, str):
            if not shown:
                continue
            words = html.unescape(child) if "&" in child and at.tag not in ("xmp", "plaintext") else child
            if pre:
                # the first newline belongs to the markup
                out.verbatim(words[1:] if place == 0 and at.tag in _VERBATIM and words.startswith("\n") else words)
            else:
                out.text(words)
            continue
        tag, own = child.tag, seen(child, styles, shown)
        if own is None:
            continue
        if tag == "br":
            if pre:
                out.verbatim("\n")
            elif out.line:
                out.stop(0)
            elif out.lines:
                out.gap = max(out.gap, 2)
            continue
        if tag == "hr":
            out.stop(2)
            continue
        if tag in ("img", "input"):
            words = child.attributes.get("alt" if tag == "img" or child.attributes.get("type", "").lower() == "image" else "value", "")
            if own and words and child.attributes.get("type", "").lower() not in ("checkbox", "radio", "password"):
                out.text(words)
            continue
        if tag == "wbr":
            continue
        if tag == "table" and depth < DEEPEST_LAYOUT:
            out.stop(2)
            for line in (yield _table(child, styles, own, depth + 1)):
                out.raw(line)
            out.stop(2)
            continue
        gap = 2 if tag in PARAGRAPHS else 1 if tag in BLOCKS else 0
        if tag in ("ul", "ol", "menu") and lists:
            gap = 1
        if tag in ("td", "th"):
            out.text(" ")
        if gap:
            out.stop(gap)
        if tag == "li":
            mark = "- " if number is None else f"{number}. "
            if number is not None:
                value = child.attributes.get("value", "")
                number = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else number
                mark = f"{number}. "
                number += 1
            out.marker = "  " * min(max(lists - 1, 0), DEEPEST_LAYOUT) + mark
        elif tag == "dd":
            out.marker = "  "
        yield _walk(out, child, styles, own, lists + (tag in ("ul", "ol", "menu")), pre or tag in _VERBATIM, depth)
        if tag in ("li", "dd"):
            out.marker = ""
        if gap:
            out.stop(gap)


def render(node: Node, styles: Styles | None = None) -> str:
    """The visible text of a tree."""
    return _run(_rendered(node, styles or Styles(), True))


def extract(source: str | None) -> tuple[str, str]:
    """(title, visible text) of a page; of null or an empty page both are empty."""
    if not source:
        return "", ""
    tree, styles = parse(source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", ""))
    title, queue = "", [tree]
    while queue:
        node = queue.pop()
        if node.tag == "title" and node.children:
            title = _BLANK.sub(" ", html.unescape(node.children[0])).strip()
            break
        if node.tag in ("#root", "html", "head"):
            queue.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return title, render(tree, styles)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, title and text of each page; see extract().

    Whole pages are read, whatever their length. A null id stays null, repeated
    rows come out as often, other columns are left out, and an empty table has
    no rows. Each page is handled alone, so nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType

    slim = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("html"))
    out = StructType([slim.schema["page_id"]]).add("title", StringType()).add("text", StringType())
    schema = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "html"):
                titles, texts = zip(*map(extract, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema.field(0).type), pa.array(titles, pa.string()), pa.array(texts, pa.string())], schema=schema)

    return slim.mapInArrow(run, out)
