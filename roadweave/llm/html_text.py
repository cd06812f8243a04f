"""Layout-aware HTML to text (operator 9).

A tree builder with implied tags (paragraphs end at blocks, list items at list
items, cells and rows at cells and rows, the head at the first thing that cannot
stand in it, unclosed elements at the end) and a
renderer that emits all visible text: navigation, articles and footers alike.
Hidden are head matter, scripts, styles, templates, elements with ``hidden`` or
an inline ``display:none`` / ``visibility:hidden``, values of ``input``, MathML
annotations, what an ``svg`` holds outside its text or in its title, description and
definitions, and what a closed ``details`` holds besides its summary.  A ``select``
shows its chosen option, a list box all of them; a ``textarea`` shows its content.  Blocks begin on lines of their own,
paragraphs, headings, lists and tables stand apart by an empty line, list items
carry a bullet or their number and are indented by depth, preformatted text
keeps its blanks, and the cells of a table are padded to the width of their
column, counted in display columns; a cell of several lines (a table or preformatted
text in it) makes its row as high.  Cells are placed on a grid: what spans rows keeps
its columns free below, what spans columns takes their joint width.  Work is per
page, without shuffle; the walk keeps its own stack and the builder the places of
its open tags, so time and memory grow with the page, however deep it nests.

Bounds of the layout, none of which drops text: padding counts cells of up to ``WIDE``
columns; a row whose cells before the last are wider, or whose padding would take
more than ``ROW_PAD`` + ``WIDE`` * cells characters, is written unaligned, its long cells on
lines of their own; indents end at ``INDENT`` columns; tables nested deeper than
``TABLES`` are written as blocks; at most ``HELD`` spans over rows are held at a time.
So a text is at most some hundred times as long as its page.

Cases: a null or empty page gives an empty text; text without any tag is
rendered as inline text; broken markup is rendered as far as it goes: comments,
processing instructions and declarations without an end hide the rest, numbers that are none count as missing; repeated
rows are rendered one by one; an empty table gives an empty result; other
columns are carried along unless they are called ``text``, which is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import read
from .bpe import slices

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link datalist iframe object audio video canvas".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCKS = PARAGRAPHS | frozenset(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main menu nav section summary tr".split()
)
_CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
# Inside svg and math: never shown; where html goes on; html tags that end them.
_UNSHOWN = {
    "svg": frozenset("title desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
_HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template head".split())
_P_SCOPE = frozenset({"table", "td", "th", "caption", "button", "object"})
#: Parsers that read tags inside a textarea are told not to; the references in it are then resolved here.
_TAGS_IN_TEXTAREA = "textarea" not in getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})(?![0-9])")
_REFERENCE = re.compile(r"&#([xX]?)0*([0-9a-fA-F]+)")
_COMMENT_END = re.compile(r"--!?>")
#: Bounds of the layout, see above.
WIDE, ROW_PAD, INDENT, TABLES, HELD = 64, 512, 32, 16, 256
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of each tag in ``open``

    def _last(self, tags: Iterable[str]) -> int:
        """Index of the nearest open one of ``tags``, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _cut(self, at: int) -> None:
        """End the open elements from index ``at`` on."""
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def _foreign(self) -> int:
        """Index of the svg or math whose rules hold here, 0 if none."""
        if not (self.places["svg"] or self.places["math"]):
            return 0
        at = self._last(_UNSHOWN)
        return at if at > self._last(_HTML_AGAIN) else 0

    def _close(self, tags: frozenset[str], scope: frozenset[str]) -> None:
        """End the nearest open one of ``tags``, with all in it, unless one of ``scope`` stands between."""
        at = self._last(tags)
        if at and at >= self._last(scope):
            self._cut(at)

    def _end_head(self) -> None:
        """End a head that is the open element: what comes next cannot stand in it."""
        if self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)

    def _push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.places[tag].append(len(self.open))
        self.open.append(node)

    def handle_starttag(self, tag, attrs):
        if tag == "html" or tag == "head" and any(isinstance(c, Node) or c.strip() for c in self.root.children):
            return
        if tag not in _IN_HEAD:
            self._end_head()
        attrs = dict(reversed(attrs))  # the first of a name counts
        if at := self._foreign():
            if tag in _ENDS_FOREIGN:
                self._cut(at)
            else:
                unshown = tag in _UNSHOWN[self.open[at].tag] or attrs.get("display") == "none" or attrs.get("visibility") in ("hidden", "collapse")
                return self._push(tag, attrs | {"hidden": ""} if unshown else attrs)
        if tag in ("select", "input", "textarea"):
            self._close(frozenset({"select"}), frozenset({"table"}))
        if tag in ("option", "optgroup"):
            self._close(frozenset({"option"}), frozenset({"select", "datalist"}))
        if tag == "optgroup":
            self._close(frozenset({"optgroup"}), frozenset({"select", "datalist"}))
        if tag in BLOCKS and self.places["p"]:
            self._close(frozenset({"p"}), _P_SCOPE)
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push("tr", {})
        self._push(tag, attrs)
        if tag == "textarea" and _TAGS_IN_TEXTAREA:
            self.set_cdata_mode(tag)
        if tag in VOID:
            self._cut(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and (tag in _UNSHOWN or self._foreign() or tag in _HTML_AGAIN and self._inside_foreign()):
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "br":
            return self.handle_starttag("br", [])
        if tag in VOID or tag in ("html", "body"):
            return None
        scope = frozenset({"table"}) if tag not in ("table", "tbody", "thead", "tfoot") else frozenset()
        if tag == "p":
            scope = _P_SCOPE
        return self._close(frozenset({tag}), scope - {tag})

    def _inside_foreign(self) -> bool:
        """Whether the open element is a child of svg or math content."""
        last = self.places[self.open[-1].tag].pop()
        found = self._foreign() > 0
        self.places[self.open[-1].tag].append(last)
        return found

    def parse_comment(self, i, report=True):
        if short := re.compile(r"-?>").match(self.rawdata, i + 4):
            return short.end()
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i):
        raw = self.rawdata
        if raw.startswith("<![CDATA[", i) and self._foreign():
            end = raw.find("]]>", i)
            self.handle_data(raw[i + 9 : end if end >= 0 else len(raw)])
            return end + 3 if end >= 0 else len(raw)
        return self.parse_pi(i)

    def parse_pi(self, i):
        """Processing instructions, document types and unknown declarations show nothing."""
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def handle_data(self, data):
        if not _BLANKS.fullmatch(data):
            self._end_head()
        at = self._foreign()
        if at and self.open[at].tag == "svg" and self._last(("text",)) < at:
            return
        self.open[-1].children.append(data)


class _Out:
    """Lines of one flow: collapses blanks, keeps asked-for breaks apart from text."""

    def __init__(self, room: int = INDENT) -> None:
        self.parts: list[str] = []
        self.breaks = 0
        self.blank = False
        self.mark = ""
        self.lead = ""  # before the mark
        self.indent = ""
        self.room = room  # columns that indents may take

    def item(self, mark: str) -> str:
        """Begin a list item; the indent to return to."""
        before = self.lead = self.indent
        self.mark = mark
        if len(before) + len(mark) <= self.room:
            self.indent += " " * len(mark)
        return before

    def ask(self, n: int) -> None:
        self.breaks = max(self.breaks, n)
        self.blank = False

    def _begin(self) -> None:
        if self.breaks:
            if self.parts:
                self.parts.append("\n" * self.breaks)
            self.parts.append(self.lead + self.mark if self.mark else self.indent)
            self.breaks, self.mark = 0, ""

    def text(self, data: str, pre: bool) -> None:
        if pre:
            self._begin()
            self.parts.append(data.replace("\n", "\n" + self.indent))
            return
        words = _BLANKS.sub(" ", data)
        if words.startswith(" "):
            self.blank = bool(self.parts) and not self.breaks
        core = words.strip(" ")
        if core:
            gap = self.blank and not self.breaks
            self._begin()
            self.parts.append((" " if gap else "") + core)
            self.blank = words.endswith(" ")

    def line(self) -> None:
        """A forced line break."""
        self.breaks = self.breaks + 1 if self.parts or self.mark else 1
        self.blank = False

    def result(self) -> str:
        return "\n".join(x.rstrip() for x in "".join(self.parts).split("\n")).strip("\n")


def _number(node: Node, name: str, default: int = 1) -> int:
    found = _NUMBER.match(node.attrs.get(name) or "")
    return int(found[1]) if found else default


def _options(select: Node) -> tuple[list[str], bool]:
    """The options that a select shows, and whether it is a list box, which shows all with the labels of their groups."""
    box = "multiple" in select.attrs or _number(select, "size") > 1
    met: list[tuple[Node | None, str, bool]] = []
    stack: list[tuple[Node, bool]] = [(select, False)]
    while stack:
        node, off = stack.pop()
        if node is not select and not _visible(node):
            continue
        off = off or node is not select and "disabled" in node.attrs
        if node.tag == "option":
            texts, inner = [], [node]
            while inner:
                part = inner.pop()
                if isinstance(part, str):
                    texts.append(part)
                elif _visible(part):
                    inner.extend(reversed(part.children))
            met.append((node, node.attrs.get("label") or "".join(texts), off))
            continue
        if node.tag == "optgroup" and box and node.attrs.get("label"):
            met.append((None, node.attrs["label"], off))
        stack.extend((c, off) for c in reversed(node.children) if isinstance(c, Node))
    if box:
        return [text for _, text, _ in met], True
    chosen = [text for node, text, _ in met if "selected" in node.attrs][-1:]
    return chosen or [text for _, text, off in met if not off][:1], False


def _visible(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return False
    style = node.attrs.get("style")
    return not (style and _UNSEEN.search(style))


def _columns(line: str) -> int:
    """Display columns: wide characters take two, combining ones none."""
    if line.isascii():
        return len(line)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in line)


def _placed(rows: list[list[tuple[list[str], int, int]] | None]) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of (first column, column behind the last, lines), with the columns left free that cells of rows above span; None ends a row group."""
    out, held = [], []  # held: (first, behind, row behind the last)
    for row in rows:
        if row is None:
            held = []
            continue
        held = sorted(h for h in held if h[2] > len(out))
        made, new, at, i = [], [], 0, 0
        for lines, across, down in row:
            while i < len(held) and held[i][0] <= at:
                at = max(at, held[i][1])
                i += 1
            if down > 1 and len(held) + len(new) < HELD:
                new.append((at, at + across, len(out) + down))
            made.append((at, at + across, lines))
            at += across
        held += new
        out.append(made)
    return out


def _unaligned(cells: list[list[str]]) -> Iterator[str]:
    """Short cells side by side, longer ones on lines of their own."""
    run: list[str] = []
    for lines in [*cells, None]:
        if lines is not None and len(lines) < 2 and all(_columns(x) <= WIDE for x in lines):
            run.append("".join(lines))
            continue
        if any(run):
            yield " | ".join(run).rstrip()
        run = []
        yield from lines or ()


def _aligned(table: list[list[tuple[list[str], int, int]] | None]) -> Iterator[str]:
    """Lines of a table whose cells are (lines, columns spanned, rows spanned)."""
    rows = [r for r in _placed(table) if r]
    starts = sorted({c[0] for r in rows for c in r})  # columns where no cell begins take no room
    ends: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
    plain, places = [], []
    for row in rows:
        cells = [(bisect_left(starts, a), bisect_left(starts, b), lines) for a, b, lines in row]
        widths = [max(map(_columns, lines), default=0) for _, _, lines in cells]
        plain.append(any(w > WIDE for w in widths[:-1]))
        places.append(cells)
        for (i, j, _), w in zip(cells, widths, strict=True):
            if not plain[-1] and w <= WIDE:
                ends[j].append((i, w + 3))
    begin = [0] * (len(starts) + 1)  # display column of each column, as small as the cells before it allow
    for j in range(1, len(begin)):
        begin[j] = max(begin[j - 1], *(begin[i] + w for i, w in ends[j]), 0)
    for cells, wide in zip(places, plain, strict=True):
        high = max(len(lines) for _, _, lines in cells) or 1
        if wide or high * begin[cells[-1][0]] > ROW_PAD + WIDE * len(cells):
            yield from _unaligned([lines for _, _, lines in cells])
            continue
        for k in range(high):
            parts, at = [], 0
            for i, _, lines in cells:
                if i:
                    parts.append(" " * (begin[i] - 3 - at) + " | ")
                shown = lines[k] if k < len(lines) else ""
                parts.append(shown)
                at = begin[i] + _columns(shown)
            yield "".join(parts).rstrip()


def _short_reference(found: re.Match) -> str:
    """A reference without leading zeros, and with a number that stays small where it names no character."""
    base, digits = found[1], found[2]
    if not base and not digits[0].isdecimal():
        return found[0]
    end = re.compile("[0-9]+" if not base else ".+").match(digits).end()
    return f"&#{base}{digits[:end] if end < 8 else 'fffd' if base else 65533}{digits[end:]}"


def render(html: str | None) -> str:
    """All visible text of a page."""
    if not html:
        return ""
    builder = _Builder()
    builder.feed(_REFERENCE.sub(_short_reference, html) if "&#" in html else html)
    if _TAGS_IN_TEXTAREA and builder.cdata_elem == "textarea":  # not ended: the parser would drop its content
        builder.handle_data(builder.rawdata)
        builder.rawdata = ""
    builder.close()
    out = _Out()
    outs = [out]
    tables: list[list[list[tuple[list[str], int, int]] | None]] = []
    lists: list[list] = []
    indents: list[str] = []
    pre = flat = 0  # flat: open tables beyond the depth that is laid out
    stack: list[tuple[bool, Node | str]] = [(True, builder.root)]
    while stack:
        enters, node = stack.pop()
        if isinstance(node, str):
            out.text(node, pre > 0)
            continue
        tag = node.tag
        if enters:
            if not _visible(node):
                continue
            if tag == "br":
                out.line()
                continue
            if tag == "img":
                if node.attrs.get("alt"):
                    out.text(node.attrs["alt"], False)
                continue
            if tag == "select":
                shown, box = _options(node)
                for text in shown:
                    if box:
                        out.ask(1)
                    out.text(f" {text} ", False)
                if box:
                    out.ask(1)
                continue
            if tag in ("text", "textarea"):
                out.ask(1)
            if tag == "textarea":
                pre += 1
                held = "".join(c for c in node.children if isinstance(c, str)).removeprefix("\n")
                node.children = [unescape(held) if _TAGS_IN_TEXTAREA else held]
            if tag in ("td", "th") and flat:
                out.ask(1)
            elif tag in ("td", "th") and tables:
                out = _Out(out.room - len(out.indent))
                outs.append(out)
            elif tag in BLOCKS:
                inner = tag in ("ul", "ol") and lists
                out.ask(2 if tag in PARAGRAPHS and not inner else 1)
            if tag in ("ul", "ol", "menu"):
                lists.append([tag == "ol", _number(node, "start")])
            elif tag == "li":
                ordered, number = lists[-1] if lists else (False, 1)
                mark = f"{number}. " if ordered else "- "
                if lists:
                    lists[-1][1] += 1
                indents.append(out.item(mark))
            elif tag == "table":
                if flat or len(tables) == TABLES:
                    flat += 1
                else:
                    tables.append([])
            elif tag in ("tbody", "thead", "tfoot") and tables and not flat:
                tables[-1].append(None)
            elif tag == "tr" and tables and not flat:
                tables[-1].append([])
            elif tag == "pre":
                pre += 1
            elif tag == "hr":
                out.text("---", False)
                out.ask(2)
                continue
            stack.append((False, node))
            shown = node.children
            if tag == "details" and "open" not in node.attrs:
                shown = [c for c in shown if isinstance(c, Node) and c.tag == "summary"]
            stack.extend((True, c) for c in reversed(shown))
            continue
        if tag in ("td", "th") and flat:
            out.ask(1)
        elif tag in ("td", "th") and tables and len(outs) > 1:
            cell = [x for x in outs.pop().result().split("\n") if x]
            out = outs[-1]
            if not tables[-1] or tables[-1][-1] is None:
                tables[-1].append([])
            down = _number(node, "rowspan")
            tables[-1][-1].append((cell, max(1, min(_number(node, "colspan"), 1000)), max(1, down) if down else 65534))
        elif tag == "table" and flat:
            flat -= 1
        elif tag == "table":
            for line in _aligned(tables.pop()):
                out.ask(1)
                out.text(line, True)
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "li":
            if out.mark:  # an empty item still shows
                out._begin()
            out.indent = indents.pop()
        elif tag in ("pre", "textarea"):
            pre -= 1
        if tag in ("text", "textarea"):
            out.ask(1)
        if tag in BLOCKS:
            inner = tag in ("ul", "ol") and lists
            out.ask(2 if tag in PARAGRAPHS and not inner else 1)
    while len(outs) > 1:
        outs.pop()
    return outs[0].result()


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with a column ``text``."""
    kept = pages if html == "text" else pages.drop("text")
    at = kept.columns.index(html)
    schema = T.StructType([*(f for f in kept.schema.fields if f.name != "text"), T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                names = [n for n in part.schema.names if n != "text"]
                made = pa.array([render(h) for h in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), made], [*names, "text"])

    return kept.mapInArrow(work, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    return extract_text(pages).select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"))
