"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, and a renderer for blocks, lists and tables.

A page costs time in proportion to its length: the scanner never goes back, open elements are found by name, and elements are
rendered by a stack of generators, so that neither depth nor unclosed tags matter.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard, and its greatest colspan and rowspan.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INVISIBLE = frozenset(
    "head script style template noscript iframe object audio video canvas datalist noembed noframes title meta link base param source track area map rp annotation annotation-xml".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li listing main menu nav ol p plaintext pre search section summary table ul tr caption thead tbody tfoot option optgroup xmp".split()
)
APART = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 listing ol plaintext pre table ul menu dir hr xmp".split())
PRE = frozenset("pre listing xmp plaintext".split())
_CLOSES_P = BLOCK - frozenset("body html li dd dt option optgroup tr caption thead tbody tfoot legend summary".split())
_P_WALLS = frozenset("html table td th caption button object template marquee svg math".split())
_ROWS = frozenset("thead tbody tfoot".split())
_TABLE_PARTS = frozenset("table tr thead tbody tfoot td th body html".split())
#: A start tag ends open elements of these names, up to the nearest of the others.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
#: Parts of a drawing that show no text; its text stands in ``text`` and ``foreignobject``.
_UNDRAWN = frozenset("title desc metadata defs symbol clippath mask pattern marker".split())
_TYPED = frozenset("submit button reset text search tel url email number".split())
MOST_COLSPAN, MOST_ROWSPAN = 1000, 65534
#: Layout, which never drops text: columns that lists indent by at most, that a cell widens its column to at most, tables inside each other that are aligned,
#: and cells that reach down into one row, from the left, which it makes room for.
MOST_INDENT, CELL_WIDTH, ALIGNED_TABLES, MOST_SPANS = 64, 200, 8, 200
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTR_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE_VALUE = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_KEPT = frozenset("hidden type style start value open colspan rowspan reversed".split())
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def _rest_of_tag(page: str, at: int) -> tuple[int, dict[str, str]]:
    """Where the tag ends whose name ends at ``at``, and the attributes that matter; -1 if the page ends inside it. A quote that stays open ends with the tag, at the next ``>``."""
    attrs: dict[str, str] = {}
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return -1, attrs
        if page[at] == ">":
            return at + 1, attrs
        m = _ATTR_NAME.match(page, at)
        name, value, at = m[0].lower(), "", m.end()
        if m := _EQUALS.match(page, at):
            at = m.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return page.find(">", at) + 1 or -1, attrs
                value, at = page[at + 1 : end], end + 1
            else:
                m = _BARE_VALUE.match(page, at)
                value, at = m[0], m.end()
        if name in _KEPT and name not in attrs:
            attrs[name] = html.unescape(value)


class _Open:
    """The open elements, and where those of each name stand among them."""

    def __init__(self) -> None:
        self.stack = [Node("#root")]
        self.at: dict[str, list[int]] = {}

    def push(self, n: Node) -> None:
        self.at.setdefault(n.tag, []).append(len(self.stack))
        self.stack.append(n)

    def pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            self.at[self.stack.pop().tag].pop()

    def nearest(self, names: Iterable[str]) -> int:
        return max((a[-1] for t in names if (a := self.at.get(t))), default=0)

    def close(self, names: Iterable[str], walls: Iterable[str]) -> None:
        """Ends all open elements of ``names`` that no element of ``walls`` stands above."""
        while (i := self.nearest(names)) > self.nearest(walls):
            self.pop_to(i)


def tree(page: str) -> Node:
    """The page's elements. Unknown end tags are passed over; elements left open end with their parents; a tag that the page ends in is none."""
    o, at, end = _Open(), 0, len(page)
    root, skip_newline = o.stack[0], False

    def add(text: str) -> None:
        nonlocal skip_newline
        if skip_newline and text:  # the first after <pre>
            text = text[2:] if text[:2] == "\r\n" else text[1:] if text[0] == "\n" else text
        skip_newline = False
        if text:
            o.stack[-1].children.append(html.unescape(text) if "&" in text else text)

    while at < end:
        i = page.find("<", at)
        if i < 0:
            add(page[at:])
            break
        if i > at:
            add(page[at:i])
        after = page[i + 1 : i + 2]
        closing = after == "/"
        m = _NAME.match(page, i + 1 + closing)
        if m is None:
            if page.startswith("<!--", i):
                short = next((k for k in (">", "->") if page.startswith(k, i + 4)), None)
                stop = _COMMENT_END.search(page, i + 4)
                at = i + 4 + len(short) if short else stop.end() if stop else end
            elif after in ("!", "?") and after or closing and i + 2 < end:
                at = page.find(">", i) + 1 or end
            else:
                add("</" if closing else "<")
                at = i + 1 + closing
            continue
        skip_newline = False
        tag = m[0].lower()
        at, attrs = _rest_of_tag(page, m.end())
        if at < 0:
            break
        if closing:
            if tag == "br":
                o.stack[-1].children.append(Node("br"))
            elif tag == "p" and not o.at.get("p"):
                o.stack[-1].children.append(Node("p"))
            else:
                i = o.nearest((tag,))
                if i > o.nearest({"table"} - {tag} if tag in _TABLE_PARTS else ("table", "td", "th")):
                    o.pop_to(i)
            continue
        if tag in _CLOSES_P:
            o.close(("p",), _P_WALLS)
        if tag in _ENDS:
            o.close(*_ENDS[tag])
        if tag in ("td", "th") and (o.stack[-1].tag == "table" or o.stack[-1].tag in _ROWS):
            row = Node("tr")
            o.stack[-1].children.append(row)
            o.push(row)
        node = Node(tag, attrs)
        o.stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = None if tag == "plaintext" else _RAW_END[tag].search(page, at)
            body = page[at : stop.start() if stop else end]
            if tag in ("textarea", "xmp", "plaintext"):
                node.children.append(html.unescape(body) if tag == "textarea" else body)
            at = _rest_of_tag(page, stop.end())[0] if stop else end
            if at < 0:
                break
            continue
        o.push(node)
        skip_newline = tag in ("pre", "listing")
    return root


def shown(n: Node, inherited: bool) -> bool | None:
    """Whether text in the element shows: None if it takes no place at all, else its visibility, which its own elements inherit and may change."""
    a, display, visibility = n.attrs, "", ""
    if style := a.get("style"):
        for rule in style.lower().split(";"):
            name, _, value = rule.partition(":")
            name, value = name.strip(), value.replace("!important", "").strip()
            if name == "display":
                display = value
            elif name == "visibility":
                visibility = value
    if n.tag in INVISIBLE or display == "none" or (not display and ("hidden" in a or (n.tag == "dialog" and "open" not in a))):
        return None
    if n.tag == "input" and a.get("type", "").strip().lower() == "hidden":
        return None
    return False if visibility in ("hidden", "collapse") else True if visibility in ("visible", "initial") else inherited


class _Lines:
    """Finished lines, and the line being written. ``gap``: blank lines owed before the next one."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.mark = ""

    def word(self, text: str) -> None:
        text = _SPACES.sub(" ", text)
        if text[:1] == " " and (not self.line or self.line[-1][-1:] == " "):
            text = text[1:]
        if text:
            self.line.append(text)

    def end(self, gap: int = 0) -> None:
        """Ends the line; the next one stands ``gap`` blank lines below."""
        text = "".join(self.line).strip(" ")
        self.line = []
        if text:
            self._owed()
            self.out.append(self.mark + text)
            self.mark = " " * len(self.mark)
        if self.out:
            self.gap = max(self.gap, gap)

    def end_pre(self, last: bool = False) -> None:
        """Ends a line of preformatted text: its spaces stay, and so do empty lines inside."""
        text = "".join(self.line)
        self.line = []
        if last and not text.strip():
            return
        if text.strip() or self.out:
            self._owed()
            self.out.append((self.mark + text).rstrip())

    def add(self, lines: list[str], indent: str) -> None:
        for x in lines:
            self._owed()
            self.out.append(indent + x if x else x)

    def _owed(self) -> None:
        if self.gap and self.out:
            self.out.extend([""] * self.gap)
        self.gap = 0


@dataclass(frozen=True, slots=True)
class _Place:
    """What an element is rendered in. ``drawing``: text shows only where a drawing says so; ``tables``: around it."""

    indent: str = ""
    pre: bool = False
    shown: bool = True
    drawing: bool = False
    tables: int = 0


_Steps = Iterator["_Steps"]


def _run(steps: _Steps) -> None:
    """Runs a generator, and those that it yields, each to its end before the one that yielded it goes on."""
    stack = [steps]
    while stack:
        if (more := next(stack[-1], None)) is None:
            stack.pop()
        else:
            stack.append(more)


def _children(children: list, o: _Lines, p: _Place) -> _Steps:
    for c in children:
        if not isinstance(c, str):
            yield _element(c, o, p)
        elif p.shown and not p.drawing:
            if p.pre:
                first, *rest = c.split("\n")
                o.line.append(first.rstrip("\r"))
                for x in rest:
                    o.end_pre()
                    o.line.append(x.rstrip("\r"))
            else:
                o.word(c)


def _element(c: Node, o: _Lines, p: _Place) -> _Steps:
    now = shown(c, p.shown)
    t = c.tag
    if now is None or (p.drawing and t in _UNDRAWN):
        return
    if now != p.shown:
        p = replace(p, shown=now)
    if t == "svg":
        yield _children(c.children, o, replace(p, drawing=True))
    elif p.drawing:
        if t in ("text", "foreignobject"):
            o.word(" ")
            yield _children(c.children, o, replace(p, drawing=False))
            o.word(" ")
        else:
            yield _children(c.children, o, p)
    elif t == "br":
        o.end_pre() if p.pre else o.end()
    elif t == "hr":
        o.end(1)
    elif t == "table" and p.tables < ALIGNED_TABLES:
        o.end(1)
        lines: list[str] = []
        yield _table(c, lines, replace(p, indent="", pre=False, tables=p.tables + 1))
        o.add(lines, p.indent)
        o.end(1)
    elif t in ("ul", "ol", "menu", "dir"):
        gap = 0 if p.indent else 1
        o.end(gap)
        yield _list(c, o, p)
        o.end(gap)
    elif t in BLOCK:
        gap, pre = 1 if t in APART else 0, p.pre or t in PRE
        o.end(gap)
        children = c.children
        if t == "details" and "open" not in c.attrs:
            children = [x for x in children if isinstance(x, Node) and x.tag == "summary"][:1]
        if t == "dd":
            keep, o.mark = o.mark, (o.mark + "  ")[: max(MOST_INDENT, len(o.mark))]
            yield _children(children, o, replace(p, indent=(p.indent + "  ")[:MOST_INDENT]))
            o.end()
            o.mark = keep
        else:
            yield _children(children, o, replace(p, pre=pre) if pre != p.pre else p)
            if pre:
                o.end_pre(True)
            o.end(gap)
    elif t in ("td", "th"):
        yield _children(c.children, o, p)
        if o.line:
            o.word(" ")
    elif t == "input":
        if p.shown and c.attrs.get("type", "text").strip().lower() in _TYPED:
            o.word(c.attrs.get("value", ""))
    else:
        yield _children(c.children, o, p)


def _number(attrs: dict[str, str], name: str) -> int | None:
    text = attrs.get(name, "").strip()
    return int(text) if re.fullmatch(r"-?\d{1,9}", text) else None


def _list(n: Node, o: _Lines, p: _Place) -> _Steps:
    step = -1 if "reversed" in n.attrs else 1
    at = _number(n.attrs, "start")
    if at is None:
        at = sum(isinstance(c, Node) and c.tag == "li" for c in n.children) if step < 0 else 1
    for c in n.children:
        if isinstance(c, str) or c.tag != "li":
            yield _children([c], o, p)
            continue
        now = shown(c, p.shown)
        if now is None:
            continue
        if (value := _number(c.attrs, "value")) is not None:
            at = value
        mark = f"{at}. " if n.tag == "ol" else "- "
        at += step
        o.end()
        keep, o.mark = o.mark, p.indent + (mark if now else " " * len(mark))
        yield _children(c.children, o, replace(p, indent=(p.indent + " " * len(mark))[:MOST_INDENT], shown=now))
        o.end()
        o.mark = keep


def _rows(n: Node, inherited: bool) -> Iterator[tuple[int, Node, bool]]:
    """Rows that are laid out, each with the number of its row group; rows outside of groups make one between two groups."""
    group = 0
    for c in n.children:
        if not isinstance(c, Node) or c.tag != "tr" and c.tag not in _ROWS:
            continue
        group += c.tag != "tr"
        now = shown(c, inherited)
        if now is not None and c.tag == "tr":
            yield group, c, now
        elif now is not None:
            for r in c.children:
                if isinstance(r, Node) and r.tag == "tr" and (row := shown(r, now)) is not None:
                    yield group, r, row
        group += c.tag != "tr"


def _across(attrs: dict[str, str]) -> int:
    return min(max(_number(attrs, "colspan") or 1, 1), MOST_COLSPAN)


def _last_row(attrs: dict[str, str], y: int) -> float:
    """The last row that a cell of row ``y`` covers; 0 is as many as its row group has."""
    down = _number(attrs, "rowspan")
    return math.inf if down == 0 else y + min(max(down or 1, 1), MOST_ROWSPAN) - 1


def _table(n: Node, out: list[str], p: _Place) -> _Steps:
    """Cells of a column stand below each other, two spaces apart; a cell's own lines keep their column. Text outside rows comes first.

    Cells take the columns that are free, beside those that reach down from rows above in their row group. Rows that aren't laid out don't count.
    """
    o = _Lines()
    loose = [c for c in n.children if isinstance(c, str) or not (c.tag == "tr" or c.tag in _ROWS)]
    loose += [x for c in n.children if isinstance(c, Node) and c.tag in _ROWS and shown(c, p.shown) is not None for x in c.children if isinstance(x, str) or x.tag != "tr"]
    yield _children(loose, o, p)
    o.end()
    out.extend(o.out)
    rows: list[dict[int, list[str]]] = []
    width: dict[int, int] = {}
    spans: list[tuple[int, int, float]] = []  # of cells that reach down: first column, the one after it, last row
    group = None
    for y, (g, r, row_shown) in enumerate(_rows(n, p.shown)):
        spans = [s for s in spans if s[2] >= y] if g == group else []
        group, down, k, at = g, [], 0, 0
        cells: dict[int, list[str]] = {}
        for c in r.children:
            is_cell = isinstance(c, Node) and c.tag in ("td", "th")
            now = shown(c, row_shown) if is_cell else row_shown
            if now is None:
                continue
            box = _Lines()
            yield _children(c.children if is_cell else [c], box, replace(p, shown=now))
            box.end()
            if not is_cell and not box.out:
                continue
            while k < len(spans) and spans[k][0] <= at:
                at = max(at, spans[k][1])
                k += 1
            if box.out:
                cells[at] = box.out
                width[at] = max(width.get(at, 0), *(min(len(x), CELL_WIDTH) for x in box.out))
            end = at + (_across(c.attrs) if is_cell else 1)
            if is_cell and (last := _last_row(c.attrs, y)) > y:
                down.append((at, end, last))
            at = end
        if down:
            spans = sorted(spans + down)[:MOST_SPANS]
        if cells:
            rows.append(cells)
    start, x = {}, 0
    for col in sorted(width):
        start[col] = x
        x += width[col] + 2
    for cells in rows:
        order = sorted(cells)
        for k in range(max(map(len, cells.values()))):
            parts, size = [], 0
            for col in order:
                if k < len(cells[col]) and cells[col][k]:
                    pad = " " * (start[col] - size) if start[col] >= size else "  "
                    parts += [pad, cells[col][k]]
                    size += len(pad) + len(cells[col][k])
            out.append("".join(parts).rstrip())


def render(page: str | None) -> str:
    """All visible text. Null and empty pages give an empty text."""
    if not page:
        return ""
    o = _Lines()
    _run(_children(tree(page).children, o, _Place()))
    o.end()
    return "\n".join(o.out)


def extract(pages: DataFrame, *, page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the rendered text in place of the HTML.

    Each page is rendered for itself, whole; null pages give an empty text, other columns may hold anything and
    stay, a column named as ``out`` is replaced. Rows that repeat give rows that repeat.
    """
    rest = [c for c in pages.columns if c not in (page, out)]
    rows = pages.select(*[F.col(c) for c in rest], F.col(page).alias("_page"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [render(x) for x in b.pop("_page")]
            b[out] = texts
            yield b

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_page"]
    return rows.mapInPandas(run, ", ".join([*kept, f"`{out}` string"]))


def op10(pages: DataFrame) -> DataFrame:
    got = extract(pages.select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))
