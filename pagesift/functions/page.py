"""What a page says by itself, read off its node table in the worker.

The rules ask a page a fixed number of questions, most of them about a few
nodes.  Asked here, next to the parser, only the answers leave the Python
worker; the nodes of every page as a column, with interpreted expressions over
them, took several times as long as the parsing.  Each question costs at most
one pass over the page: subtrees are intervals of the node table, their texts
cuts of the joined stripped texts.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .dates import date_in_text, read_date
from .shred import ANCHOR, DOCUMENT, PlainPage, byte_slices, element_node, shred_one, string_node
from .urls import join_url

# The column of links as Spark and Arrow name it.
LINKS = ("array<struct<text:string,url:string,context:string>>",
         pa.list_(pa.struct([(x, pa.string()) for x in ("text", "url", "context")])))

BLOCK_TAGS = frozenset(("div", "section", "article"))
_EMPTY_LINES = re.compile(r"\n\s*\n\s*\n+")
_BLANKS = re.compile("[ \t]+")


class Page:
    """The nodes of a page in short (see ``shred.py``) with the first place of
    every tag, ``.class``, ``#id`` and ``tag[attr]``, the anchors, JSON-LD scripts
    and stripped texts; ``upto`` counts the texts before each node."""

    __slots__ = ("nodes", "end", "parent", "first", "anchors", "scripts", "upto", "texts", "chars")

    def __init__(self, table):
        self.end, self.parent = table.end, table.parent
        if type(table) is PlainPage:
            self.nodes, self.first, self.anchors, self.scripts, self.upto = table.nodes, table.first, table.anchors, table.scripts, table.upto
            pieces = table.pieces
        else:
            pieces = self._look(table)
        self.texts, self.chars = "".join(pieces), [*accumulate(map(len, pieces), initial=0)]

    def _look(self, table) -> list[str]:
        self.nodes, self.first, self.anchors, self.scripts, self.upto = nodes, first, anchors, scripts, upto = [], {}, [], [], []
        pieces = []
        for pos, (kind, tag, attrs, text) in enumerate(zip(table.kind, table.tag, table.attrs, table.text)):
            upto.append(len(pieces))
            if kind == "t":
                pieces.append(text.strip())
                nodes.append(text)
            elif kind != "e":
                nodes.append(string_node(kind, text))
            elif not pos:
                nodes.append(DOCUMENT)
            else:
                node = element_node(tag, attrs)
                nodes.append(node)
                for k in node[3]:
                    first.setdefault(k, pos)
                if node[5]:
                    (anchors if node[5] == ANCHOR else scripts).append(pos)
        upto.append(len(pieces))
        return pieces

    def span(self, n: int) -> tuple[int, int]:
        """Where the stripped text of a subtree stands in ``texts``."""
        return self.chars[self.upto[n]], self.chars[self.upto[self.end[n] + 1]]

    def stripped(self, n: int) -> str:
        return self.texts[self.chars[self.upto[n]]:self.chars[self.upto[self.end[n] + 1]]]


def ask_pages(df: DataFrame, ask, fields: dict, base: str = "url", html: str = "html") -> DataFrame:
    """Replace the ``html`` column of ``df`` by what ``ask(page, base url)`` says
    of each page: the columns ``fields`` (name -> Spark type, Arrow type), and
    ``parse_error`` for a page that the tokenizer rejects, which like a missing
    page is not asked.

    A ``mapInArrow`` node: filters on what it returns are not pushed below it.
    Put filters on page columns before it (they then reach the scan)."""
    keep = [f for f in df.schema.fields if f.name != html]
    names = [f.name for f in keep]
    added = ", ".join(f"{name} {kind}" for name, (kind, _) in fields.items())
    schema = T.StructType(keep + T._parse_datatype_string(f"{added}, parse_error string").fields)
    types, nothing = [kind for _, kind in fields.values()], (None,) * len(fields)

    def run(batches):
        for b in byte_slices(batches, html):
            rows, errors = [], []
            for page, url in zip(b.column(html).to_pylist(), b.column(base).to_pylist()):
                table, error = shred_one(page)
                rows.append(nothing if table is None else ask(Page(table), url))
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in names] + [pa.array(v, t) for v, t in zip(zip(*rows), types)] + [pa.array(errors, pa.string())],
                names=schema.fieldNames())
    return df.mapInArrow(run, schema)


def title_texts(page: Page, selectors: list[str]) -> list[tuple[str, str]]:
    """The first selector whose element's stripped text is longer than 5,
    and that text."""
    for selector in selectors:
        n = page.first.get(selector)
        if n is not None:
            text = page.stripped(n)
            if len(text) > 5:
                return [(selector, text)]
    return []


def largest_block(page: Page, min_chars: int = 100) -> int | None:
    """The div/section/article with the longest stripped text (earliest
    wins ties, so an outer block beats an equal inner one), if > min_chars."""
    best, most = None, min_chars
    for n, node in enumerate(page.nodes):
        if type(node) is tuple and node[1] in BLOCK_TAGS:
            a, z = page.span(n)
            if z - a > most:
                best, most = n, z - a
    return best


def content_area(page: Page, selectors: list[str]) -> int | None:
    """First hit of the content selectors, else the largest text block."""
    for selector in selectors:
        n = page.first.get(selector)
        if n is not None:
            return n
    return largest_block(page)


def formatted_text(page: Page, n: int) -> str:
    """Walk the descendants without script/style; p/div/br start a line,
    headings a paragraph; every string node, comments included, is kept;
    3+ line breaks become 2, blank runs one blank; stripped."""
    text = "".join([x if type(x) is str else x[4] for x in page.nodes[n + 1:page.end[n] + 1]])
    if text.count("\n") > 2:
        text = _EMPTY_LINES.sub("\n\n", text)
    if "  " in text or "\t" in text:
        text = _BLANKS.sub(" ", text)
    return text.strip()


def embedded_links(page: Page, scope: int, base: str | None) -> list[tuple[str, str, str]]:
    """(text, url, context) of every ``a[href]`` under ``scope``;
    empty and ``#...`` hrefs skipped, resolved against the page URL (a malformed
    host drops the link), text falls back to the href; not deduplicated, no
    host test.  The context is the parent's stripped text, cut at 200 with an
    ellipsis."""
    found, last = [], page.end[scope]
    for n in page.anchors:
        if scope < n <= last:
            href = page.nodes[n][2]["href"].strip()
            if href and href[0] != "#":
                url = join_url(base, href)
                if url is not None:
                    a, z = page.span(page.parent[n])
                    context = page.texts[a:z] if z - a <= 200 else page.texts[a:a + 200] + "..."
                    found.append((page.stripped(n) or href, url, context))
    return found


# -- publication date (E7-E11) --------------------------------------------------
def _finite(digits: str) -> float:
    x = float(digits)
    if x in (_INFINITY, -_INFINITY):
        raise ValueError("no number of JSON")
    return x


def _short(digits: str) -> int:
    if len(digits) > MOST_DEEP:
        raise ValueError("number too long")
    return int(digits)


# What a strict reader takes in, nesting and digits.
MOST_DEEP = 1000
_INFINITY = float("inf")
_READER = json.JSONDecoder(parse_constant=lambda _: 1.5, parse_float=_finite, parse_int=_short)


def _too_deep(value) -> bool:
    level = [value]
    for _ in range(MOST_DEEP + 1):
        level = [x for x in level if isinstance(x, (dict, list))]
        if not level:
            return False
        level = [y for x in level for y in (x.values() if isinstance(x, dict) else x)]
    return True


def _type_name(v) -> str:
    """Python type name; integers beyond 64 bits are read as decimals."""
    if type(v) is int and not -1 << 63 <= v < 1 << 63:
        return "float"
    return type(v).__name__


def _ld_outcome(text: str | None, fields: list[str]):
    """(date, error) of one JSON-LD script, or None to go on."""
    if text is None:
        return None, "the JSON object must be str, bytes or bytearray, not NoneType"
    try:
        v = _READER.decode(text)
    except (ValueError, RecursionError):
        return None
    if text.count("[") + text.count("{") > MOST_DEEP and _too_deep(v):
        return None
    if isinstance(v, dict):
        for f in fields:
            x = v.get(f)
            if x:
                if not isinstance(x, str):
                    return None, f"'{_type_name(x)}' object has no attribute 'strip'"
                date = read_date(x)
                if date is not None:
                    return date, None
        return None
    if isinstance(v, list):
        return (None, "list indices must be integers or slices, not str") if any(f in v for f in fields) else None
    if isinstance(v, str):
        return (None, "string indices must be integers, not 'str'") if any(f in v for f in fields) else None
    return None, f"argument of type '{_type_name(v)}' is not iterable"


def _string(node) -> str | None:
    return node if type(node) is str else node[6]


def jsonld_date(page: Page, fields: list[str]):
    """JSON-LD scripts in order; fields in order; first parsable date.

    Returns ``(date, error)``: a script without text, or a non-string date
    value, raises in the reference and fails the page (quirk Q10).  Of repeated
    keys the last counts, and ``NaN`` is a number."""
    for n in page.scripts:
        outcome = _ld_outcome(_string(page.nodes[n + 1]) if page.end[n] == n + 1 else None, fields)
        if outcome is not None:
            return outcome
    return None, None


def time_element_date(page: Page):
    """First ``time[datetime]`` whose attribute parses."""
    n = page.first.get("time[datetime]")
    if n is None:
        return None
    for node in page.nodes[n:]:
        if type(node) is tuple and node[1] == "time" and "datetime" in node[2]:
            date = read_date(node[2]["datetime"])
            if date is not None:
                return date
    return None


def selector_date(page: Page, selectors: list[str]):
    """The first element of each date selector: its ``datetime``
    attribute, else its stripped text."""
    for selector in selectors:
        n = page.first.get(selector)
        if n is not None:
            date = read_date(page.nodes[n][2].get("datetime")) or read_date(page.stripped(n))
            if date is not None:
                return date
    return None


def text_date(page: Page, month_names: bool = False):
    """Dates in the whole document text."""
    return date_in_text("".join([x for x in page.nodes if type(x) is str]), month_names)
