"""HTML page -> ``dom`` array column (the one Python step of the hot path).

Each page becomes ``dom``, an array of nodes in document order.  ``pos`` is the
node's own index, ``end`` the index of its last descendant (pre-order interval
encoding), ``parent`` the index of the enclosing element; index 0 is the
document itself.  Three indexes made on the way keep questions about subtrees
and selectors from scanning the array:

* ``texts``: the stripped plain texts of the page, joined, as UTF-8; every node
  carries how many characters (``chars``) and bytes (``bytes``) of it, how many
  ``a`` (``anchors``) and how many ``a[href]`` (``hrefs``) come up to itself, so
  the text of a subtree is one cut and its length or number of links the
  difference of two entries;
* ``first``: tag, ``.class``, ``#id`` and ``tag[attr]`` -> first position.

After this every tree question (first match of a selector, descendants, parent,
siblings, text of a subtree) is a Catalyst expression over these columns, see
``functions/dom.py``.

Tokenising is Python's stdlib ``html.parser``; the tree rules are those of
the lenient ``html.parser`` tree builder used by the reference:

* no implied end tags: ``<p>a<p>b`` nests the second ``p`` in the first;
* an end tag closes the nearest open element of that name and everything
  opened after it; an end tag with no open element of its name is ignored;
* void elements (``br``, ``img`` ...) close at once, and a later explicit end
  tag of the same name is swallowed; ``<x/>`` closes ``x`` at once;
* text made only of ASCII blanks becomes one ``\\n`` (if it has one) or one
  blank, except inside ``pre``/``textarea``;
* entities are decoded, tag and attribute names lowercased, the last of
  duplicated attributes wins, an attribute without value is ``''``.

Node kinds: ``e`` element, ``t`` text, ``c`` comment, ``s`` text of a
``script``/``style``, ``x`` other special text (``template``, ``rt``, ``rp``),
``d`` doctype / declaration / processing instruction.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the tree builder (html.parser builder defaults).
VOID_TAGS = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid",
    "spacer",
))
STRING_CONTAINER_TAGS = frozenset(("script", "style", "template", "rt", "rp"))
PRESERVE_WS_TAGS = frozenset(("pre", "textarea"))
ASCII_BLANKS = " \n\t\f\r"
CDATA = "#cdata"       # tag of a text node that was a CDATA section
LD_JSON = "application/ld+json"

NODE_TYPE = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
    *(T.StructField(c, T.IntegerType()) for c in ("chars", "bytes", "anchors", "hrefs")),
])
DOM_TYPE = T.ArrayType(NODE_TYPE)
PAGE_FIELDS = [T.StructField("dom", DOM_TYPE), T.StructField("texts", T.BinaryType()),
               T.StructField("first", T.MapType(T.StringType(), T.IntegerType())),
               T.StructField("ld_json", T.ArrayType(T.StringType())), T.StructField("parse_error", T.StringType())]

_ARROW_NODE = pa.struct([
    ("pos", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()),
    ("kind", pa.string()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
    *((c, pa.int32()) for c in ("chars", "bytes", "anchors", "hrefs")),
])


# Plain tags, which need none of the tokenizer's leniency.  Elements whose
# content is not markup are left to it, as is everything unusual.
PLAIN_START = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z-]*="[^"&<>]*")*)>')
PLAIN_ATTRIBUTE = re.compile(r' ([a-zA-Z-]+)="([^"]*)"')
PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
PLAIN = re.compile(r'([^<&]+)|<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z-]*="[^"&<>]*")*)>|</([a-zA-Z][a-zA-Z0-9]*)>')
PLAIN_CONTENT = re.compile(r"([^<&]*)</([a-zA-Z]+)>")      # of an opaque element
OPAQUE_TAGS = frozenset(("script", "style", "textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript"))
CLOSED_TAGS = frozenset(("script", "style", "textarea", "title"))


class _TreeBuilder(HTMLParser):
    """Collects the node table of one page; columns are kept as lists."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.end = [0]
        self.parent = [-1]
        self.kind = ["e"]
        self.tag = ["#document"]
        self.attrs = [None]
        self.text = [None]
        self.stack = [0]               # positions of open elements
        self.open_names = {}           # tag name -> number open
        self.containers = []           # open string-container tags
        self.swallow_end = []          # void tags whose end tag is ignored
        self.buf = []
        self.index = None              # see page_index

    # -- tokens -------------------------------------------------------
    def feed_plain(self, page):
        """Take in the page up to the first place that needs the tokenizer's
        rules; returns that place."""
        at, n, match = 0, len(page), PLAIN.match
        while at < n:
            m = match(page, at)
            if m is None:
                break
            text, start, attrs, end = m.groups()
            if text is not None:
                self.buf.append(text)
            elif end is not None:
                self._flush()
                self._end(end.lower())
            else:
                tag = start.lower()
                content = None
                if tag in OPAQUE_TAGS:
                    content = PLAIN_CONTENT.match(page, m.end())
                    if tag not in CLOSED_TAGS or content is None or content[2].lower() != tag:
                        break
                self._start(tag, [(k.lower(), v) for k, v in PLAIN_ATTRIBUTE.findall(attrs)] if attrs else (), False)
                if content is not None:
                    if content[1]:
                        self.buf.append(content[1])
                    self._flush()
                    self._end(tag)
                    m = content
            at = m.end()
        return at

    def parse_starttag(self, i):
        m = PLAIN_START.match(self.rawdata, i)
        if m is None:
            return super().parse_starttag(i)
        tag = m[1].lower()
        if tag in OPAQUE_TAGS:
            return super().parse_starttag(i)
        self._start(tag, [(k.lower(), v) for k, v in PLAIN_ATTRIBUTE.findall(m[2])] if m[2] else (), False)
        return m.end()

    def parse_endtag(self, i):
        m = None if self.cdata_elem else PLAIN_END.match(self.rawdata, i)
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def updatepos(self, i, j):
        return j                       # nothing asks for line numbers

    # -- text ---------------------------------------------------------
    def _add(self, kind, tag, attrs, text):
        pos = len(self.kind)
        self.end.append(pos)
        self.parent.append(self.stack[-1])
        self.kind.append(kind)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        return pos

    def _flush(self, kind=None, tag=None):
        if not self.buf:
            return
        data = "".join(self.buf)
        self.buf = []
        if not data.strip(ASCII_BLANKS) and not any(
                self.open_names.get(t) for t in PRESERVE_WS_TAGS):
            data = "\n" if "\n" in data else " "
        if kind is None:
            if self.containers:
                kind = "s" if self.containers[-1] in ("script", "style") else "x"
            else:
                kind = "t"
        self._add(kind, tag, None, data)

    def handle_data(self, data):
        self.buf.append(data)

    def handle_comment(self, data):
        self._flush()
        self.buf.append(data)
        self._flush("c")

    def handle_decl(self, data):
        self._flush()
        self.buf.append(data[8:] if data.startswith("DOCTYPE ") else data)
        self._flush("d")

    def handle_pi(self, data):
        self._flush()
        self.buf.append(data)
        self._flush("d")

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self.buf.append(data[6:])
            self._flush("t", CDATA)
        else:
            self.buf.append(data)
            self._flush("d")

    # -- tags ---------------------------------------------------------
    def _pop(self):
        pos = self.stack.pop()
        name = self.tag[pos]
        self.end[pos] = len(self.kind) - 1
        self.open_names[name] -= 1
        if name in STRING_CONTAINER_TAGS and self.containers:
            self.containers.pop()

    def _start(self, name, attrs, self_closing):
        self._flush()
        amap = {}
        for k, v in attrs:
            amap[k] = "" if v is None else v
        pos = self._add("e", name, amap, None)
        self.stack.append(pos)
        self.open_names[name] = self.open_names.get(name, 0) + 1
        if name in STRING_CONTAINER_TAGS:
            self.containers.append(name)
        if self_closing:
            self._end(name, check_swallow=True)
        elif name in VOID_TAGS:
            self._end(name, check_swallow=False)
            self.swallow_end.append(name)

    def _end(self, name, check_swallow=True):
        if check_swallow and name in self.swallow_end:
            self.swallow_end.remove(name)
            return
        if not self.open_names.get(name):
            return
        while len(self.stack) > 1:
            top = self.tag[self.stack[-1]]
            self._pop()
            if top == name:
                break

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs, True)

    def handle_endtag(self, tag):
        self._flush()
        self._end(tag)

    def finish(self):
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._pop()
        self.end[0] = len(self.kind) - 1


# A node in short: a plain text is its string, anything else a tuple of sort,
# name (kind, if it is a string), attributes, keys (see ``node_keys``), what it
# adds to a formatted text, mark and text.
ORDINARY, VOID, SPECIAL, CLOSING, STRING = range(5)
ANCHOR, SCRIPT = 1, 2
LINE_BREAKS = {**dict.fromkeys(("p", "div", "br"), "\n"), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "\n\n")}
_KEEPING = frozenset((*CLOSED_TAGS, *STRING_CONTAINER_TAGS, *PRESERVE_WS_TAGS))
DOCUMENT = ORDINARY, "#document", None, (), "", 0, None


def node_keys(tag: str, attrs: dict) -> tuple:
    """Tag, ``tag[attr]``, ``.class`` and ``#id``: how an element is found."""
    if not attrs:
        return (tag,)
    keys = [tag, *(f"{tag}[{k}]" for k in attrs), *("." + c for c in attrs.get("class", "").split())]
    return (*keys, "#" + attrs["id"]) if "id" in attrs else tuple(keys)


def element_node(tag: str, attrs: dict, sort: int = ORDINARY) -> tuple:
    mark = ANCHOR if tag == "a" and "href" in attrs else SCRIPT if tag == "script" and attrs.get("type") == LD_JSON else 0
    return sort, tag, attrs, node_keys(tag, attrs), LINE_BREAKS.get(tag, ""), mark, None


def string_node(kind: str, text: str) -> tuple:
    """A string that is no plain text; those of scripts and styles are not shown."""
    return STRING, kind, None, (), "" if kind == "s" else text, 0, text


class PlainPage:
    """The node table of a page all of whose tags are plain, and what
    ``functions/page.py`` asks first, taken down on the way; the columns of the
    table are spread out when they are asked for."""

    __slots__ = ("nodes", "end", "parent", "first", "anchors", "scripts", "pieces", "upto",
                 "kind", "tag", "attrs", "text", "index")

    def __getattr__(self, name):
        if name == "index":
            return None
        self.kind = ["t" if type(x) is str else x[1] if x[0] == STRING else "e" for x in self.nodes]
        self.tag = [None if k != "e" else x[1] for k, x in zip(self.kind, self.nodes)]
        self.attrs = [None if k != "e" else x[2] for k, x in zip(self.kind, self.nodes)]
        self.text = [x if type(x) is str else x[6] for x in self.nodes]
        return object.__getattribute__(self, name)


KNOWN_TAGS: dict[str, tuple] = {}      # what stands between < and > -> its node
MOST_KNOWN = 4096
_LINK = re.compile('a href="([^"&<>]*)"')


def _plain_tag(source: str):
    """The node of a plain tag, None if it is not plain or its content is no
    markup that ends at its own end tag."""
    m = _LINK.fullmatch(source)
    if m is not None:                  # hardly two links are the same
        return ORDINARY, "a", {"href": m[1]}, ("a", "a[href]"), "", ANCHOR, None
    if source[:1] == "/":
        m = PLAIN_END.fullmatch(f"<{source}>")
        found = m and (CLOSING, m[1].lower())
    else:
        m = PLAIN_START.fullmatch(f"<{source}>")
        name = m and m[1].lower()
        if m is None or name in OPAQUE_TAGS and name not in CLOSED_TAGS:
            return None
        attrs = {k.lower(): v for k, v in PLAIN_ATTRIBUTE.findall(m[2])} if m[2] else {}
        found = element_node(name, attrs, VOID if name in VOID_TAGS else SPECIAL if name in _KEEPING else ORDINARY)
        if found[5] == ANCHOR:
            return found
    if found is not None:
        if len(KNOWN_TAGS) >= MOST_KNOWN:
            KNOWN_TAGS.clear()
        KNOWN_TAGS[source] = found
    return found


def plain_page(page: str) -> PlainPage | None:
    """The node table of a page whose tags are all plain and whose texts hold
    no entity, by the rules of ``_TreeBuilder``; None for any other page."""
    if "&" in page:
        return None
    nodes, end, parent, upto = [DOCUMENT], [0], [-1], [0]
    first, anchors, scripts, pieces = {}, [], [], []
    stack, count, containers, swallow = [0], {}, [], []
    top, n, seen, kept, opaque = 0, 1, 0, 0, None
    known = KNOWN_TAGS.get
    markup = page.split("<")
    data, markup[0] = markup[0], None
    for piece in markup:
        if piece is not None:
            source, mark, data = piece.partition(">")
            if not mark:
                return None
            found = known(source) or _plain_tag(source)
            if found is None:
                return None
            sort, name = found[0], found[1]
            if sort != CLOSING:
                if opaque is not None:
                    return None
                nodes.append(found)
                end.append(n)
                parent.append(top)
                upto.append(seen)
                for k in found[3]:
                    if k not in first:
                        first[k] = n
                if found[5]:
                    (anchors if found[5] == ANCHOR else scripts).append(n)
                if sort == VOID:
                    swallow.append(name)
                else:
                    stack.append(n)
                    count[name] = count.get(name, 0) + 1
                    top = n
                    if sort == SPECIAL:
                        if name in STRING_CONTAINER_TAGS:
                            containers.append(name)
                        if name in PRESERVE_WS_TAGS:
                            kept += 1
                        if name in CLOSED_TAGS:
                            opaque = name
                n += 1
            else:
                if opaque is not None:
                    if name != opaque:
                        return None
                    opaque = None
                if swallow and name in swallow:
                    swallow.remove(name)
                elif count.get(name):
                    closed = None
                    while closed != name:
                        pos = stack.pop()
                        sort, closed = nodes[pos][0], nodes[pos][1]
                        end[pos] = n - 1
                        count[closed] -= 1
                        if sort == SPECIAL:
                            if closed in STRING_CONTAINER_TAGS and containers:
                                containers.pop()
                            if closed in PRESERVE_WS_TAGS:
                                kept -= 1
                    top = stack[-1]
        if data:
            piece = data.strip()
            if not piece and not kept and not data.strip(ASCII_BLANKS):
                data = "\n" if "\n" in data else " "
            end.append(n)
            parent.append(top)
            upto.append(seen)
            if containers:
                nodes.append(string_node("s" if containers[-1] in ("script", "style") else "x", data))
            else:
                nodes.append(data)
                pieces.append(piece)
                seen += 1
            n += 1
    if opaque is not None:
        return None
    for pos in stack:
        end[pos] = n - 1
    upto.append(seen)
    b = PlainPage()
    b.nodes, b.end, b.parent, b.upto, b.first, b.anchors, b.scripts, b.pieces = nodes, end, parent, upto, first, anchors, scripts, pieces
    return b


def shred_one(html: str | None):
    """(node table, error) of one page: a page that the tokenizer rejects has
    no nodes but the error it raised, so it can become a failure row."""
    if html is None:
        return None, None
    b = plain_page(html)
    if b is not None:
        return b, None
    b = _TreeBuilder()
    try:
        at = b.feed_plain(html)
        if at < len(html):
            b.feed(html[at:])
        b.finish()
    except (AssertionError, ValueError, RecursionError) as e:
        return None, f"{type(e).__name__}: {e}"
    return b, None


def byte_slices(batches, column: str, max_bytes: int = 4 << 20):
    """Cut Arrow batches into pieces of about ``max_bytes`` of ``column`` (one
    longer value stays whole), so memory follows bytes, not rows."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            held += size
            if held >= max_bytes or i == len(sizes) - 1:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0


_READER = json.JSONDecoder(parse_constant=lambda _: 1.5)


def tolerant_json(text: str) -> str | None:
    """JSON text in the strict form that Catalyst reads, None if unreadable.
    The last of repeated keys wins; ``NaN`` and ``Infinity`` are numbers, and
    as no rule looks at the value of a number any other stands for them."""
    try:
        return json.dumps(_READER.decode(text))
    except (ValueError, RecursionError):
        return None


def page_index(b):
    """(prefix sums, joined stripped texts, first positions, JSON-LD scripts)
    of one node table.  A JSON-LD script without a single string is null, an
    unreadable one is empty.  Made once for each table."""
    if b.index is None:
        b.index = _page_index(b)
    return b.index


def _page_index(b):
    all_chars, all_bytes, all_anchors, all_hrefs = [], [], [], []
    pieces, first, scripts = [], {}, []
    chars = size = anchors = hrefs = 0
    for pos, (kind, tag, attrs, text) in enumerate(zip(b.kind, b.tag, b.attrs, b.text)):
        if kind == "t":
            piece = text.strip()
            pieces.append(piece)
            chars += len(piece)
            size += len(piece) if piece.isascii() else len(piece.encode())
        elif kind == "e" and pos:
            if tag not in first:
                first[tag] = pos
            if attrs:
                for k in attrs:
                    first.setdefault(f"{tag}[{k}]", pos)
                for c in attrs.get("class", "").split():
                    first.setdefault("." + c, pos)
                if "id" in attrs:
                    first.setdefault("#" + attrs["id"], pos)
            if tag == "a":
                anchors += 1
                hrefs += "href" in attrs
            elif tag == "script" and attrs.get("type") == LD_JSON:
                one = b.end[pos] == pos + 1 and b.text[pos + 1] is not None
                scripts.append((tolerant_json(b.text[pos + 1]) or "") if one else None)
        all_chars.append(chars)
        all_bytes.append(size)
        all_anchors.append(anchors)
        all_hrefs.append(hrefs)
    return {"chars": all_chars, "bytes": all_bytes, "anchors": all_anchors, "hrefs": all_hrefs}, "".join(pieces), first, scripts


def _maps(maps: list, value: pa.DataType) -> pa.Array:
    """Dicts (or None) with string keys as one Arrow map column."""
    offsets, keys, values = [], [], []
    for m in maps:
        if m is None:
            offsets.append(None)
        else:
            offsets.append(len(keys))
            if m:
                keys.extend(m)
                values.extend(m.values())
    offsets.append(len(keys))
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, value))


def _shred_batch(tables: list) -> list[pa.Array]:
    """The columns ``PAGE_FIELDS`` of a batch of ``shred_one`` results."""
    offsets = [0]
    cols = {k: [] for k in ("end", "parent", "kind", "tag", "attrs", "text", "chars", "bytes", "anchors", "hrefs")}
    pos, texts, firsts, scripts = [], [], [], []
    for b, _ in tables:
        if b is None:
            offsets.append(offsets[-1])
            texts.append(None)
            firsts.append(None)
            scripts.append(None)
            continue
        sums, text, first, ld = page_index(b)
        n = len(b.kind)
        pos.extend(range(n))
        for c in ("end", "parent", "kind", "tag", "attrs", "text"):
            cols[c].extend(getattr(b, c))
        for c, v in sums.items():
            cols[c].extend(v)
        offsets.append(offsets[-1] + n)
        texts.append(text.encode())
        firsts.append(first)
        scripts.append(ld)
    nodes = pa.StructArray.from_arrays(
        [pa.array(pos, pa.int32()), *(_maps(v, pa.string()) if c == "attrs" else pa.array(v, _ARROW_NODE.field(c).type)
                                      for c, v in cols.items())], fields=list(_ARROW_NODE))
    mask = pa.array([b is None for b, _ in tables], pa.bool_())
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes, mask=mask), pa.array(texts, pa.binary()),
            _maps(firsts, pa.int32()), pa.array(scripts, pa.list_(pa.string())),
            pa.array([error for _, error in tables], pa.string())]


def shred_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """Replace the ``html`` column of ``df`` by ``PAGE_FIELDS``, slice by slice.

    A ``mapInArrow`` node: deterministic (so exchanges above it can be reused
    by Spark), and filters on derived columns are not pushed below it.  Put
    filters on page columns before it (they then reach the scan)."""
    keep = [f for f in df.schema.fields if f.name != html]
    out_schema = T.StructType(keep + PAGE_FIELDS)
    names = [f.name for f in keep]

    def run(batches):
        for b in byte_slices(batches, html):
            cols = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, *_shred_batch([shred_one(h) for h in b.column(html).to_pylist()])],
                                             names=out_schema.fieldNames())
    return df.mapInArrow(run, out_schema)
