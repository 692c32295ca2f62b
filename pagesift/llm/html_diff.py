"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host, steps of the URL path and id.  Every page is paired
with the page of its host whose path is nearest: of the next page before and
after it in that order whose lines differ, the one with the longer common
beginning of the path.  A copy of the page itself tells nothing and is passed
over, as are pages without lines, however many there are.  The text lines
(blocks) of both are aligned by a longest common subsequence, and lines that
the pages share are deleted as template.

Differencing alone cannot give right results where an article quotes a passage
that other articles hold too, or where menus, adverts and footers differ from
page to page.  So a check by markup follows on every page: of the shared lines
those inside the article that the page names (article, main, role, usual
classes) are put back unless they consist mostly of links; of the others, blocks
of navigation, headers, footers, sidebars, notices, adverts, forms, comments
and the like go, and where a page names its article, all blocks outside it.
The result says how many blocks were shared and how many of them were put back.

No host is gathered: rows of (host, path, id, hash of the lines) are dealt by
ranges, so a host with a third of all pages spreads over many tasks; what lies
beyond either end of a range is carried over from the ranges around it, so the
result does not depend on the number of ranges.  Lines travel to the pages they
are compared with as 64-bit hashes.  Texts are never written aside: pages are
parsed once for the hashes of their lines and once more for their texts, which
meet what was decided by a digest of the row.

Defined results: null or empty html gives the empty text; a null url is a host
of its own without a path; equal urls order by page_id; character references
are decoded, white space inside a block is one space, blocks are joined by two
line feeds; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import hot_keys, lookup_join, slices, stage

LINK_SHARE = 0.5
OUT, BACK, OPEN = range(3)   # marks of blocks: out by markup, stays though shared, goes if shared
SALTS = 64                   # parts of a row that a large share of all rows repeats

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# fixed values: element names of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark meter "
             "output progress q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br".split())
UNSEEN = set("head script style title noscript template svg math iframe object select option button textarea canvas "
             "audio video form nav footer aside dialog menu xmp".split())
# fixed values: words in class, id and role that name what is not the article
ASIDE = set("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
            "commentlist cookie cookies consent gdpr disqus footer masthead menu menubar nav navbar navigation newsletter "
            "notice notices notification alert pagination pager popup modal overlay promo promotion recommended "
            "recommendations related reply replies respond share sharing sidebar social sponsor sponsored subscribe "
            "subscription toolbar topbar widget widgets login signup search complementary contentinfo".split())
HEADER = {"header", "banner", "masthead"}
STRONG = set("ad ads advert advertisement comment comments commentlist cookie consent sponsored".split())
ARTICLE = {"articlebody", "article-body", "article-content", "article-text", "post-content", "post-body", "entry-content",
           "story-body", "main-content", "page-content", "article", "content-body"}


class Block:
    __slots__ = ("text", "aside", "article", "links")

    def __init__(self, text: str, aside: bool, article: bool, links: int):
        self.text, self.aside, self.article, self.links = text, aside, article, links


def _marks(tag: str, rest: str, in_article: bool) -> tuple[bool, bool]:
    """(not part of the article, opens the article) for an element."""
    values = {}
    if "=" in rest or "hidden" in rest:
        for m in ATTRIBUTE.finditer(rest):
            values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = " ".join(values.get(k, "") for k in ("class", "id", "role"))
    tokens = TOKEN.findall(CAMEL.sub(" ", names).lower())
    words = {t for i, t in enumerate(tokens) if not i or tokens[i - 1] not in ("has", "no", "with")}
    opens = (tag in ("article", "main") or values.get("role", "").lower() == "main"
             or values.get("itemprop", "").lower() == "articlebody"
             or any(n in ARTICLE for n in names.lower().split()))
    if tag in ("html", "body"):
        return False, False
    if "hidden" in values or "display:none" in values.get("style", "").replace(" ", "").lower() \
            or (values.get("aria-hidden", "").lower() == "true"):
        return True, opens
    if opens:
        return bool(words & STRONG), opens
    if tag in UNSEEN:
        return True, False
    if not in_article and (tag == "header" or words & HEADER or words == {"header"}):
        return True, False
    return bool(words & (ASIDE - HEADER)), False


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order, with what its markup says."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []
    open_tags: Counter = Counter()
    aside = article = False
    text: list[str] = []
    links = in_link = 0

    def close_block():
        nonlocal text, links
        if text:
            whole = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                out.append(Block(whole, aside, article, links))
        text, links = [], 0

    def add(piece: str):
        nonlocal links
        text.append(piece)
        if in_link:
            links += len(piece.strip())

    def pop_to(tag: str):
        nonlocal aside, article, in_link
        while stack:
            name, was_aside, was_article = stack.pop()
            open_tags[name] -= 1
            if (aside, article) != (was_aside, was_article):
                close_block()
            aside, article = was_aside, was_article
            if name == "a":
                in_link = max(0, in_link - 1)
            if name == tag:
                break

    at = 0
    while True:
        m = TAG.search(page, at)
        if not m:
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        if m[2] is None:                       # comment or declaration
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                close_block()
            if open_tags[tag]:
                pop_to(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            close_block()
            if open_tags["p"] and tag not in ("tr", "td", "th"):
                # a block ends an open paragraph of the same container
                i = len(stack) - 1
                while i >= 0 and (stack[i][0] in INLINE or stack[i][0] == "p"):
                    i -= 1
                if any(x[0] == "p" for x in stack[i + 1:]):
                    while any(x[0] == "p" for x in stack[i + 1:]):
                        pop_to("p")
            if tag in ("article", "main") and aside and any(x[0] in ("nav", "header") for x in stack):
                while open_tags["nav"] or open_tags["header"]:    # a menu nobody closed
                    pop_to("nav" if open_tags["nav"] else "header")
        elif tag == "br":
            add(" ")
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in INLINE and tag in ("div", "p"):
            continue
        stack.append((tag, aside, article))
        open_tags[tag] += 1
        more_aside, more_article = _marks(tag, m[3], article)
        if (more_aside and not aside) or (more_article and not article):
            close_block()
        aside, article = aside or more_aside, article or more_article
        if tag == "a":
            in_link += 1
    if at < len(page):
        add(page[at:])
    close_block()
    return out


TABLE_BITS = 1 << 30


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of one longest common subsequence of two line lists.
    Equal ends match at once and lines that the other list lacks never do; the
    rest is aligned with bounded memory however long it is."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    end = len(a) - tail
    there, mine = set(b[head:len(b) - tail]), set(a[head:end])
    at = [i for i in range(head, end) if a[i] in there]
    found = _align([a[i] for i in at], [y for y in b[head:len(b) - tail] if y in mine])
    return [*range(head), *(at[i] for i in found), *range(end, len(a))]


def _advance(x: list, y: list):
    """After each line of ``x`` the bits of ``y``: a zero where the common
    subsequence with the lines of ``y`` up to there grows by one."""
    where: dict = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    full = v = (1 << len(y)) - 1
    for line in x:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(x: list, y: list) -> np.ndarray:
    """Longest common subsequence of ``x`` with the first 0, 1, ... lines of ``y``."""
    v = (1 << len(y)) - 1
    for v in _advance(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _align(x: list, y: list) -> list[int]:
    """Places in ``x``.  A table too large is halved over ``x`` where the two
    halves' lengths add up to the most."""
    if not x or not y:
        return []
    if len(x) > 1 and len(x) * len(y) > TABLE_BITS:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return _align(x[:half], y[:cut]) + [half + i for i in _align(x[half:], y[cut:])]
    rows, found = list(_advance(x, y)), []
    i, j = len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if i and not rows[i - 1] >> (j - 1) & 1:
                continue
            found.append(i)
            j -= 1
    return found[::-1]


class Page:
    """A parsed page."""

    def __init__(self, page_id, url, host, path, source):
        self.page_id, self.url, self.host = page_id, url, host
        self.steps = path.split("/")
        self.blocks = blocks_of(source)
        self.lines = [b.text for b in self.blocks]

    def nearness(self, other: "Page") -> int:
        return nearness(self.steps, other.steps)

    def own_lines(self) -> list[str]:
        return [b.text for b in self.blocks if not b.aside]

    def is_copy(self, other: "Page") -> bool:
        """Only equal lines make a copy, however large the template both share."""
        return self.own_lines() == other.own_lines()

    def text(self, neighbours: list["Page"]) -> str:
        """The main text, given the pages in reach, nearest place first."""
        same_host = sorted((p for p in neighbours if p.host == self.host), key=lambda p: -self.nearness(p))
        partner = next((p for p in same_host if not self.is_copy(p)), None)
        gone, _, _ = checked(common_lines(self.lines, partner.lines) if partner else [], self.marks())
        return "\n\n".join(b for i, b in enumerate(self.marked()) if i not in gone)

    def marks(self) -> list[int]:
        """What the markup says of each block: out, put back if shared, or nothing."""
        named = any(b.article and not b.aside for b in self.blocks)
        return [OUT if b.aside or named and not b.article else OPEN if not named or b.links >= LINK_SHARE * len(b.text) else BACK
                for b in self.blocks]

    def marked(self) -> list[str]:
        """The blocks that the markup lets stand."""
        return [b.text for b, m in zip(self.blocks, self.marks()) if m != OUT]


def checked(shared: list[int], marks) -> tuple[set[int], int, int]:
    """The check by markup of the lines that differencing deletes: those that
    go, as places among the blocks that the markup lets stand, how many were
    shared and how many of them are put back."""
    m = np.frombuffer(bytes(marks), np.uint8)
    rank = np.cumsum(m != OUT) - 1
    at = np.array(shared, np.int64)
    return set(rank[at[m[at] == OPEN]].tolist()), len(at), int((m[at] == BACK).sum())


def nearness(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Trail:
    """The last page of an order and the last one that is no copy of it."""

    def __init__(self, last=None, differs=None):
        self.last, self.differs = last, differs

    @staticmethod
    def same(a, b) -> bool:
        return a is not None and (a["host"], a["hash"]) == (b["host"], b["hash"])

    def other(self, page):
        """The nearest page of the host that is no copy of ``page``."""
        found = self.differs if self.same(self.last, page) else self.last
        return found if found is not None and found["host"] == page["host"] else None

    def after(self, last, differs) -> "Trail":
        """Behind a range with this last page and last other page, if any."""
        if differs is None:
            differs = self.differs if self.same(self.last, last) else self.last
        return Trail(last, differs)


def partners(keys: DataFrame) -> DataFrame:
    """(rid, partner) of the pages among ``keys(rid, host, steps, page_id, url,
    hash)`` that have a partner."""
    def place(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), *b.columns],
                                             ["part", "seq", *b.schema.names])
            seq += n
    order = ["host", "steps", "page_id", "url", "hash", "rid"]
    keys = (keys.repartitionByRange(*order).sortWithinPartitions(*order).select("rid", "host", "steps", "hash")
            .mapInArrow(place, "part int, seq bigint, rid bigint, host string, steps array<string>, hash bigint"))
    keys = stage(keys, "keys")
    row = F.struct("seq", "rid", "host", "steps", "hash")
    ends = keys.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))

    def unlike(end):
        return F.when((F.col("host") != F.col(f"{end}.host")) | (F.col("hash") != F.col(f"{end}.hash")), row)
    # one row per range
    ranges = (keys.join(F.broadcast(ends), "part").groupBy("part").agg(
        F.first("first").alias("first"), F.first("last").alias("last"),
        F.min(unlike("first")).alias("not_first"), F.max(unlike("last")).alias("not_last")).orderBy("part").collect())
    before, after, trail = {}, {}, Trail()
    for r in ranges:
        before[r.part], trail = trail, trail.after(r["last"], r["not_last"])
    trail = Trail()
    for r in reversed(ranges):
        after[r.part], trail = trail, trail.after(r["first"], r["not_first"])
    shared = keys.sparkSession.sparkContext.broadcast((before, after))

    def pair(batches):
        before, after = shared.value
        part, trail, run = None, None, []          # run: copies next to each other

        def done(following):
            back, ids, found = trail.other(run[0]), [], []
            for page in run:
                sides = [p for p in (back, following) if p is not None]
                if sides:
                    ids.append(page["rid"])
                    found.append(max(sides, key=lambda p: nearness(page["steps"], p["steps"]))["rid"])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["rid", "partner"])
        for b in batches:
            for page in b.to_pylist():
                if run and (page["part"] != part or not Trail.same(run[0], page)):
                    inside = page["part"] == part
                    following = page if inside else after[part].other(run[0])
                    yield done(following if following is not None and following["host"] == run[0]["host"] else None)
                    trail, run = trail.after(run[-1], None), []
                if page["part"] != part:
                    part, trail = page["part"], before[page["part"]]
                run.append(page)
        if run:
            yield done(after[part].other(run[0]))

    return keys.repartition("part").sortWithinPartitions("part", "seq").mapInArrow(pair, "rid bigint, partner bigint")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_shared, n_restored per row of
    ``pages(page_id, url, html)``: blocks of the page, those that differencing
    deletes, and those of them that the markup puts back."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select("page_id", "url", "html",
                        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)).alias("host"),
                        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1).alias("path"))
    kind = pages.schema["page_id"].dataType

    def parsed(batch):
        for page_id, url, source, host, path in zip(*(c.to_pylist() for c in batch.columns)):
            yield _digest(page_id, url, source), Page(page_id, url, host, path, source or "")

    def hashes(batches):
        rid = TaskContext.get().partitionId() << 36
        for b in slices(batches, "html"):
            out = []
            for key, page in parsed(b):
                own = page.own_lines()
                if own:
                    out.append((rid, key, page.host, page.steps, page.page_id, page.url, _hash("\n".join(own)),
                                [_hash(x) for x in page.lines], bytes(page.marks())))
                rid += 1
            yield _columns(out, hashed_fields)

    schema = f"rid bigint, key binary, host string, steps array<string>, page_id {kind.simpleString()}, url string, hash bigint, lines array<bigint>, marks binary"
    hashed_fields = _fields(pages.sparkSession, schema)
    hashed = stage(rows.mapInArrow(hashes, schema), "hashed")
    pairs = stage(partners(hashed.select("rid", "host", "steps", "page_id", "url", "hash")), "pairs")
    theirs = lookup_join(pairs, hashed.select(F.col("rid").alias("partner"), F.col("lines").alias("theirs")), "partner").select("rid", "theirs")

    def difference(batches):
        for b in batches:
            out = []
            for key, lines, marks, theirs in zip(*(c.to_pylist() for c in b.columns)):
                gone, n, back = checked(common_lines(lines, theirs), marks)
                out.append((key, sorted(gone), n, back))
            yield _columns(out, decided_fields)

    decided = "key binary, gone array<int>, n_shared bigint, n_restored bigint"
    decided_fields = _fields(pages.sparkSession, decided)
    found = (hashed.select("rid", "key", "lines", "marks").join(theirs, "rid").select("key", "lines", "marks", "theirs")
             .mapInArrow(difference, decided))
    # equal rows have one partner and one outcome; one that many rows repeat is dealt over its parts
    hot = stage(hot_keys(hashed.select("key"), "key").select("key"), "hot").withColumn("hot", F.lit(True))
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    found = (found.groupBy("key").agg(*(F.first(c).alias(c) for c in ("gone", "n_shared", "n_restored")))
             .join(F.broadcast(hot), "key", "left").withColumn("salt", F.explode(parts)).drop("hot"))

    def read(batches):
        for b in slices(batches, "html"):
            out = []
            for key, page in parsed(b):
                kept = page.marked()
                whole = "".join(kept).encode("utf-8", "surrogatepass")
                out.append((key, page.page_id, page.url, len(page.blocks), [len(x) for x in kept], len(whole),
                            pa.compress(whole, codec="zstd", asbytes=True)))
            yield _columns(out, read_fields)

    texts = f"key binary, page_id {kind.simpleString()}, url string, n_blocks bigint, sizes array<int>, n_bytes bigint, packed binary"
    read_fields = _fields(pages.sparkSession, texts)
    salt = F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    both = (rows.mapInArrow(read, texts).join(F.broadcast(hot), "key", "left").withColumn("salt", salt).drop("hot")
            .join(found.hint("merge"), ["key", "salt"], "left")
            .select("page_id", "url", "n_blocks", "sizes", "n_bytes", "packed", "gone", "n_shared", "n_restored"))

    def finish(batches):
        for batch in batches:
            for b in slices([batch], "packed"):
                out = []
                for page_id, url, n_blocks, sizes, n_bytes, packed, gone, shared, back in zip(*(c.to_pylist() for c in b.columns)):
                    whole = pa.decompress(packed, n_bytes, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass")
                    gone, ends = set(gone or ()), list(accumulate(sizes, initial=0))
                    text = "\n\n".join(whole[x:y] for i, (x, y) in enumerate(zip(ends, ends[1:])) if i not in gone)
                    out.append((page_id, url, text, len(text), n_blocks, shared or 0, back or 0))
                yield _columns(out, result_fields)

    result = f"page_id {kind.simpleString()}, url string, text string, n_chars bigint, n_blocks bigint, n_shared bigint, n_restored bigint"
    result_fields = _fields(pages.sparkSession, result)
    return both.mapInArrow(finish, result)


def _digest(page_id, url, source) -> bytes:
    """Of a whole row: equal rows have equal digests."""
    return hashlib.blake2b(repr((page_id, url, source)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _fields(spark, schema: str) -> list[tuple[str, pa.DataType]]:
    return [(f.name, to_arrow_type(f.dataType)) for f in spark.createDataFrame([], schema).schema]


def _columns(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])
