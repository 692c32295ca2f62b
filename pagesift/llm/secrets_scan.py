"""Secret scan: fixed forms plus a token-efficiency test.

Fixed forms (``assign``, ``access``, ``hex``) are found by patterns, leftmost
and non-overlapping per kind.  The method adds spans of kind ``random``: runs
of at least ``MIN_RUN`` characters out of [A-Za-z0-9+/_=-] are encoded with a
tiktoken vocabulary; prose packs four or more characters into a token, random
strings hardly one and a half.  A run whose characters per token stay at or under
``MAX_CHARS_PER_TOKEN`` is a secret; of any other run, the parts between
separators (/ = - _) of ``MIN_RUN`` characters are tested by themselves and
windows of tokens slide over the rest, so words beside a random string do not
hide it, and the part whose ratio is low is reported.  Nothing is a secret if it is a known digest or identifier:
a hexadecimal digest of usual length, a UUID, a plain number, a date-like
number, a run of one or two characters, or part of a URL path or file name
made of words.  Runs inside a span already found by a fixed form are not
reported again.

Defined results: a null or empty text has no spans; positions are code points,
end exclusive; equal spans of different kinds are all reported, in the order
start, then kind; rows are scanned by themselves, so repeated rows repeat
their result; only the named columns are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import slices, texts_of

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")        # as [0-9a-f]+ with shorter matches dropped
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[A-Za-z0-9+]+")
MIN_RUN = 20      # as in RUN
MAX_CHARS_PER_TOKEN = 1.8
ASSIGN_HINT = re.compile(r"(?ai)passw|secret|token|api_?key")

# digests and identifiers that are public by nature
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
                    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})\Z")
SRI = re.compile(r"sha(?:256|384|512)[-=][A-Za-z0-9+/]+=*\Z")
UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z")
UUID_IN = re.compile(r"(?i)(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])")
NUMBER = re.compile(r"[0-9+/_=-]+\Z")


def is_known(run: str) -> bool:
    """Digest, identifier, number or filler: no secret whatever its tokens."""
    return bool(DIGEST.match(run) or UUID.match(run) or SRI.match(run) or NUMBER.match(run) or len(set(run)) <= 2)


@functools.lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary, read once per Python worker."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _window_spans(rest: str, enc: tiktoken.Encoding) -> list[tuple[int, int]]:
    """Spans of low ratio in a run: windows of the fewest tokens that hold
    ``MIN_RUN`` characters; those that overlap are one, less the words at its ends."""
    size = [len(x) for x in enc.decode_tokens_bytes(enc.encode_ordinary(rest))]
    at = [0]
    for n in size:
        at.append(at[-1] + n)
    hits: list[list[int]] = []
    i = 0
    for j in range(1, len(at)):
        while i + 1 < j and at[j] - at[i + 1] >= MIN_RUN:
            i += 1
        if MIN_RUN <= at[j] - at[i] <= MAX_CHARS_PER_TOKEN * (j - i):
            if hits and i < hits[-1][1]:
                hits[-1][1] = j
            else:
                hits.append([i, j])
    spans = []
    for i, j in hits:
        best, total, start, kept = 0.0, 0.0, i, (i, j)
        for k in range(i, j):
            total += MAX_CHARS_PER_TOKEN - size[k]
            if total > best:
                best, kept = total, (start, k + 1)
            if total < 0:
                total, start = 0.0, k + 1
        a, b = at[kept[0]], at[kept[1]]
        if b - a < MIN_RUN:
            a, b = at[i], at[j]
        spans.append((b - len(rest[a:b].lstrip("/=_-")), b))
    return spans


def parts_of(run: str, enc: tiktoken.Encoding, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of low ratio in a run that is not low as a whole, outside those
    ``covered`` and outside digests and identifiers."""
    found, gone = [], list(covered) + [m.span() for m in UUID_IN.finditer(run)]
    for m in PART.finditer(run):
        if len(m[0]) < MIN_RUN or any(m.start() < y and x < m.end() for x, y in gone):
            continue
        if is_known(m[0]):
            gone.append(m.span())
        elif len(m[0]) <= MAX_CHARS_PER_TOKEN * len(enc.encode_ordinary(m[0])):
            found.append(m.span())
    at = 0
    for x, y in [*sorted(gone + found), (len(run), len(run))]:
        if x - at >= MIN_RUN:
            for a, b in _window_spans(run[at:x], enc):
                span = run[at + a:at + b]
                # numbers between separators (dates, sizes) are no random string
                if not is_known(span) and sum(len(w) for w in PART.findall(span) if not w.isdigit()) >= MIN_RUN * 3 // 4:
                    found.append((at + a, at + b))
        at = max(at, y)
    return found


def spans_of(text: str, enc: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every span of a text, in order."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = list(found)
    for m in RUN.finditer(text):
        run, a, b = m[0], m.start(), m.end()
        if any(x <= a and b <= y for x, _, y in base) or is_known(run):
            continue
        if len(run) <= MAX_CHARS_PER_TOKEN * len(enc.encode_ordinary(run)):
            found.append((a, 3, b))
        else:
            covered = [(max(x, a) - a, min(y, b) - a) for x, _, y in base if x < b and a < y]
            found += [(a + x, 3, a + y) for x, y in parts_of(run, enc, covered)]
    return sorted(found)


def scan(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
         digests: bool = False) -> DataFrame:
    """Spans per row as array<struct<kind, start, stop>>; with ``digests`` the
    counts of the fixed forms, a digest of theirs and all spans as a string."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, " + (
        "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"
        if digests else "spans array<struct<kind:string,start:int,stop:int>>")

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for b in slices(batches, text):
            found = [spans_of(t, enc) for t in texts_of(b, text)]
            key = b.column(b.schema.get_field_index(doc_id))
            if not digests:
                rows = pa.array([[{"kind": KINDS[k], "start": a, "stop": z} for a, k, z in f] for f in found],
                                pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))
                yield pa.RecordBatch.from_arrays([key, rows], [doc_id, "spans"])
                continue
            joined = [",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in f) for f in found]
            base = [",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in f if k < 3) for f in found]
            counts = [pa.array([sum(k == i for _, k, _ in f) for f in found], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [key, *counts[:3], pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                 pa.array(joined, pa.string()), counts[3]],
                [doc_id, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select(doc_id, text).mapInArrow(run, schema)
