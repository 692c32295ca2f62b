"""Periodic runs of words: block convolution at dyadic scales.

A run is a stretch of consecutive words with smallest period q and length of at
least max(24, 3q) that no neighbouring word extends.  At the scale L = 8, 16,
32, ... every aligned block of L words of a document is compared with the L
(at the first scale 15) places that follow it at distances L .. 2L - 1 (first:
1 .. 15): the sums of squared differences are one convolution, computed by an
exact number-theoretic transform, and a sum of zero marks a possible occurrence.
A run of period q in [L, 2L) holds an aligned block together with its next
occurrence at distance q (2L - 1 <= 2q words leave room for both), so no run is
missed: a block that occurs at a distance always has the sum zero.  The reverse
need not hold modulo a prime; seeds are extended to both sides by binary search
over prefix hashes, and every interval that is long enough is then compared
word by word.  If a hash has lied, the batch is done again with another base, so
the result is exact.  Of the distances with one interval the smallest is the
period: in a stretch of three periods any smaller period divides the larger.

Everything is a map over documents: slices of bounded bytes, blocks of bounded
elements, nothing shuffles.

Defined results: a null or empty text, or one of white space, has no words, no
runs (count 0, four nulls) and the digests of empty strings; a null doc_id is
never planted; repeated rows repeat their result; equal ratios go to the
smallest start, then period; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

FIRST = 8              # words of a block at the first scale
LEAST = 24             # words of the shortest run: three blocks of the first scale
TIMES = 3              # periods of the shortest run
CELLS = 1 << 14        # numbers of one block of transforms
FERMAT = 65537         # transforms up to 2^16 points, generator 3
RADIX = 64             # points of one step: 64 products of residues are exact in a double
WIDE = 998244353       # 119 * 2^23 + 1: transforms up to 2^23 points, generator 3


def _near(x: np.ndarray) -> np.ndarray:
    """Exact integers in doubles, modulo the Fermat prime, up to one prime to either side."""
    q = np.floor(x * (1.0 / FERMAT))
    q *= FERMAT
    x -= q
    return x


@functools.lru_cache(maxsize=64)
def _powers(rows: int, columns: int, n: int, inverse: bool) -> np.ndarray:
    """root^(j*k) for a primitive root of order n, as doubles."""
    root = pow(3, (FERMAT - 1) // n, FERMAT)
    if inverse:
        root = pow(root, FERMAT - 2, FERMAT)
    line = np.ones(1, np.int64)
    while len(line) < n:
        line = np.concatenate([line, line * pow(root, len(line), FERMAT) % FERMAT])
    return line[np.arange(rows)[:, None] * np.arange(columns) % n].astype(float)


def _forward(a: np.ndarray) -> np.ndarray:
    """Transform of the last axis modulo the Fermat prime by matrix products
    of at most ``RADIX`` points, in the order of the steps."""
    n = a.shape[-1]
    if n <= RADIX:
        return _near(a @ _powers(n, n, n, False))
    x = a.reshape(*a.shape[:-1], RADIX, n // RADIX)
    x = _near(np.matmul(_powers(RADIX, RADIX, RADIX, False), x))
    x *= _powers(RADIX, n // RADIX, n, False)
    return _forward(_near(x)).reshape(a.shape)


def _backward(a: np.ndarray) -> np.ndarray:
    """``_forward`` undone, but for the factor n."""
    n = a.shape[-1]
    if n <= RADIX:
        return _near(a @ _powers(n, n, n, True))
    x = _backward(a.reshape(*a.shape[:-1], RADIX, n // RADIX))
    x *= _powers(RADIX, n // RADIX, n, True)
    return _near(np.matmul(_powers(RADIX, RADIX, RADIX, True), _near(x))).reshape(a.shape)


def _cyclic(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cyclic convolutions of the rows, modulo the Fermat prime."""
    n = a.shape[1]
    product = _backward(_near(_forward(a) * _forward(b)))
    product *= pow(n, FERMAT - 2, FERMAT)
    return _near(product)


@functools.lru_cache(maxsize=64)
def _wide_roots(h: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. h-1 of a primitive root of order 2h (or of its inverse)."""
    root = pow(3, (WIDE - 1) // (2 * h), WIDE)
    if inverse:
        root = pow(root, WIDE - 2, WIDE)
    out = np.ones(1, np.int64)
    while len(out) < h:
        out = np.concatenate([out, out * pow(root, len(out), WIDE) % WIDE])
    return out


def _wide_cyclic(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same modulo the wide prime, for more points, level by level."""
    n = a.shape[1]
    for x in (a, b):
        h = n // 2
        while h:
            y = x.reshape(len(x), -1, 2, h)
            u, v = y[:, :, 0], y[:, :, 1]
            y[:, :, 0], y[:, :, 1] = (u + v) % WIDE, (u - v) * _wide_roots(h, False) % WIDE
            h //= 2
    x, h = a * b % WIDE, 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        u, v = y[:, :, 0], y[:, :, 1] * _wide_roots(h, True) % WIDE
        y[:, :, 0], y[:, :, 1] = (u + v) % WIDE, (u - v) % WIDE
        h *= 2
    return x * pow(n, WIDE - 2, WIDE) % WIDE


def zero_distances(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int,
                   low: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of every block ``symbols[start:start+length]`` whose
    sum of squared differences with the words at distance ``low`` ..
    ``low+many-1`` is zero modulo the prime, occurrences ending by ``ends``."""
    points = 1 << (many + length - 2).bit_length()
    small = points < FERMAT
    p = FERMAT if small else WIDE
    kind = float if small else np.int64
    values = symbols * 40_503 % p
    squares = np.concatenate([[0], np.cumsum(values * values % p)])
    beyond = low + many + length                                       # what lies there never counts
    energy = (squares[length:] - squares[:-length]) % p if len(values) >= length else squares[:0]
    blocks, windows, energies = (
        np.lib.stride_tricks.sliding_window_view(np.concatenate([x, np.zeros(beyond, np.int64)]).astype(kind), w)
        for x, w in ((values, length), (values, many + length - 1), (energy, many)))
    at, far = [], []
    rows = max(1, CELLS // points)
    for k in range(0, len(starts), rows):
        s = starts[k:k + rows]
        block, window = np.zeros((len(s), points), kind), np.zeros((len(s), points), kind)
        block[:, :length] = blocks[s, ::-1]
        window[:, :many + length - 1] = windows[s + low]
        sums = (_cyclic if small else _wide_cyclic)(block, window)[:, length - 1:length - 1 + many]
        sums = energies[s + low] - 2 * sums
        sums += energy[s, None]
        i, j = np.nonzero(np.rint(sums * (1.0 / p)) * p == sums if small else sums % p == 0)
        inside = s[i] + low + j + length <= ends[k:k + rows][i]
        at.append(s[i[inside]])
        far.append(low + j[inside])
    return (np.concatenate(at), np.concatenate(far)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Hashes:
    """Prefix hashes of a batch of words, one polynomial modulo ``WIDE``."""

    def __init__(self, ids: np.ndarray, base: int):
        self.powers = np.ones(1, np.int64)
        while len(self.powers) <= len(ids):
            self.powers = np.concatenate([self.powers, self.powers * pow(base, len(self.powers), WIDE) % WIDE])
        terms = (ids * 7_919 + 1) % WIDE * self.powers[:len(ids)] % WIDE
        self.prefix = np.concatenate([[0], np.cumsum(terms) % WIDE])

    def common(self, a: np.ndarray, d: np.ndarray, room: np.ndarray, sign: int) -> np.ndarray:
        """Longest common extension of the places ``a`` and ``a + d``, to the
        right (``sign`` 1) or left (-1), up to ``room`` words."""
        low, high = np.zeros(len(a), np.int64), room.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            x, y = (a, a + mid) if sign > 0 else (a - mid, a)
            here = (self.prefix[y] - self.prefix[x]) % WIDE * self.powers[d] % WIDE
            same = here == (self.prefix[y + d] - self.prefix[x + d]) % WIDE
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low


def _intervals(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray | None:
    """Rows (start, stop, period) of all runs of documents ``ids[begin:end]``;
    None if a hash has lied."""
    hashes, found = _Hashes(ids, base), []
    longest, length = int((ends - begins).max()), FIRST
    while max(LEAST, TIMES * (low := 1 if length == FIRST else length)) <= longest:
        many = 2 * length - low
        with_room = ends - begins >= max(LEAST, TIMES * low)
        b, e = begins[with_room], ends[with_room]
        blocks = (e - b - low) // length
        first = np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(b, blocks) + (np.arange(len(first)) - first) * length
        s, d = zero_distances(ids, starts, np.repeat(e, blocks), length, low, many)
        if len(s):
            doc = np.searchsorted(begins, s, "right") - 1
            while len(ids) and (empty := ends[doc] <= s).any():      # documents without words share their begin
                doc = doc - empty
            for k in range(0, len(s), CELLS):
                a, x, o = s[k:k + CELLS], d[k:k + CELLS], doc[k:k + CELLS]
                right = hashes.common(a, x, ends[o] - a - x, 1)
                left = hashes.common(a, x, a - begins[o], -1)
                start, stop = a - left, a + x + right
                ok = stop - start >= np.maximum(LEAST, TIMES * x)
                found.append(np.unique(np.stack([start[ok], stop[ok], x[ok]], axis=1), axis=0))
        length *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.unique(np.concatenate(found), axis=0)        # by start, stop, distance
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    if all(np.array_equal(ids[a:z - q], ids[a + q:z]) for a, z, q in runs.tolist()):
        return runs
    return None


def runs_of(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All runs of a batch of documents, (start, stop, period) in places of the
    batch, by start, then period."""
    base = 131_071
    while len(begins) and len(ids):
        runs = _intervals(ids, begins, ends, base)
        if runs is not None:
            return runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        base += 2
    return np.zeros((0, 3), np.int64)


def planted(n: int, doc_id: int) -> np.ndarray | None:
    """Places of the original words that the query's rule makes a document of,
    None where it changes nothing."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Of (start, length, period) by start, then period: the first with the
    greatest exact length / period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def summaries(texts: list[str], keys: list | None = None) -> list[tuple[list, str]]:
    """For each text its runs as (start, length, period), and the text less all
    repeated periods.  With ``keys`` (doc_ids) the rule of ``planted`` applies."""
    numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
    words, ids, ends = [], [], []
    for k, t in enumerate(texts):
        ws = t.encode("utf-8", "surrogatepass").split()       # of bytes: at \x20 and \x09-\x0D only
        places = planted(len(ws), keys[k]) if keys is not None and keys[k] is not None else None
        if places is not None:
            ws = [ws[i] for i in places.tolist()]
        words.append(ws)
        ids.extend(map(numbers.__getitem__, ws))
        ends.append(len(ids))
    ends = np.array(ends, np.int64)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    runs = runs_of(np.array(ids, np.int64), begins, ends)
    out, at = [], np.searchsorted(runs[:, 0], np.concatenate([begins, ends[-1:]]))
    for k, ws in enumerate(words):
        mine = runs[at[k]:at[k + 1]] - [begins[k], begins[k], 0]
        if len(mine):
            cover = np.zeros(len(ws) + 1, np.int64)
            np.add.at(cover, mine[:, 0] + mine[:, 2], 1)
            np.add.at(cover, mine[:, 1], -1)
            ws = [w for w, c in zip(ws, np.cumsum(cover).tolist()) if not c]
        out.append(([(a, z - a, q) for a, z, q in mine.tolist()], b" ".join(ws).decode("utf-8", "surrogatepass")))
    return out


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = False,
           digests: bool = False) -> DataFrame:
    """Per row its runs as array<struct<start, length, period>> and the
    collapsed text; with ``digests`` the count, the best run and digests of
    both.  ``plant`` applies the rule of ``planted`` first."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, " + (
        "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
        if digests else "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for b in slices(batches, text):
            key = b.column(b.schema.get_field_index(doc_id))
            found = summaries(texts_of(b, text), key.to_pylist() if plant else None)
            if not digests:
                rows = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs, _ in found]
                kinds = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([key, pa.array(rows, kinds), pa.array([c for _, c in found], pa.string())],
                                                 [doc_id, "runs", "collapsed"])
                continue
            best = [best_run(runs) for runs, _ in found]
            columns = [[len(runs) for runs, _ in found]] + [[r and r[i] for r in best] for i in range(3)]
            columns.append([r and 1000 * r[1] // r[2] for r in best])
            listed = ["".join(f"{a},{n},{q}\n" for a, n, q in runs) for runs, _ in found]
            yield pa.RecordBatch.from_arrays(
                [key, *(pa.array(c, pa.int64()) for c in columns), pa.array([sha(x) for x in listed], pa.string()),
                 pa.array([sha(c) for _, c in found], pa.string())],
                [doc_id, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return docs.select(doc_id, text).mapInArrow(run, schema)
