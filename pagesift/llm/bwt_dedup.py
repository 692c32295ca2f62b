"""Suffix-array dedup: removes every byte covered by a ``LENGTH``-byte string
that starts anywhere else, by merging shard Burrows-Wheeler transforms.

1. Anchors.  Every window of LENGTH bytes is represented by the GRAM-byte
   substring in it with the smallest hash (leftmost on ties).  Equal windows
   have equal anchors at equal places, and consecutive windows share them, so a
   text is a short list of (anchor, run of windows).  An anchor hash that occurs
   once in the whole corpus rules out all its windows, exactly.  A Bloom filter
   of the hashes that occur more often (bounded; a false positive only costs
   work) marks the runs worth shipping; everything else is never shuffled.
2. Shards.  The bytes of the marked runs are dealt by anchor hash.  All
   segments of an anchor are aligned on it, so a shard's suffix orders at every
   column follow from each other by one stable partition on the preceding
   symbol, which is its Burrows-Wheeler transform.
3. Merge.  The interleave of all shards starts as their concatenation and is
   refined column by column: rows are partitioned stably by the symbol in
   front (the LF step of the merged transform), and the common prefix of
   neighbours is one more than the smallest one between them in the column
   before.  No suffix is sorted.  Neighbours with a common prefix of LENGTH or
   more form a repeated interval: all its windows repeat.
4. Anchors with more than ``ROWS`` distinct segments are not merged in one
   task: their windows are counted by 128-bit hashes with map-side combine.
   (Those that also hold more than 1/HOT_SHARE of all segments are left out of
   the shuffle by anchor.)

Equal texts are one text with a count; a text of LENGTH bytes or more that
occurs twice is removed whole.  Texts are read as UTF-8 whatever their length.

Defined results: a null text is empty; texts under LENGTH bytes stay whole;
overlapping occurrences count, in the same text too; repeated rows (also with
equal doc_ids) each get their result; an empty table gives an empty result;
only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, lookup_join, slices, stage
from .exact_dedup import BITS, BITS_PER_ROW, MAX_BLOCKS, _sha, drop_exact_duplicates, mark_candidates, repeated_filter
from .shingles import _powers, mix

LENGTH = 200
GRAM = 64
SPAN = LENGTH - GRAM + 1       # places of a GRAM in a window
WIDTH = SPAN - 1 + LENGTH      # columns: SPAN - 1 before the anchor, LENGTH from it on
PAD = 255                      # no byte of UTF-8
CHUNK = 1 << 23                # longest piece of one text searched at once
ROWS = 40_000                  # segments merged at once
PLACE = np.uint64((1 << 24) - 1)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(1 << max(16, int(len(data)).bit_length()))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))


def substring_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of every substring of ``size`` bytes, the same wherever it stands."""
    n = len(sums) - size
    _, down = _powers(1 << max(16, int(len(sums) - 1).bit_length()))
    return mix((sums[size:] - sums[:n]) * down[:n])


def window_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor place, anchor hash, first window, last window) of the runs of
    windows inside the texts that end at ``ends`` in ``data``."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none, none
    h = substring_hashes(prefix_sums(data), GRAM)
    key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    # sliding minimum: suffix minima of one block of SPAN and prefix minima of the next
    m = -(-len(key) // SPAN) * SPAN
    block = np.full(m, np.iinfo(np.uint64).max)
    block[: len(key)] = key
    block = block.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1]).ravel()
    place = (np.minimum(behind[:n], ahead[SPAN - 1:SPAN - 1 + n]) & PLACE).astype(np.int64)
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():           # windows that reach into the next text
        inside[max(0, e - LENGTH + 1):e] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none.astype(np.uint64), none, none
    new = np.concatenate(([True], (np.diff(at) > 1) | (place[at[1:]] != place[at[:-1]])))
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return place[first], h[place[first]], first, last


def texts_and_runs(batches):
    """Per slice: (bytes, keys, start of each text in the bytes, runs).  Texts
    longer than CHUNK are searched in pieces that overlap by LENGTH - 1."""
    for b in slices(batches, "text", 1 << 20):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(b.schema.get_field_index("text")).to_pylist()]
        keys = b.column(b.schema.get_field_index("key")).to_pylist()
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        if len(data) <= CHUNK:
            yield data, keys, ends - sizes, window_runs(data, ends)
            continue
        parts = []
        for start, end in zip(ends - sizes, ends):
            for x in range(int(start), max(int(start) + 1, int(end) - LENGTH + 1), CHUNK):
                y = min(int(end), x + CHUNK + LENGTH - 1)
                a, h, f, z = window_runs(data[x:y], np.array([y - x]))
                parts.append((a + x, h, f + x, z + x))
        yield data, keys, ends - sizes, tuple(np.concatenate(p) for p in zip(*parts))


def count_anchors(texts: DataFrame) -> DataFrame:
    """(h, n) of every anchor hash that occurs at least twice."""
    def run(batches):
        for _, _, _, (_, h, _, _) in texts_and_runs(batches):
            u, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "n"])

    return texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")


def anchor_filter(repeated: DataFrame) -> tuple[np.ndarray, int]:
    """Blocked Bloom filter of the repeated hashes, at most 64 MB."""
    n_blocks = max(1, min(MAX_BLOCKS, -(-repeated.count() * BITS_PER_ROW // BITS)))
    h = F.col("h")
    places = [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(BITS - 1)) for s in (0, 15, 25)]
    rows = (repeated.select(F.pmod(F.shiftrightunsigned(h, 40), F.lit(n_blocks)).cast("int").alias("block"),
                            F.explode(F.array(*places)).alias("bit"))
            .groupBy("block").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits")).collect())
    bits = np.zeros((n_blocks, BITS // 8), np.uint8)
    for r in rows:
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.ravel(), n_blocks


def in_filter(h: np.ndarray, bits: np.ndarray, n_blocks: int) -> np.ndarray:
    block = (h >> np.uint64(40)).astype(np.int64) % n_blocks * (BITS // 8)
    ok = np.ones(len(h), bool)
    for s in (0, 15, 25):
        p = ((h >> np.uint64(s)) & np.uint64(BITS - 1)).astype(np.int64)
        ok &= (bits[block + (p >> 3)] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return ok


SEGMENT = "h bigint, s bigint, lead int, segment binary, n bigint, key binary, place int"


def segments(texts: DataFrame, shared) -> DataFrame:
    """Two kinds of rows.  Segments: anchor hash h, hash s of lead and bytes,
    lead (bytes before the anchor), the bytes, and n occurrences in the slice;
    occurrences: h, s, and where the anchor stands (key of the text, place)."""
    def run(batches):
        bits, n_blocks = shared.value
        for data, keys, starts, (a, h, first, last) in texts_and_runs(batches):
            ok = in_filter(h, bits, n_blocks)
            a, h, first, last = a[ok], h[ok], first[ok], last[ok]
            if not len(a):
                continue
            whole = data.tobytes()
            owner = np.searchsorted(starts, a, side="right") - 1
            lead = a - first
            seen: dict[tuple, int] = {}
            counts, who = [], []
            for x, y, g, k in zip(first.tolist(), (last + LENGTH).tolist(), h.tolist(), lead.tolist()):
                key = (g, k, whole[x:y])
                i = seen.setdefault(key, len(seen))
                if i == len(counts):
                    counts.append(0)
                counts[i] += 1
                who.append(i)
            ids = [int.from_bytes(hashlib.blake2b(k.to_bytes(2, "little") + seg, digest_size=8).digest(), "little", signed=True)
                   for _, k, seg in seen]
            g, k, seg = zip(*seen)
            m, o = len(seen), len(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(g, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(k, pa.int32()),
                 pa.array(seg, pa.binary()), pa.array(counts, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32())], NAMES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array([ids[i] for i in who], pa.int64()), pa.nulls(o, pa.int32()),
                 pa.nulls(o, pa.binary()), pa.nulls(o, pa.int64()), pa.array([keys[i] for i in owner], pa.binary()),
                 pa.array((a - starts[owner]).astype(np.int32))], NAMES)

    return texts.mapInArrow(run, SEGMENT)


NAMES = ["h", "s", "lead", "segment", "n", "key", "place"]


def merge(columns: np.ndarray):
    """Merges aligned rows by interleave refinement.  ``columns`` is (WIDTH x
    rows); yields, for every window column from right to left, the interleave
    and the common prefixes of neighbours (entry i: rows i-1 and i)."""
    n = columns.shape[1]
    order = np.arange(n)
    common = np.zeros(n + 1, np.int32)         # one spare entry for the range minima
    common[1:n] = 0
    for c in range(len(columns) - 1, -1, -1):
        front = columns[c][order]
        step = np.argsort(front, kind="stable")
        symbol = front[step]
        same = np.zeros(n, bool)
        same[1:] = symbol[1:] == symbol[:-1]
        at = np.flatnonzero(same)
        p, q = step[at - 1], step[at]          # places in the interleave before; p < q
        fresh = np.zeros(n + 1, np.int32)
        near = q == p + 1
        fresh[at[near]] = common[q[near]] + 1
        far = ~near
        if far.any():
            bounds = np.stack((p[far] + 1, q[far] + 1), axis=1).ravel()
            fresh[at[far]] = np.minimum.reduceat(common, bounds)[::2] + 1
        order, common = order[step], fresh
        if c < SPAN:
            yield c, order, common[:n]


def repeated_windows(lead: np.ndarray, size: np.ndarray, count: np.ndarray, rows: list[bytes]) -> np.ndarray:
    """(rows x SPAN) flags: the window of the row that starts in that column
    also starts elsewhere."""
    n = len(rows)
    table = np.full((n, WIDTH), PAD, np.uint8)
    begin = SPAN - 1 - lead
    for i, r in enumerate(rows):
        table[i, begin[i]:begin[i] + len(r)] = np.frombuffer(r, np.uint8)
    found = np.zeros((n, SPAN), bool)
    for c, order, common in merge(np.ascontiguousarray(table.T)):
        long = np.flatnonzero(common >= LENGTH)
        found[order[long], c] = True
        found[order[long - 1], c] = True
    found[count > 1] = True
    column = np.arange(SPAN)[None, :]
    return found & (column >= begin[:, None]) & (column <= (begin + size - LENGTH)[:, None])


def covered(windows: np.ndarray) -> list[int]:
    """Byte ranges (start, stop, ... relative to the anchor) that the flagged
    windows of one row cover."""
    at = np.flatnonzero(windows)
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate(([True], np.diff(at) > LENGTH)))
    stop = np.append(new[1:] - 1, len(at) - 1)
    return (np.stack((at[new], at[stop] + LENGTH), axis=1).ravel() - (SPAN - 1)).tolist()


def _merged(parts: DataFrame) -> DataFrame:
    """(h, s, ranges) by merging, for segments dealt and sorted by anchor.
    Segments of an anchor that has more than ROWS come back unmerged: with
    lead, segment and n, and without ranges."""
    def run(batches):
        held: list = []
        large = None                           # the anchor whose rows are passed on

        def flush(rows):
            g, s, lead, seg, n = zip(*rows)
            flags = repeated_windows(np.array(lead), np.array([len(x) for x in seg]), np.array(n), list(seg))
            some = np.flatnonzero(flags.any(axis=1)).tolist()
            k = len(some)
            return pa.RecordBatch.from_arrays(
                [pa.array([g[i] for i in some], pa.int64()), pa.array([s[i] for i in some], pa.int64()),
                 pa.array([covered(flags[i]) for i in some], pa.list_(pa.int32())),
                 pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], MERGED)

        def pass_on(rows):
            g, s, lead, seg, n = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(g, pa.int64()), pa.array(s, pa.int64()), pa.nulls(len(g), pa.list_(pa.int32())),
                 pa.array(lead, pa.int32()), pa.array(seg, pa.binary()), pa.array(n, pa.int64())], MERGED)

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if held and row[0] != held[-1][0]:
                    if large == held[-1][0]:
                        yield pass_on(held)
                        held = []
                    elif len(held) >= ROWS:
                        yield flush(held)
                        held = []
                held.append(row)
                if len(held) >= ROWS and row[0] == large:
                    yield pass_on(held)
                    held = []
                elif len(held) > ROWS and row[0] == held[0][0]:
                    large = row[0]
                elif len(held) >= 2 * ROWS:    # the rows before this anchor are complete
                    cut = next(i for i in range(len(held) - 1, -1, -1) if held[i][0] != row[0]) + 1
                    yield flush(held[:cut])
                    held = held[cut:]
                    if len(held) > ROWS:
                        large = row[0]
        if held:
            yield pass_on(held) if held[-1][0] == large else flush(held)

    rows = parts.select("h", "s", "lead", "segment", "n").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(run, "h bigint, s bigint, ranges array<int>, lead int, segment binary, n bigint")


MERGED = ["h", "s", "ranges", "lead", "segment", "n"]


def _counted(parts: DataFrame) -> DataFrame:
    """(h, s, ranges) for segments of hot anchors, window by window."""
    def windows(batches):
        for b in batches:
            for g, s, lead, seg, n in zip(*(b.column(i).to_pylist() for i in range(5))):
                data = np.frombuffer(seg, np.uint8)
                one = substring_hashes(prefix_sums(data), LENGTH)
                two = substring_hashes(prefix_sums(data[::-1]), LENGTH)[::-1]
                m = len(one)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, g)), pa.array(np.full(m, s)), pa.array(np.arange(m, dtype=np.int32) + SPAN - 1 - lead),
                     pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(m, n))],
                    ["h", "s", "at", "one", "two", "n"])

    rows = parts.select("h", "s", "lead", "segment", "n").mapInArrow(
        windows, "h bigint, s bigint, at int, one bigint, two bigint, n bigint")
    rows = stage(rows.select("h", "s", "at", F.struct("one", "two").alias("w"), "n"), "windows")
    often = rows.groupBy("w").agg(F.sum("n").alias("times")).filter("times > 1").select("w")
    hits = lookup_join(rows, stage(often, "often"), "w").groupBy("h", "s").agg(F.collect_set("at").alias("ats"))

    def ranges(batches):
        for b in batches:
            out = []
            for ats in b.column(2).to_pylist():
                flags = np.zeros(SPAN, bool)
                flags[ats] = True
                out.append(covered(flags))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))],
                                             ["h", "s", "ranges"])

    return hits.mapInArrow(ranges, "h bigint, s bigint, ranges array<int>")


def _cut(raw: bytes, places: list[int], ranges: list[list[int]]) -> tuple[int, int, bytes, list[list[int]]]:
    """(bytes removed, maximal runs, what is left, the runs) of one text."""
    mark = np.zeros(len(raw) + 1, np.int32)
    for place, r in zip(places, ranges):
        x = np.array(r) + place
        np.add.at(mark, x[::2], 1)
        np.add.at(mark, x[1::2], -1)
    gone = np.cumsum(mark[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return int(gone.sum()), len(edge) // 2, left, edge.reshape(-1, 2).tolist()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs``;
    with ``keep_bytes`` also what is left (binary) and the removed spans."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.substring(F.unhex(F.col("sha")), 1, 16).alias("key")
    rows = stage(docs.select("doc_id", _sha(F.col("text")).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "rows")
    copies = stage(rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copies")
    # one row per distinct text; unique texts are not shuffled
    texts = drop_exact_duplicates(docs).filter(F.octet_length("text") >= LENGTH).select(
        _sha(F.col("text")).alias("sha"), "text").select(key, "text")
    repeated = stage(count_anchors(texts), "anchors")
    shared = docs.sparkSession.sparkContext.broadcast(anchor_filter(repeated))
    found = stage(segments(texts, shared), "segments")
    parts = found.filter("segment is not null").groupBy("h", "s").agg(
        F.first("lead").alias("lead"), F.first("segment").alias("segment"), F.sum("n").alias("n"))
    parts = stage(parts, "distinct")
    hot = stage(hot_keys(parts.select("h"), "h").filter(F.col("n") > ROWS).select("h"), "hot")
    merged = stage(_merged(parts.join(F.broadcast(hot), "h", "left_anti")), "merged")
    many = merged.filter("ranges is null").drop("ranges").unionByName(parts.join(F.broadcast(hot), "h", "left_semi"))
    ranges = merged.filter("ranges is not null").select("h", "s", "ranges").unionByName(_counted(many))
    seen = found.filter("key is not null").select(F.struct("h", "s").alias("id"), "key", "place")
    met = lookup_join(seen, stage(ranges.select(F.struct("h", "s").alias("id"), "ranges"), "ranges"), "id")
    spans = stage(met.groupBy("key").agg(F.collect_list(F.struct("place", "ranges")).alias("spans")), "spans")

    bloom, n_blocks = repeated_filter(spans, "key", spans.count(), least=1)
    maybe = mark_candidates(texts, "key", stage(bloom, "bloom"), n_blocks).filter("__maybe").drop("__maybe")

    def cut(batches):
        for b in slices(batches, "text"):
            raw = [t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            spans = b.column(2).to_pylist()
            out = [_cut(r, [x["place"] for x in s], [x["ranges"] for x in s]) for r, s in zip(raw, spans)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string()),
                 pa.array([o[2] if keep_bytes else None for o in out], pa.binary()),
                 pa.array([o[3] if keep_bytes else None for o in out], pa.list_(pa.list_(pa.int64())))],
                ["key", "n_removed", "n_spans", "kept_sha256", "kept", "removed"])

    done = maybe.join(spans, "key").select("key", "text", "spans").mapInArrow(
        cut, "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, removed array<array<bigint>>")
    doubled = lookup_join(rows, copies, "sha").select(
        "doc_id", "n_bytes", F.when(F.col("n_bytes") >= LENGTH, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(F.col("n_bytes") >= LENGTH, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(F.col("n_bytes") >= LENGTH, EMPTY_SHA).otherwise(F.col("sha")).alias("kept_sha256"), "sha")
    alone = without_hot(rows, copies).join(done.withColumn("__k", F.col("key")).drop("key"),
                                           F.substring(F.unhex("sha"), 1, 16) == F.col("__k"), "left")
    alone = alone.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                         F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
                         F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "sha", "kept", "removed")
    out = alone.unionByName(doubled, allowMissingColumns=True)
    if not keep_bytes:
        return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed")


def without_hot(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows whose text occurs once.  Rows of texts with very many copies go
    before the shuffle, by a broadcast of at most HOT_SHARE keys."""
    hot = stage(hot_keys(rows.select("sha"), "sha").filter("n > 1").select("sha"), "hot")
    return rows.join(F.broadcast(hot), "sha", "left_anti").join(copies, "sha", "left_anti")
