"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF
shingles, banded, verified by weighted Jaccard similarity.

Features are hashed shingles of ``WIDTH`` words.  The weight of a shingle is
its count in the text times a damped inverse document frequency,
1 + ln(N / df) / (4 ln N), between 1 and 1.25: boilerplate counts less, but
the many members of a large group still look as alike as they are.  df is
counted over all rows in a table of ``CELLS`` hashed cells (as in feature
hashing), so its size does not grow; a cell's background load is the same
share of N at every size.  Every distinct text gets ``BANDS x ROWS`` consistent
weighted samples (Ioffe's scheme); equal bands make a bucket.

In every bucket each member is paired with three of them (smallest, largest and
middle by hash), and pairs are verified on whole texts.  Connected components
of the verified links follow.  That loses links only inside buckets whose
members still lie in different components; their members are dealt into blocks
of ``BLOCK``, and every pair of blocks is compared as a whole (exact
similarities by a product of matrices), which returns one link for any two
components that have one.  So pairs are never enumerated as rows, and no link
between texts that share a bucket is lost.  Two texts of similarity 0.8 share no bucket with
a probability of (1 - 0.8^3)^16, one in 100,000.

Equal texts are one node, so a text that a third of all rows repeat costs one
sketch; hot buckets and hot hubs are split (``lookup_join``, salted hubs).

Defined results: a null text is empty; texts without words are alike only if
equal after joining words by single spaces, that is, all of them form one
class; texts of one to four words are one shingle; case of A-Z and the kind of
white space do not matter for similarity; of a class the row with the smallest
doc_id stays, a null doc_id counting as larger than any; among equal ids one
row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, hot_keys, lookup_join, slices, stage, texts_of
from .components import components
from .exact_dedup import _sha, drop_exact_duplicates, mark_candidates, repeated_filter
from .shingles import mix, shingle_sets

THRESHOLD = 0.8
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
BLOCK = 128               # members of a bucket that are compared as one block
CELLS = 1 << 20
CELL_BLOCK = 1024
TABLE = 4096              # entries of the tables of random variates
PIECE = 1 << 16           # shingles sketched at once


@functools.lru_cache(maxsize=1)
def variates() -> tuple:
    """Tables of r and c ~ Gamma(2, 1) and b ~ Uniform(0, 1) per sample, as
    consistent weighted sampling draws them; a shingle's hash picks the entry."""
    rng = np.random.default_rng(20240229)
    r = rng.gamma(2.0, 1.0, (SAMPLES, TABLE))
    c = rng.gamma(2.0, 1.0, (SAMPLES, TABLE))
    b = rng.random((SAMPLES, TABLE))
    odd = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return (r.astype(np.float32), (1.0 / r).astype(np.float32), b.astype(np.float32),
            (np.log(c) + r * (b - 1.0)).astype(np.float32), odd)


def weigh(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[(hashes >> np.uint64(44)).astype(np.int64)]


def sketch(sets: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """(texts x SAMPLES) samples as 64-bit values; every set is non-empty."""
    r, inv_r, b, g, odd = variates()
    out = np.empty((len(sets), SAMPLES), np.uint64)
    at = 0
    while at < len(sets):
        stop, size = at, 0
        while stop < len(sets) and (stop == at or size + len(sets[stop][0]) <= PIECE):
            size += len(sets[stop][0])
            stop += 1
        h = np.concatenate([s for s, _ in sets[at:stop]])
        w = np.log(np.concatenate([weigh(s, c, idf) for s, c in sets[at:stop]])).astype(np.float32)
        lens = np.array([len(s) for s, _ in sets[at:stop]])
        starts = np.cumsum(lens) - lens
        place = np.arange(len(h), dtype=np.int64)
        for i in range(SAMPLES):
            pick = ((h * odd[i]) >> np.uint64(52)).astype(np.int64)
            t = np.floor(w * inv_r[i].take(pick) + b[i].take(pick))
            a = (g[i].take(pick) - r[i].take(pick) * t).view(np.int32)
            # order-preserving integers of the floats, then the place: ties go to the smaller hash
            key = ((a ^ ((a >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32) | place
            best = np.minimum.reduceat(key, starts) & 0xFFFFFFFF
            out[at:stop, i] = h[best] + t[best].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = stop
    return mix(out)


def similarity(x: tuple, y: tuple, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    if not len(x[0]) or not len(y[0]):
        return float(len(x[0]) == len(y[0]))
    a, b = weigh(*x, idf), weigh(*y, idf)
    at = np.minimum(np.searchsorted(x[0], y[0]), len(x[0]) - 1)
    same = x[0][at] == y[0]
    low = np.minimum(a[at[same]], b[same]).sum()
    return float(low / (a.sum() + b.sum() - low))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """(idf per cell, rows): every task adds up its own counts; blocks of cells
    are then summed as streams, one block at a time."""
    def count(batches):
        df, rows = np.zeros(CELLS, np.int64), 0
        for b in slices(batches, text):
            sets = shingle_sets(texts_of(b, text))
            rows += len(sets)
            df += np.bincount((np.concatenate([s for s, _ in sets]) >> np.uint64(44)).astype(np.int64), minlength=CELLS)
        blocks = df.reshape(-1, CELL_BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *some.tolist()], pa.int32()),
                 pa.array([np.array([rows]).tobytes(), *(blocks[i].astype("<u4").tobytes() for i in some)], pa.binary())],
                ["block", "counts"])

    def add(batches):
        block, total = None, 0
        def row():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                              ["block", "counts"])
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != block:
                    if block is not None:
                        yield row()
                    block, total = k, 0
                total = total + np.frombuffer(c, "<i8" if k < 0 else "<u4").astype(np.int64)
        if block is not None:
            yield row()

    parts = docs.select(text).mapInArrow(count, "block int, counts binary")
    summed = parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, counts binary").collect()
    df, n = np.zeros((CELLS // CELL_BLOCK, CELL_BLOCK), np.int64), 0
    for row in summed:                         # at most CELLS numbers
        values = np.frombuffer(row.counts, np.int64)
        if row.block < 0:
            n = int(values[0])
        else:
            df[row.block] = values
    df = np.clip(df.ravel(), 1, max(n, 1))
    return 1.0 + np.log(max(n, 1) / df) / (4.0 * math.log(max(n, 3))), n


def _sketches(docs: DataFrame, shared) -> DataFrame:
    """(sha, bands) of every row."""
    def run(batches):
        for b in slices(batches, "text"):
            sets = shingle_sets(texts_of(b))
            full = [i for i, s in enumerate(sets) if len(s[0])]
            samples = sketch([sets[i] for i in full], shared.value) if full else np.zeros((0, SAMPLES), np.uint64)
            bands = np.zeros((len(full), BANDS), np.uint64)
            for j in range(ROWS):
                bands = mix(bands * np.uint64(31) + samples[:, j::ROWS] + np.uint64(j))
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64)[None, :])
            rows = [[0]] * len(sets)               # texts without words meet in one bucket
            for k, i in enumerate(full):
                rows[i] = bands[k].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(rows, pa.list_(pa.int64()))], ["sha", "bands"])

    return docs.select(_sha(F.col("text")).alias("sha"), "text").mapInArrow(
        run, "sha string, bands array<bigint>")


def _verify(pairs: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """The pairs (a, b), each once, whose texts reach the threshold.  A text
    that is part of very many pairs is copied per salt, so its pairs spread."""
    total = pairs.count()
    hot = stage(hot_keys(pairs.select("a"), "a", total).withColumn(
        "salts", F.ceil(F.col("n") * HOT_SHARE / F.lit(max(total, 1))).cast("int")).select("a", "salts"), "hot")
    salted = (pairs.join(F.broadcast(hot), "a", "left")
              .withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts"))
    hubs = (texts.join(F.broadcast(hot), texts.uid == hot.a, "left")
            .select(F.col("uid").alias("a"), F.col("text").alias("text_a"),
                    F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")))
    rows = (salted.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b")
            .join(hubs, ["a", "salt"]).select("a", "b", "text_a", "text_b"))

    def run(batches):
        last, hub = None, None
        for batch in slices(batches, "text_b"):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2).to_pylist(), shingle_sets(texts_of(batch, "text_b"))
            found = []
            for i, node in enumerate(a):
                if node != last:
                    last, hub = node, shingle_sets([ta[i] or ""])[0]
                found.append(similarity(hub, tb[i], shared.value) >= THRESHOLD)
            keep = [i for i, ok in enumerate(found) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()),
                                              pa.array([b[i] for i in keep], pa.int64())], ["u", "v"])

    return stage(rows.mapInArrow(run, "u bigint, v bigint"), "links", batch_rows=1000)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, text) of the wanted (uid, sha): rows that a Bloom filter of the
    hashes rules out are not shuffled."""
    bloom, n_blocks = repeated_filter(wanted, "sha", wanted.count(), least=1)
    hashed = docs.select(_sha(F.col("text")).alias("sha"), "text")
    maybe = mark_candidates(hashed, "sha", stage(bloom, "bloom"), n_blocks).filter("__maybe").drop("__maybe")
    one = maybe.groupBy("sha").agg(F.max("text").alias("text"))
    return stage(one.join(wanted, "sha").select("uid", "text"), "texts")


def _split_buckets(members: DataFrame, root: DataFrame) -> DataFrame:
    """(bucket, uid, root, block, blocks) of the members of buckets of four or
    more (in smaller ones the stars are all pairs) that hold more than one
    component; of buckets with the same members one is enough."""
    known = stage(members.join(root, members.uid == root.node, "left").select(
        "bucket", "uid", F.coalesce("root", "uid").alias("root")), "rooted")
    buckets = known.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "uid")).alias("y"))
    buckets = buckets.filter("n > 3 AND low < high").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    return (known.join(buckets.select("bucket", blocks.alias("blocks")), "bucket")
            .withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")))


def block_links(rows: list[dict], other: list[dict], idf: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of different components: among ``rows``, or of
    ``rows`` with ``other``.  All similarities of the block come from one
    product of matrices; of the links between two components one is returned."""
    both = rows + other
    sets = shingle_sets([r["text"] or "" for r in both])
    # a shingle that occurs k times is k columns, so the sum of minima is a product
    lens = [int(c.sum()) for _, c in sets]
    hashes = np.concatenate([np.repeat(h, c) for h, c in sets])
    nth = np.concatenate([np.arange(n) - np.repeat(np.cumsum(c) - c, c) for (_, c), n in zip(sets, lens)]).astype(np.uint64)
    owner = np.repeat(np.arange(len(both)), lens)
    weight = idf[(hashes >> np.uint64(44)).astype(np.int64)]
    total = np.bincount(owner, weight, len(both))
    _, column, times = np.unique(mix(hashes + nth * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner, weight = column[shared], owner[shared], weight[shared]
    order = np.argsort(column, kind="stable")
    column, owner, weight = column[order], owner[order], weight[order]
    column = np.cumsum(np.concatenate(([0], np.diff(column) > 0))) if len(column) else column
    n, m = len(rows), len(other)
    inter = np.zeros((n, m or n))
    width = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, 4096):
        x, y = np.searchsorted(column, [low, low + 4096])
        dense = np.zeros((n + m, min(4096, width - low)))
        dense[owner[x:y], column[x:y] - low] = 1.0
        by_column = np.zeros(dense.shape[1])
        by_column[column[x:y] - low] = weight[x:y]
        inter += (dense[:n] * by_column) @ (dense[n:] if m else dense).T
    left, right = total[:n, None], (total[n:] if m else total)[None, :]
    alike = inter >= THRESHOLD * (left + right - inter)
    roots = np.array([r["root"] for r in both])
    pairs = np.argwhere(alike & (roots[:n, None] != (roots[n:] if m else roots)[None, :]))
    found = {}
    for i, j in pairs.tolist():
        a, b = rows[i], (other if m else rows)[j]
        found.setdefault((min(a["root"], b["root"]), max(a["root"], b["root"])), (a["uid"], b["uid"]))
    return list(found.values())


def _links_across(split: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """Links between different components inside the buckets: members are dealt
    into blocks of bounded size, and every pair of blocks is one row, compared
    as a whole; only links come out."""
    rows = split.join(texts, "uid")
    packed = stage(rows.groupBy("bucket", "block", "blocks").agg(
        F.collect_list(F.struct("uid", "root", "text")).alias("rows")), "packed")
    many = packed.filter("blocks > 1")
    left = many.select("bucket", F.col("block").alias("i"), F.expr("explode(sequence(0, blocks - 1))").alias("j"), "rows").filter("i < j")
    right = many.select("bucket", F.col("block").alias("j"), F.expr("explode(sequence(0, blocks - 1))").alias("i"),
                        F.col("rows").alias("other")).filter("i < j")
    apart = left.join(right, ["bucket", "i", "j"]).select("rows", "other")
    alone = packed.filter(F.size("rows") > 1).select("rows", F.expr("slice(rows, 1, 0)").alias("other"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                found = block_links(b.column(0)[i].as_py(), b.column(1)[i].as_py(), shared.value)
                if found:
                    u, v = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return stage(alone.unionByName(apart).mapInArrow(run, "u bigint, v bigint"), "across", batch_rows=8)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches(uid, sha), roots(node, root)) of the distinct texts."""
    idf, _ = document_frequencies(docs)
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    rows = stage(_sketches(docs, shared).dropDuplicates(["sha"]).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    entries = stage(rows.select("uid", F.explode("bands").alias("bucket")), "bands")
    by_hash = F.struct(F.xxhash64("uid"), "uid")
    hubs = entries.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("uid").alias("x"), F.max("uid").alias("y"), F.min(by_hash).alias("z"))
    hubs = stage(hubs.filter("n > 1").select("bucket", "x", "y", F.col("z.uid").alias("z")), "hubs")
    met = stage(lookup_join(entries, hubs, "bucket"), "met")
    pairs = (met.select("uid", F.explode(F.array("x", "y", "z")).alias("hub")).filter("uid != hub")
             .select(F.least("uid", "hub").alias("p"), F.greatest("uid", "hub").alias("q"), "hub", "uid")
             .groupBy("p", "q").agg(F.min("hub").alias("a"), F.max("uid").alias("m"))
             .select("a", F.when(F.col("a") == F.col("p"), F.col("q")).otherwise(F.col("p")).alias("b")))
    pairs = stage(pairs, "pairs")
    members = met.select("bucket", "uid")
    texts = _texts_of(docs, stage(rows.select("uid", "sha").join(members.select("uid").distinct(), "uid", "left_semi"), "wanted"))
    links = _verify(pairs, texts, shared)
    root = stage(components(links), "roots")
    across = _links_across(_split_buckets(members, root), texts, shared)
    if not across.isEmpty():
        known = root.select(F.col("node").alias("u"), F.col("root").alias("v"))
        root = stage(components(known.unionByName(across)), "roots")
    return rows.select("uid", "sha"), root


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its
    class), class_size (rows), kept."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stage(docs.select("doc_id", _sha(F.col("text")).alias("sha"))
                 .withColumn("rid", F.monotonically_increasing_id()), "rows")
    uids, root = _classes(docs)
    node_of = stage(uids.join(root, uids.uid == root.node, "left").select("sha", F.coalesce("root", "uid").alias("root")), "nodes")
    rooted = stage(lookup_join(rows, node_of, "sha"), "rooted")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    groups = stage(rooted.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size")), "classes")
    return lookup_join(rooted, groups, "root").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all columns: of every class the text of the
    smallest doc_id.  Rows whose hash a Bloom filter of the dropped texts rules
    out are not shuffled."""
    docs = drop_exact_duplicates(docs, doc_id, text)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    uids, root = _classes(narrow)
    ids = narrow.select(_sha(F.col("text")).alias("sha"), "doc_id")
    inside = uids.join(root, uids.uid == root.node).select("sha", "root").join(ids, "sha")
    inside = stage(inside, "inside")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")
    first = inside.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.sha").alias("sha"))
    gone = stage(inside.select("sha").distinct().join(first, "sha", "left_anti"), "gone")
    bloom, n_blocks = repeated_filter(gone, "sha", gone.count(), least=1)
    hashed = docs.select(F.struct("*").alias("d"), _sha(F.col(text)).alias("sha"))
    marked = mark_candidates(hashed, "sha", stage(bloom, "bloom"), n_blocks)
    stay = marked.filter("__maybe").join(gone, "sha", "left_anti")
    return marked.filter("NOT __maybe").select("d.*").unionByName(stay.select("d.*"))
