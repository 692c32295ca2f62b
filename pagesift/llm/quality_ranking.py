"""Quality classifier: Bradley-Terry ranking of documents.

A document has the strength w.x of its features x; that a document labelled 1
is preferred to one labelled 0 has the probability 1 / (1 + exp(-(w.x - w.y))).
w is learned by logistic loss on feature differences over preference pairs
(each document is paired with ``OPPONENTS`` of the other label).  The loss knows
no level, so the decision is a quantile of the strengths: the threshold leaves
that share of the labelled documents below it that all training labels give the
label 0.  The score is a logistic curve of the strength through ``CUT`` at the
threshold, with the slope of least logistic loss, so ``score >= CUT`` and
``strength >= threshold`` are the same.  Threshold and slope come from a fifth
of the training documents, which w has not seen.

Features describe the whole text: shares of byte classes and of their
neighbourhoods, word and line lengths, repetition of words, word pairs and
lines, hashed word shapes and hashed words.

All training documents train.  Their vectors are made in tasks and kept as
blocks of about ``BLOCK`` documents, dealt by a hash of doc_id, so the blocks do
not depend on the number of tasks; a document is paired inside its block (a
block short of one label borrows documents of it).  Every step of the descent
is a pass over all blocks, of which one sum a task reaches the driver.  A
bounded sample (``ROWS_PER_LABEL`` documents of each label, first in the order of
a hash of doc_id) only gives the weights the descent starts from.  The quantile
is found by counts in ever finer bins.  Texts never reach the driver.

Defined results: null or empty texts have the zero vector, which has a score
like any other; doc_ids labelled both 0 and 1 and labels other than 0 and 1 do
not train; of a repeated doc_id the smallest text trains; a null doc_id matches
no label and is not held out; without training labels of both kinds every score
is 0.5; scores depend on the text alone; an empty table gives no rows.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, texts_of
from .exact_dedup import mark_candidates, repeated_filter

ROWS_PER_LABEL = 2000   # documents of the sample with each label
BLOCK = 1024            # training documents to a block
TASKS = 2000            # most partitions that make blocks
PASSES = 80             # most passes over all blocks
LEAST_GAIN = 1e-4       # of the loss: a step that gains less is the last
BINS = 4096             # of a histogram of strengths
OPPONENTS = 16          # pairs of each document
STEPS = 400
DECAY = 1e-4
CUT = 0.3

WORDS, SHAPES, CLASSES = 1024, 256, 9
STATS = 14
WIDTH = STATS + CLASSES + CLASSES * CLASSES + SHAPES + WORDS
FEW_WORDS = 16          # words that a short text lacks before single words say much
DOCS_AT_A_TIME = 1024

UPPER, LOWER, DIGIT, BLANK, LINE, MARK, SYMBOL, LEAD, REST = range(CLASSES)


def _byte_class(c: int) -> int:
    if c >= 128:
        return REST if c < 192 else LEAD
    x = chr(c)
    return (UPPER if x.isupper() else LOWER if x.islower() else DIGIT if x.isdigit() else LINE if x == "\n"
            else BLANK if x.isspace() else MARK if x in ".,;:?!'\"()-" else SYMBOL)


CLASS = np.array([_byte_class(c) for c in range(256)], np.uint8)
# letters and digits become one sign of their class, all else stays
SHAPE = bytes(b"Aa0"[k] if k <= DIGIT else ord("x") if k >= LEAD else c for c, k in enumerate(CLASS.tolist()))


def features(texts: list[str]) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts):
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        if not words:
            continue
        n, lines = len(words), [x for x in data.split(b"\n") if x.strip()]
        kinds = CLASS[np.frombuffer(data, np.uint8)].astype(np.int64)
        single = np.bincount(kinds, minlength=CLASSES) / len(kinds)
        double = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES) / len(kinds)
        counts = Counter(words)
        most = counts.most_common(1)[0][1]
        lengths = np.fromiter(map(len, words), np.int64, n)
        pairs = len(set(zip(words, words[1:])))
        row[:STATS] = [
            np.log1p(n), np.log1p(len(lines)), np.log(lengths.mean()), lengths.std() / 10, (lengths > 20).mean(),
            len(counts) / n, most / n, sum(map(operator.eq, words, words[1:])) / n, pairs / max(1, n - 1),
            len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(x.rstrip()[-1:] in b".?!" for x in lines) / len(lines),
            sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n,
            sum(c for w, c in counts.items() if w[-1:] in b"#$%&*|~^_=+<>\\/@") / n]
        at = STATS
        row[at:at + CLASSES] = single
        at += CLASSES
        row[at:at + CLASSES * CLASSES] = double
        at += CLASSES * CLASSES
        distinct = list(counts)
        many = np.fromiter(counts.values(), np.float64, len(distinct))
        shapes = [w.translate(SHAPE) for w in distinct]
        bucket = np.fromiter((zlib.crc32(s[:2] + b":" + s[-3:]) for s in shapes), np.int64, len(shapes)) % SHAPES
        row[at:at + SHAPES] = np.sqrt(np.bincount(bucket, many, SHAPES) / (n + FEW_WORDS))
        at += SHAPES
        bucket = np.fromiter(map(zlib.crc32, map(bytes.lower, distinct)), np.int64, len(distinct)) % WORDS
        row[at:] = np.sqrt(np.bincount(bucket, many, WORDS) / (n + FEW_WORDS))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def preference_pairs(good: np.ndarray, bad: np.ndarray, opponents: int = OPPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(preferred, other) rows: every document meets ``opponents`` of the other
    label, spread evenly."""
    few, many = sorted((good, bad), key=len)
    k = np.arange(len(many))
    a = np.concatenate([few[(k + r * max(1, len(few) // opponents)) % len(few)] for r in range(opponents)])
    b = np.tile(many, opponents)
    return (a, b) if few is good else (b, a)


def rank_weights(x: np.ndarray, first: np.ndarray, second: np.ndarray, steps: int = STEPS, decay: float = DECAY) -> np.ndarray:
    """w of least mean logistic loss of w.(x[first] - x[second]), by adaptive
    gradient steps over all pairs."""
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        strength = x @ w
        pull = _sigmoid(strength[second] - strength[first]) / len(first)
        each = np.bincount(second, pull, len(x)) - np.bincount(first, pull, len(x))
        g = x.T @ each + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def share_quantile(strength: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The strength that leaves ``share`` of the weight below it, midway
    between its neighbours."""
    order = np.argsort(strength)
    s, below = strength[order], np.cumsum(weight[order]) / weight.sum()
    k = min(int(np.searchsorted(below, share)), len(s) - 1)
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def fit(vectors: np.ndarray, labels: np.ndarray, share_bad: float | None = None) -> dict | None:
    """The model of labelled vectors: centre, scale, weights, threshold and
    slope; None without both labels.  ``share_bad``: the share of the label 0
    among all labels, where the sample has another."""
    labels = np.asarray(labels, np.int64)
    if min((labels == 1).sum(), (labels == 0).sum()) == 0:
        return None
    share_bad = float((labels == 0).mean()) if share_bad is None else share_bad
    apart = np.zeros(len(labels), bool)
    for y in (0, 1):
        apart[np.flatnonzero(labels == y)[4::5]] = True
    if min((labels[apart] == y).sum() for y in (0, 1)) == 0:
        apart[:] = True                        # too few for a part of their own
    seen = ~apart if not apart.all() else apart
    x = vectors.astype(np.float64)
    centre, scale = x[seen].mean(axis=0), x[seen].std(axis=0) + 0.01
    x = (x - centre) / scale
    rows = np.flatnonzero(seen)
    w = rank_weights(x, *preference_pairs(rows[labels[rows] == 1], rows[labels[rows] == 0]))
    strength, y = (x @ w)[apart], labels[apart]
    weight = np.where(y == 0, share_bad / (y == 0).sum(), (1 - share_bad) / (y == 1).sum())
    threshold = share_quantile(strength, weight, share_bad)
    level = np.log(CUT / (1 - CUT))

    def loss(k):
        z = (strength - threshold) * k + level
        return float((weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum())

    slope = min(np.geomspace(1e-3, 1e2, 61), key=loss)
    return {"centre": centre, "weights": w / scale, "threshold": threshold, "slope": float(slope), "level": float(level)}


def scores(model: dict | None, vectors: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(vectors), 0.5)
    strength = (vectors - model["centre"]) @ model["weights"]
    return _sigmoid(np.clip((strength - model["threshold"]) * model["slope"] + model["level"], -30, 30))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the documents that train."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _counts(each: DataFrame) -> dict[int, int]:
    return {int(r.quality): r.n for r in each.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}


def _apart(doc_id: Column) -> Column:
    """Documents that set threshold and slope and train no weight."""
    return F.pmod(F.xxhash64(F.lit(5), doc_id), F.lit(5)) == 4


def _first(docs: DataFrame, each: DataFrame, rows: int) -> DataFrame:
    first = [each.filter(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    texts = _texts(docs).join(F.broadcast(first[0].unionByName(first[1])), "doc_id")
    return texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_LABEL) -> tuple[DataFrame, float]:
    """(doc_id, quality, text) of the bounded sample, and the share of the
    label 0 among all training labels."""
    each = labelled(labels)
    counts = _counts(each)
    return _first(docs, each, rows), counts.get(0, 0) / max(1, sum(counts.values()))


def blocks_of(docs: DataFrame, each: DataFrame, n: int) -> DataFrame:
    """(block, y, apart, x): the vectors of all documents of ``each(doc_id,
    quality)``, of which there are ``n``, in blocks that follow from doc_id.
    Texts without a label are left out by a filter before they are shuffled;
    labels and texts meet in their block, so texts are shuffled once."""
    blocks = max(1, -(-n // BLOCK))
    bloom, cells = repeated_filter(each.select(F.col("doc_id").cast("string").alias("key")), "key", n, least=1)
    texts = mark_candidates(_texts(docs).withColumn("key", F.col("doc_id").cast("string")), "key", bloom, cells).filter("__maybe")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    of_text = texts.select("doc_id", F.lit(None).cast("int").alias("quality"), "text")
    of_label = each.select(F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("quality").cast("int").alias("quality"),
                           F.lit(None).cast("string").alias("text"))
    rows = (of_text.unionByName(of_label).withColumn("block", block)
            .repartition(min(blocks, TASKS), "block").groupBy("block", "doc_id").agg(F.max("quality").alias("y"), F.min("text").alias("text"))
            .filter("y IS NOT NULL AND text IS NOT NULL").sortWithinPartitions("block", "doc_id")
            .select("block", "y", _apart(F.col("doc_id")).alias("apart"), "text"))

    def run(batches):
        block, held = None, []

        def whole():
            y, apart, x = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([d], pa.binary()) for d in (
                y.astype(np.uint8).tobytes(), apart.astype(np.uint8).tobytes(), pa.compress(x.tobytes(), codec="zstd", asbytes=True)))],
                ["block", "y", "apart", "x"])
        for b in slices(batches, "text"):
            for k in range(0, b.num_rows, DOCS_AT_A_TIME):
                part = b.slice(k, DOCS_AT_A_TIME)
                x = features(texts_of(part))
                of, y, apart = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                ends = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                for i, j in zip(ends, ends[1:]):
                    if held and of[i] != block:
                        yield whole()
                        held = []
                    block = int(of[i])
                    held.append((y[i:j], apart[i:j], x[i:j]))
        if held:
            yield whole()

    return stage(rows.mapInArrow(run, "block int, y binary, apart binary, x binary"), "vectors")


def _moments(y, apart, x):
    """Rows of each label, sums and squares, of those that train weights and those apart."""
    parts = [np.flatnonzero(apart == k) for k in (0, 1)]
    return (np.array([np.bincount(y[p], minlength=2) for p in parts], np.float64),
            np.array([x[p].sum(axis=0) for p in parts]), np.array([(x[p] ** 2).sum(axis=0) for p in parts]))


class Blocks:
    """The staged blocks, and sums over them that come together on the driver,
    one row a task."""

    def __init__(self, table: DataFrame):
        self.table, self.spare, self.every = table, {}, False
        n, total, square = self._sum(_moments, ((2, 2), (2, WIDTH), (2, WIDTH)))
        self.counts = n.sum(axis=0)                      # of each label
        self.every = n.min() == 0                        # too few for a part of their own
        seen = slice(None) if self.every else slice(0, 1)
        rows = max(1.0, n[seen].sum())
        self.of_apart = self.counts if self.every else n[1]
        self.centre = total[seen].sum(axis=0) / rows
        self.scale = np.sqrt(np.maximum(0, square[seen].sum(axis=0) / rows - self.centre ** 2)) + 0.01

    def _sum(self, fn, shapes):
        """``fn(y, apart, x)`` of every block, summed; its arrays have ``shapes``."""
        def run(batches):
            first, found = None, [np.zeros(s) for s in shapes]
            for block, y, apart, x in _unpacked(batches):
                first = block if first is None else first
                for into, more in zip(found, fn(y, apart, x)):
                    into += more
            if first is not None:
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([np.concatenate([f.ravel() for f in found]).tobytes()], pa.binary())],
                                                 ["first", "sums"])
        rows = sorted(self.table.mapInArrow(run, "first int, sums binary").collect(), key=lambda r: r.first)
        whole = sum((np.frombuffer(r.sums) for r in rows), np.zeros(sum(int(np.prod(s)) for s in shapes)))
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return [c.reshape(s) for c, s in zip(np.split(whole, ends[:-1]), shapes)]

    def loss(self, w: np.ndarray, decay: float = DECAY) -> tuple[float, np.ndarray]:
        """Mean logistic loss over the pairs of all blocks, with its gradient."""
        raw, spare, every = w / self.scale, self.spare, self.every

        def block(y, apart, x):
            if not every:
                y, x = y[apart == 0], x[apart == 0]
            for label, more in spare.items():            # the block is short of a label
                lacks = max(0, OPPONENTS - int((y == label).sum()))
                y, x = np.append(y, np.full(len(more[:lacks]), label)), np.concatenate([x, more[:lacks]])
            good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
            if not len(good) or not len(bad):
                return np.zeros(2), np.zeros(WIDTH)
            first, second = preference_pairs(good, bad)
            strength = x @ raw
            lead = strength[first] - strength[second]
            pull = _sigmoid(-lead)
            each = np.bincount(second, pull, len(x)) - np.bincount(first, pull, len(x))
            return np.array([np.logaddexp(0, -lead).sum(), len(first)]), x.T @ each
        (total, pairs), g = self._sum(block, ((2,), (WIDTH,)))
        return total / pairs + 0.5 * decay * float(w @ w), g / self.scale / pairs + decay * w

    def strengths(self, w: np.ndarray) -> DataFrame:
        """(y, s) of the documents that set threshold and slope."""
        raw, centre, every = w / self.scale, self.centre, self.every

        def run(batches):
            for _, y, apart, x in _unpacked(batches):
                rows = slice(None) if every else apart == 1
                yield pa.RecordBatch.from_arrays([pa.array(y[rows].astype(np.int32)), pa.array((x[rows] - centre) @ raw)], ["y", "s"])
        return stage(self.table.mapInArrow(run, "y int, s double"), "strengths")


def _unpacked(batches):
    for b in batches:
        for i in range(b.num_rows):
            block, y, apart, x = (c[i].as_py() for c in b.columns)
            y = np.frombuffer(y, np.uint8).astype(np.int64)
            x = pa.decompress(x, 4 * WIDTH * len(y), codec="zstd", asbytes=True)
            yield block, y, np.frombuffer(apart, np.uint8), np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(np.float64)


def descend(loss, w: np.ndarray, passes: int = PASSES, gain: float = LEAST_GAIN, memory: int = 10) -> np.ndarray:
    """The least of ``loss(w) -> (value, gradient)`` by limited-memory
    quasi-Newton steps, each halved until the value falls."""
    value, g = loss(w)
    used, steps = 1, []
    while used < passes:
        d, kept = -g, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            d, kept = d - a * y, [a, *kept]
        d = d * ((steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.linalg.norm(g)))
        for (s, y), a in zip(steps, kept):
            d = d + (a - (y @ d) / (s @ y)) * s
        size, found = 1.0, None
        while used < passes and found is None:
            new = w + size * d
            v, h = loss(new)
            used += 1
            found = (new, v, h) if v <= value + 1e-4 * size * (g @ d) else None
            size /= 2
            if size < 1e-6:
                return w
        if found is None:
            break
        new, v, h = found
        if (new - w) @ (h - g) > 0:
            steps = [*steps, (new - w, h - g)][-memory:]
        last = value - v < gain * value
        w, value, g = new, v, h
        if last:
            break
    return w


def quantile(strengths: DataFrame, weight: dict[int, float], share: float, few: int = BINS) -> float:
    """``share_quantile`` of ``strengths(y, s)`` whose rows weigh ``weight[y]``:
    counts in bins of the bin that holds it, until that has ``few`` rows."""
    low, high = strengths.agg(F.min("s"), F.max("s")).first()
    below, beyond = 0.0, high                            # weight below ``low``; the next strength above ``high``
    while True:
        part = strengths.filter(F.col("s").between(low, high))
        width = (high - low) / BINS
        of = F.least(F.floor((F.col("s") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        bins = sorted(part.groupBy(of.alias("bin")).agg(
            F.count(F.when(F.col("y") == 0, 1)).alias("n0"), F.count(F.when(F.col("y") == 1, 1)).alias("n1"),
            F.min("s").alias("low"), F.max("s").alias("high")).collect(), key=lambda r: r.low)
        for k, r in enumerate(bins):
            held = r.n0 * weight[0] + r.n1 * weight[1]
            if below + held >= share or k == len(bins) - 1:
                break
            below += held
        beyond = bins[k + 1].low if k + 1 < len(bins) else beyond
        low, high = r.low, r.high
        if low == high:                                  # all alike: the last of them has the next strength above it
            last = below + held - max(weight.values()) < share
            return float((low + (beyond if last else low)) / 2)
        if r.n0 + r.n1 <= few:
            break
    rows = sorted((s, y) for y, s in strengths.filter(F.col("s").between(low, high)).collect())
    s = np.array([x[0] for x in rows] + [beyond])
    k = min(int(np.searchsorted(below + np.cumsum([weight[y] for _, y in rows]), share)), len(rows) - 1)
    return float((s[k] + s[k + 1]) / 2)


def _slope(strengths: DataFrame, weight: dict[int, float], threshold: float, level: float) -> float:
    """The slope of least logistic loss over all ``strengths``."""
    tried = np.geomspace(1e-3, 1e2, 61)

    def run(batches):
        total = np.zeros(len(tried))
        for b in batches:
            y, s = (c.to_numpy() for c in b.columns)
            each = np.where(y == 0, weight[0], weight[1])
            total += [float((each * np.logaddexp(0, np.where(y == 1, -1, 1) * ((s - threshold) * k + level))).sum()) for k in tried]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["losses"])
    found = sorted(r.losses for r in strengths.mapInArrow(run, "losses array<double>").collect())
    return float(tried[np.argmin(np.sum(found, axis=0))])


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_LABEL) -> dict | None:
    """The model of all training documents, from the weights of a bounded sample."""
    each = stage(labelled(labels), "labelled")
    counts = _counts(each)
    if len(counts) < 2:
        return None
    blocks = Blocks(blocks_of(docs, each, sum(counts.values())))
    if blocks.counts.min() == 0:
        return None

    def run(batches):
        for b in slices(batches, "text"):
            for k in range(0, b.num_rows, DOCS_AT_A_TIME):
                part = b.slice(k, DOCS_AT_A_TIME)
                x = features(texts_of(part))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "quality", "apart", "x"])

    few = _first(docs, each, rows).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("int").alias("quality"),
                                          _apart(F.col("doc_id")).alias("apart"), "text")
    found = few.mapInArrow(run, "doc_id string, quality int, apart boolean, x binary").collect()
    found = sorted((r for r in found if blocks.every or not r.apart), key=lambda r: (zlib.crc32(r.doc_id.encode()), r.doc_id))
    x = np.array([np.frombuffer(r.x, np.float32) for r in found]).reshape(len(found), WIDTH)
    y = np.array([r.quality for r in found], np.int64)
    start = fit(x, y)
    if sum(counts.values()) > BLOCK:
        blocks.spare = {k: x[y == k][:OPPONENTS].astype(np.float64) for k in (0, 1)}
    w = descend(blocks.loss, np.zeros(WIDTH) if start is None else start["weights"] * blocks.scale)
    share_bad, level = counts[0] / sum(counts.values()), float(np.log(CUT / (1 - CUT)))
    weight = {k: float(s / n) for k, s, n in zip((0, 1), (share_bad, 1 - share_bad), blocks.of_apart)}
    strengths = blocks.strengths(w)
    threshold = quantile(strengths, weight, share_bad)
    return {"centre": blocks.centre, "weights": w / blocks.scale, "threshold": threshold,
            "slope": _slope(strengths, weight, threshold, level), "level": level}


def classify(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs(doc_id, text)``;
    ``labels(doc_id, quality)`` train."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def run(batches):
        for b in slices(batches, "text"):
            texts = texts_of(b)
            score = np.concatenate([scores(shared.value, features(texts[k:k + DOCS_AT_A_TIME])) for k in range(0, len(texts), DOCS_AT_A_TIME)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")
