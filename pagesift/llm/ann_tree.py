"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` vectors in the order of a
hash) by spherical k-means with ``BRANCH`` children a node; every vector is
then indexed in the leaf it falls to.  A search walks the tree best bin first:
a priority queue holds the nodes seen but not entered, ordered by the cosine
of the query to their centres, and gives up leaf after leaf.  How many leaves
a query visits is calibrated: for ``CALIBRATION`` queries the exact neighbours
are found by brute force over all rows, and the number of visits is doubled,
then narrowed, until their recall in the visited leaves reaches the target; the
query's own entry does not count.  A query goes on beyond these visits until
its leaves hold ``k`` + 1 entries, so it finds ``k`` rows wherever there are so many.

Equal vectors are indexed once with their smallest ids (``k`` + 1 of them
suffice for any answer), so a vector that a third of all rows repeat is one
entry.  Leaves and the queries that visit them are cut into blocks of bounded
size; every pair of blocks is one task row, so neither a large leaf nor a much
visited one lands in one task.

Defined results: rows whose vector is null, empty, zero, holds null or
non-finite components or has not the most common length, and rows without id
take no part; a row is not its own neighbour, but another row with the same id
or an equal vector may be; ties go to the smaller id; fewer than k candidates
give that many rows; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, stage

SAMPLE = 16384
BRANCH = 8
LEAF_ROWS = 512            # rows a leaf should hold, as far as the sample allows
MIN_SAMPLE_LEAF = 16
CALIBRATION = 256
MEMBER_BLOCK, QUERY_BLOCK = 2048, 1024


class Tree:
    """Hierarchical k-means over unit vectors; nodes in one flat list."""

    def __init__(self, x: np.ndarray, leaf_size: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.children: list[list[int]] = [[]]
        self.centres = [x.mean(axis=0) if len(x) else np.zeros(0)]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_size:
                continue
            k = int(min(BRANCH, -(-len(rows) // leaf_size)))
            centres, label = self._kmeans(x[rows], k, rng)
            parts = [(c, rows[label == j]) for j, c in enumerate(centres) if (label == j).any()]
            if len(parts) < 2:
                continue
            for c, part in parts:
                self.children.append([])
                self.centres.append(c)
                self.children[node].append(len(self.children) - 1)
                todo.append((len(self.children) - 1, part))
        self.centres = np.array(self.centres)
        self.leaves = [i for i, c in enumerate(self.children) if not c]

    @staticmethod
    def _kmeans(x, k, rng, rounds: int = 8):
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            label = (x @ centres.T).argmax(axis=1)
            for j in range(k):
                if (label == j).any():
                    c = x[label == j].sum(axis=0)
                    centres[j] = c / max(np.linalg.norm(c), 1e-300)
        return centres, (x @ centres.T).argmax(axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf every unit vector falls to."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids or not len(rows):
                out[rows] = node
                continue
            best = (x[rows] @ self.centres[kids].T).argmax(axis=1)
            todo += [(kid, rows[best == j]) for j, kid in enumerate(kids)]
        return out

    def best_bins(self, q: np.ndarray, visits: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``visits`` leaves of a best-bin-first walk, and more until
        they hold ``least`` entries by ``sizes`` (entries of each leaf)."""
        found, held, queue = [], 0, [(0.0, 0)]
        while queue and (len(found) < visits or held < least):
            _, node = heapq.heappop(queue)
            while self.children[node]:         # down to a leaf; the other children wait
                kids = self.children[node]
                near = self.centres[kids] @ q
                best = int(near.argmax())
                for j, kid in enumerate(kids):
                    if j != best:
                        heapq.heappush(queue, (-float(near[j]), kid))
                node = kids[best]
            found.append(node)
            held += sizes.get(node, 0) if sizes else 0
        return found


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _top(scores: np.ndarray, members: list, k: int):
    """Per query (row of scores) the k best (id, score) among members' ids."""
    n = scores.shape[1]
    for i in range(len(scores)):
        row = scores[i]
        if n > k:
            floor = np.partition(row, n - k)[n - k]
            some = np.flatnonzero(row >= floor)
        else:
            some = np.arange(n)
        pairs = sorted((-row[j], v) for j in some for v in members[j])[:k]
        yield i, [(v, -s) for s, v in pairs]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row of
    ``queries`` among the rows of ``vectors``, both (vec_id, embedding);
    queries are rows of vectors."""
    spark = vectors.sparkSession
    known, dim = _valid(vectors)
    asked, _ = _valid(queries, dim)
    keep = k + 1
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    entries = (known.withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= keep)
               .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
               .withColumn("gid", F.monotonically_increasing_id()))
    entries = stage(entries, "entries")
    asked = stage(lookup_join(stage(asked, "asked"), entries.select("embedding", "gid"), "embedding")
                  .select("vec_id", "gid"), "queries")
    query_rows = stage(entries.join(asked.select("gid").distinct(), "gid", "left_semi").select("gid", "embedding"), "qvec")

    n_entries = entries.count()
    sample = entries.orderBy(F.xxhash64("embedding")).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    x = _unit(np.array([np.asarray(v, np.float64) for v in sample])) if len(sample) else np.zeros((0, dim or 0))
    leaves = max(1, min(n_entries // LEAF_ROWS, len(x) // MIN_SAMPLE_LEAF))
    shared = spark.sparkContext.broadcast(Tree(x, -(-len(x) // leaves) if len(x) else 1))

    def to_leaf(batches):
        for b in batches:
            at = shared.value.leaf_of(_unit(_matrix(b.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *b.columns], ["leaf", *b.schema.names])

    kind = vectors.schema["embedding"].dataType.simpleString()
    index = stage(entries.select("embedding", "gid", "ids").mapInArrow(
        to_leaf, f"leaf int, embedding {kind}, gid bigint, ids array<bigint>"), "index")
    visits = calibrate(index, query_rows, shared, keep, recall)
    # one number per leaf, and the leaves are bounded by the sample
    sizes = spark.sparkContext.broadcast({r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()})

    def to_bins(batches):
        for b in batches:
            q = _unit(_matrix(b.column(0)))
            bins = [shared.value.best_bins(v, visits, sizes.value, keep) for v in q]
            size = np.array([len(x) for x in bins])
            at = pa.array(np.repeat(np.arange(len(bins)), size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*bins, []]).astype(np.int32)), b.column(0).take(at), b.column(1).take(at)],
                ["leaf", "embedding", "gid"])

    wanted = stage(query_rows.select("embedding", "gid").mapInArrow(
        to_bins, f"leaf int, embedding {kind}, gid bigint"), "visits")
    # at most one row per leaf, and the leaves are bounded by the sample
    blocks = (index.groupBy("leaf").agg(F.count(F.lit(1)).alias("m"))
              .join(wanted.groupBy("leaf").agg(F.count(F.lit(1)).alias("q")), "leaf")
              .select("leaf", F.ceil(F.col("m") / MEMBER_BLOCK).alias("mb"), F.ceil(F.col("q") / QUERY_BLOCK).alias("qb")))
    blocks = F.broadcast(stage(blocks, "blocks"))

    def packed(rows, own, other, fields):
        own_block, all_blocks = F.pmod(F.xxhash64("gid"), F.col(own)).alias(own), f"sequence(0, {other} - 1)"
        p = rows.join(blocks, "leaf").select("leaf", own_block, other, F.struct(*fields).alias("r"))
        p = p.groupBy("leaf", own, other).agg(F.collect_list("r").alias(f"rows_{own}"))
        return p.select("leaf", own, F.explode(F.expr(all_blocks)).alias(other), f"rows_{own}")

    pairs = packed(index, "mb", "qb", ["embedding", "ids"]).join(
        packed(wanted, "qb", "mb", ["embedding", "gid"]), ["leaf", "mb", "qb"]).select("rows_mb", "rows_qb")

    def compare(batches):
        for b in batches:
            for i in range(b.num_rows):
                m, q = b.column(0)[i].values, b.column(1)[i].values
                scores = _unit(_matrix(q.field("embedding"))) @ _unit(_matrix(m.field("embedding"))).T
                who = q.field("gid").to_numpy(zero_copy_only=False)
                out = [(int(who[j]), v, s) for j, best in _top(scores, m.field("ids").to_pylist(), keep) for v, s in best]
                g, v, s = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(v, pa.int64()),
                                                  pa.array(s, pa.float64())], ["gid", "cand", "score"])

    near = pairs.mapInArrow(compare, "gid bigint, cand bigint, score double")
    best = Window.partitionBy("gid").orderBy(F.desc("score"), "cand")
    near = near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= keep)
    near = near.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("n", "cand", "score"))).alias("near"))
    answered = lookup_join(asked, stage(near, "near"), "gid")
    # a row is not its own neighbour: its id goes once, where the vector is its own (largest score)
    own = F.coalesce(F.array_position(F.transform("near", lambda c: c["cand"]), F.col("vec_id")), F.lit(0))
    others = F.slice(F.filter("near", lambda c, i: i + 1 != F.col("own")), 1, k)
    return (answered.withColumn("own", own).select("vec_id", F.posexplode(others).alias("i", "c"))
            .select(F.col("vec_id").alias("query_id"), (F.col("i") + 1).cast("int").alias("rank"),
                    F.col("c.cand").alias("vec_id"), F.col("c.score").alias("score")))


def _valid(rows: DataFrame, dim: int | None = None) -> tuple[DataFrame, int | None]:
    """Rows that take part, and the length of their vectors."""
    e = F.col("embedding")
    ok = (F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)
          & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.coalesce(ok, F.lit(False)))
    if dim is None:
        common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = common.d if common else None
    return (rows.filter(F.size("embedding") == dim) if dim else rows.limit(0)), dim


def exact(index: DataFrame, queries: np.ndarray, keep: int) -> DataFrame:
    """(q, cand, leaf, score): brute force over all entries, for calibration
    and for measuring recall; queries is a bounded matrix of unit vectors."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for b in batches:
            scores = shared.value @ _unit(_matrix(b.column(0))).T
            leaf, gid = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for q in range(len(scores)):
                some = np.argsort(-scores[q], kind="stable")[:keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), q, np.int32)), pa.array(gid[some]), pa.array(leaf[some]),
                     pa.array(scores[q][some])], ["q", "gid", "leaf", "score"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "gid")
    found = index.select("embedding", "leaf", "gid").mapInArrow(run, "q int, gid bigint, leaf int, score double")
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= keep).drop("n")


def calibrate(index: DataFrame, query_rows: DataFrame, shared, keep: int, recall: float) -> int:
    """Leaf visits at which the calibration queries find ``recall`` of their
    true neighbours: doubled until it is reached, then narrowed by halving."""
    some = query_rows.orderBy(F.xxhash64("embedding")).limit(CALIBRATION).select("embedding", "gid").toPandas()
    own, some = some["gid"].tolist(), some["embedding"]
    if not len(some):
        return 1
    q = _unit(np.array([np.asarray(v, np.float64) for v in some]))
    truth = exact(index, q, keep).select("q", "gid", "leaf").collect()       # CALIBRATION x keep rows
    truth = [r for r in truth if r.gid != own[r.q]]
    if not truth:
        return 1
    tree = shared.value
    place = [{leaf: i for i, leaf in enumerate(tree.best_bins(v, len(tree.leaves)))} for v in q]
    depth = np.array([place[r.q][r.leaf] for r in truth])
    high = 1
    while high < len(tree.leaves) and (depth < high).mean() < recall:
        high *= 2
    low, high = high // 2, min(high, len(tree.leaves))
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if (depth < mid).mean() >= recall else (mid, high)
    return high
