"""Exact dedup: a two-pass Bloom filter finds the possibly repeated hashes;
only those rows shuffle, all other rows pass straight through.

Pass 1 sets, for every row, ``K`` bits of a blocked Bloom filter (one
32,768-bit block per hash, built-in bitmap aggregates) and keeps only the bits
that two or more rows set.  A repeated hash has all its bits kept, so pass 2
can let every row with a missing bit through as unique.  Rows that remain
(repeats plus a small share of false positives) are grouped exactly by their
SHA-256, so the filter never changes a result, only how much shuffles.

The filter has 16 bits a row up to ``MAX_BLOCKS`` blocks (64 MB, the broadcast
bound); beyond that bound (about 33 million rows) more unique rows take the
shuffled way and the rows returned stay the same.

Defined results: a null text counts as empty; equal texts form one group
whatever their other columns; among equal doc_ids one row stays; a null doc_id
is smaller than any other; an empty table gives an empty result; other columns
are never read by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, stage

BITS = 32768          # bits of one block: what one bitmap of Spark holds
K = 3                 # bits a row sets in its block
BITS_PER_ROW = 16
MAX_BLOCKS = 16384    # x 4 KB = 64 MB at most to broadcast


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(n_blocks)).cast("int")


def _positions(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit(2), key)
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BITS - 1)).cast("int") for i in range(K)]


def repeated_filter(keys: DataFrame, key: str, n_rows: int, least: int = 2) -> tuple[DataFrame, int]:
    """Pass 1: ``(block, bits)`` with the bits that at least ``least`` rows set
    (1: an ordinary Bloom filter of the keys)."""
    n_blocks = max(1, min(MAX_BLOCKS, -(-n_rows * BITS_PER_ROW // BITS)))
    bits = keys.select(_block(F.col(key), n_blocks).alias("block"),
                       F.explode(F.array_distinct(F.array(*_positions(F.col(key))))).alias("bit"))
    twice = (bits.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
             .groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits")))
    return twice, n_blocks


def mark_candidates(rows: DataFrame, key: str, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """Pass 2: adds boolean ``__maybe``; false means the key is surely unique."""
    joined = rows.withColumn("block", _block(F.col(key), n_blocks)).join(F.broadcast(bloom), "block", "left")

    def is_set(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(p, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.pow(F.lit(2), p.bitwiseAND(F.lit(7))).cast("int")) > 0

    hit = F.col("bits").isNotNull()
    for p in _positions(F.col(key)):
        hit = hit & is_set(p)
    return joined.withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("block", "bits")


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256.  Of equal texts the row with the largest doc_id stays."""
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), _sha(F.col(text)).alias("text_sha256"))
                 .withColumn("__rid", F.monotonically_increasing_id()), "hashes")
    bloom, n_blocks = repeated_filter(rows, "text_sha256", rows.count())
    marked = stage(mark_candidates(rows, "text_sha256", bloom, n_blocks), "marked")
    alone = marked.filter(~F.col("__maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    maybe = marked.filter("__maybe").drop("__maybe")
    groups = stage(maybe.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "__rid")).alias("__keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    together = lookup_join(maybe, groups, "text_sha256").select(
        "doc_id", F.col("__keep.doc_id").alias("keep_id"), "group_size",
        (F.col("__rid") == F.col("__keep.__rid")).alias("kept"), "text_sha256")
    return alone.unionByName(together)


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``.  Rows that are surely
    unique are not shuffled; the rest is reduced to one row per text with
    map-side combine, so a text that a third of all rows repeat reaches the
    shuffle as one row per task.  Ties in doc_id go to the largest row by the
    sortable columns; full ties are interchangeable."""
    hashed = docs.select(F.struct("*").alias("__d"), F.col(doc_id).alias("__id"), _sha(F.col(text)).alias("__sha"))
    bloom, n_blocks = repeated_filter(stage(hashed.select("__sha"), "hashes"), "__sha", docs.count())
    marked = mark_candidates(hashed, "__sha", stage(bloom, "bloom"), n_blocks)
    sortable = [F.col(f"__d.`{f.name}`").cast("string") for f in docs.schema.fields
                if f.dataType.typeName() in ("string", "long", "integer", "double", "timestamp", "date", "boolean")]
    first = marked.filter("__maybe").groupBy("__sha").agg(
        F.max_by("__d", F.struct("__id", *sortable)).alias("__d"))
    return marked.filter(~F.col("__maybe")).select("__d.*").unionByName(first.select("__d.*"))
