"""Source divergence audit with duplicate-text collapse.

How far the sources of a language differ in their words: each group (lang,
source) and each language gives every kept term (in at least ``MIN_DOCS``
documents of the language) the smoothed share p = 1 + floor(10^9 (count + 2) /
(N + 2V)), and two shares differ by f = floor((p - q)^2 / (p + q)).

1. Collapse: identical texts of a language become one row with its sources and
   their multiplicities.  A Bloom filter finds possible repeats; only those
   rows shuffle, reduced per (lang, text, source) before they do.
2. Each text left is tokenized once; its term counts and document frequencies
   are added for each of its sources, times the multiplicity, up to ``HELD``
   counts inside a task, and summed by one aggregate over (lang, source, term).
3. Pairs are evaluated sparsely.  With a0 the share of a term that a lacks and
   H(a, b) = sum over all kept terms of f(a_t, b0),
       sum f(a_t, b_t) = H(a, b) + H(b, a) - V f(a0, b0)
                       + sum over common terms of f(a_t, b_t) - f(a_t, b0) - f(a0, b_t) + f(a0, b0).
   H needs only how many terms of a have each count; the last sum runs inside
   tasks over the entries of a term (blocks of ``BLOCK`` sources), which send
   sums per pair of sources, never a row per pair and term.

All arithmetic is on integers.  Shares take up to 10^9 + 1, so products fit 64
bits; 10^9 (count + 2) is taken in decimals.

Defined results: null text, lang and source count as ''; repeated rows are
documents of their own; a language without kept terms has value 0 for all pairs
and no term rows; a single source has no pairs; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, slices, stage
from .exact_dedup import mark_candidates, repeated_filter

MIN_DOCS = 10         # documents of its language that a kept term is in
TOP_TERMS = 10        # ranks of the part ``term``
BLOCK = 512           # sources of a block; two blocks have at most 2^18 pairs
PAIRS = 1 << 20       # pairs evaluated at a time
SALTS = 64            # parts of the counts of one group
SLICE = 4 << 20
HELD = 250_000        # counts a task holds before it sends them on

# letters A-Z as a-z, all other ASCII but a-z as blanks; bytes of other characters stay
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(text: str, piece: int = SLICE) -> Counter:
    """Occurrences of each term (UTF-8) of a whole text, cut at blanks so that
    the list of words of a very long text stays small."""
    data, found, at = text.encode("utf-8", "surrogatepass").translate(LETTERS), Counter(), 0
    while at < len(data):
        cut = len(data) if len(data) - at <= piece else data.find(b" ", at + piece)
        cut = len(data) if cut < 0 else cut
        found.update(data[at:cut].split())
        at = cut
    return found


def collapse(docs: DataFrame) -> DataFrame:
    """(lang, text, sources, copies): one row per distinct text of a language
    that may repeat, one per row for texts that surely do not."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    keyed = rows.withColumn("__key", F.sha2(F.concat_ws(":", F.length("lang").cast("string"), "lang", "text").cast("binary"), 256))
    keys = stage(keyed.select("__key"), "text-keys")
    bloom, n_blocks = repeated_filter(keys, "__key", keys.count())
    marked = mark_candidates(keyed, "__key", stage(bloom, "bloom"), n_blocks).drop("__key")
    alone = marked.filter(~F.col("__maybe")).select("lang", "text", F.array("source").alias("sources"), F.array(F.lit(1).cast("long")).alias("copies"))
    by_source = marked.filter("__maybe").groupBy("lang", "text", "source").agg(F.count(F.lit(1)).alias("n"))
    together = by_source.groupBy("lang", "text").agg(F.collect_list(F.struct("source", "n")).alias("s")).select(
        "lang", "text", F.col("s.source").alias("sources"), F.col("s.n").alias("copies"))
    return alone.unionByName(together)


def _rows_of(counts: dict[tuple, Counter], docs: dict[tuple, Counter]):
    for (lang, source), n in counts.items():
        terms = [t.decode("utf-8", "surrogatepass") for t in n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(terms, pa.string()),
             pa.array(list(n.values()), pa.int64()), pa.array([docs[lang, source][t] for t in n], pa.int64())],
            ["lang", "source", "term", "n", "docs"])


def count_terms(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): weighted occurrences and documents."""

    def run(batches):
        counts: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}
        for b in slices(batches, "text", SLICE):
            for lang, text, sources, copies in zip(*(b.column(i).to_pylist() for i in range(4))):
                found = term_counts(text)
                for source, m in zip(sources, copies):
                    n = counts.setdefault((lang, source), Counter())
                    d = docs.setdefault((lang, source), Counter())
                    if m == 1:
                        n.update(found)
                        d.update(found.keys())
                    else:
                        n.update({t: c * m for t, c in found.items()})
                        d.update(dict.fromkeys(found, m))
            if sum(map(len, counts.values())) >= HELD:
                yield from _rows_of(counts, docs)
                counts.clear()
                docs.clear()
        yield from _rows_of(counts, docs)

    found = texts.select("lang", "text", "sources", "copies").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 v)); 1 where nothing is kept."""
    return F.expr(f"CASE WHEN v = 0 THEN 1L ELSE 1L + (CAST(1000000000 AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(19,0))) "
                  f"div CAST({total} + 2 * v AS DECIMAL(19,0)) END")


def difference(p, q):
    """floor((p - q)^2 / (p + q)) of integers or arrays of them."""
    return (p - q) * (p - q) // (p + q)


def _entries(column) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets of the rows of a list<struct> column and the fields, flat."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values
    return offsets, {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def _common(batches):
    """Sums over common terms for each pair of sources of two blocks."""
    for b in batches:
        langs = b.column(0).dictionary_encode()
        code = langs.indices.to_numpy().astype(np.int64)
        (oa, a), (ob, z) = _entries(b.column(1)), _entries(b.column(2))
        na, nz = np.diff(oa), np.diff(ob)
        upto = np.cumsum(na * nz)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            n = na[at:end] * nz[at:end]
            row = np.repeat(np.arange(at, end), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            i, j = oa[row] + k // nz[row], ob[row] + k % nz[row]
            ordered = a["source_no"][i] < z["source_no"][j]
            i, j, row = i[ordered], j[ordered], row[ordered]
            at = end
            if not len(i):
                continue
            p, p0, q, q0 = a["p"][i], a["p0"][i], z["p"][j], z["p0"][j]
            f = difference(p, q) - difference(p, q0) - difference(p0, q) + difference(p0, q0)
            order = np.lexsort((z["source_no"][j], a["source_no"][i], code[row]))
            keys = np.stack([code[row], a["source_no"][i], z["source_no"][j]], axis=1)[order]
            first = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(keys[first, 0])), pa.array(keys[first, 1]), pa.array(keys[first, 2]),
                 pa.array(np.add.reduceat(f[order], first))], ["lang", "a", "b", "value"])


def _against_absent(batches):
    """H(a, b), less V f(a0, b0) once a pair, for one group against a block."""
    for b in batches:
        (oc, c), (oz, z) = _entries(b.column(2)), _entries(b.column(3))
        for k, (lang, a) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            x, y = slice(oc[k], oc[k + 1]), slice(oz[k], oz[k + 1])
            others, q0 = z["source_no"][y], z["p0"][y]
            value = np.zeros(len(others), np.int64)
            for i in range(x.start, x.stop, 1024):
                j = slice(i, min(i + 1024, x.stop))
                weight = c["terms"][j, None] - c["kept"][j, None] * (a < others)
                value += (weight * difference(c["p"][j, None], q0[None])).sum(axis=0)
            value, others = value[others != a], others[others != a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(others), pa.string()), pa.array(np.minimum(a, others)), pa.array(np.maximum(a, others)), pa.array(value)],
                ["lang", "a", "b", "value"])


PAIR_ROWS = "lang string, a long, b long, value long"


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each pair a < b of source numbers of a language."""
    entry = F.struct("source_no", "p", "p0")
    blocks = shares.groupBy("lang", "term", "block", "blocks").agg(F.collect_list(entry).alias("x"))
    within = blocks.select("lang", "x", F.col("x").alias("y"))
    wide = stage(blocks.filter("blocks > 1"), "wide-terms")
    across = wide.alias("l").join(wide.alias("r"), ["lang", "term"]).filter("l.block < r.block").select("lang", F.col("l.x").alias("x"), F.col("r.x").alias("y"))
    common = within.unionByName(across).mapInArrow(_common, PAIR_ROWS)

    # how many kept terms of a group have each share; those it lacks have the share p0
    have = shares.groupBy("lang", "source_no", "p").agg(F.count(F.lit(1)).alias("terms")).withColumn("kept", F.lit(0).cast("long"))
    lack = groups.select("lang", "source_no", F.col("p0").alias("p"), (F.col("v") - F.col("present")).alias("terms"), F.col("v").alias("kept"))
    counts = have.unionByName(lack).groupBy("lang", "source_no", F.pmod("p", F.lit(SALTS)).alias("salt")).agg(
        F.collect_list(F.struct("p", "terms", "kept")).alias("counts"))
    absent = groups.groupBy("lang", "block").agg(F.collect_list(F.struct("source_no", "p0")).alias("others")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    one_sided = counts.join(absent, ["lang", "salt"]).select("lang", "source_no", "counts", "others").mapInArrow(_against_absent, PAIR_ROWS)
    return common.unionByName(one_sided).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs(lang, source, text)``."""
    found = stage(count_terms(collapse(docs)), "source-terms")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    kept = stage(kept, "kept-terms")
    group = F.concat_ws(":", F.length("lang").cast("string"), "lang", "source").alias("group")
    counts = stage(found.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", group), "kept-counts")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("present"))
    every = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0).withColumn(
        "source_no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = groups.withColumn("block", F.expr(f"source_no div {BLOCK}")).withColumn("p0", share("0L", "total"))
    groups = groups.withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
    groups = stage(groups.select("*", group), "source-groups")

    sizes = groups.select("group", "source_no", "block", "blocks", "p0", "v", "total", "lang_total")
    shares = lookup_join(counts, sizes, "group").select(
        "lang", "source", "term", "source_no", "block", "blocks", "p0", share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q"))
    shares = stage(shares, "shares")

    both = _pairs(shares, groups)
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", "source", F.col("source_no").alias("a"))
    pairs = both.join(names, ["lang", "a"]).join(names.select("lang", F.col("source").alias("item"), F.col("a").alias("b")), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                          F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).filter(F.col("rank") <= top))
