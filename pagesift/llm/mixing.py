"""Mixing sources to target weights: temperature mixing.

Source token shares p are raised to an exponent a in [0, 1] and normalised.
The exponent is found by bisection (the interval shrinks 32-fold per pass over
the small table of sources, i.e. five halvings at once): either the entropy of
the weights meets a target, or no source is repeated more often than a limit,
or both (then the larger exponent, the one nearer the natural shares, holds).
The weights are realised under a token budget: every source gets
budget x weight tokens, as whole epochs plus one partial epoch.  A source is
dealt into blocks by a hash of doc_id; each epoch visits the blocks in an order
of its own, and the partial epoch takes blocks in that order until the budget
is met; only the block at the cut is split by documents.

No source is ever gathered: sums are made per (source, block), a window runs
over at most ``MAX_BLOCKS`` block rows of a source and over the documents of
one cut block.

Defined results: a null source is a source of its own; a null or blank text
has no tokens, its document follows its block; a source without tokens has
weight 0 and its documents get no copy, or one under ``keep_all``; equal doc_ids share a block and a rank;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, stage

MAX_BLOCKS = 4096
BLOCK_TOKENS = 65536
SECTIONS = 32
PASSES = 5


def token_count(text: Column) -> Column:
    """Tokens of a text: maximal runs of other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def _curves(sources: DataFrame, exponents: list[float], total: float, budget: float) -> list[tuple[float, float]]:
    """(entropy, largest number of epochs) of the weights at each exponent, in
    one pass over the sources."""
    p = F.col("tokens") / F.lit(total)
    sums = []
    for i, a in enumerate(exponents):
        q = F.pow(p, F.lit(a))
        sums += [F.sum(q).alias(f"z{i}"), F.sum(q * F.log(p) * a).alias(f"s{i}"), F.max(q / F.col("tokens")).alias(f"m{i}")]
    row = sources.filter("tokens > 0").agg(*sums).first()
    return [(math.log(row[f"z{i}"]) - row[f"s{i}"] / row[f"z{i}"], budget * row[f"m{i}"] / row[f"z{i}"])
            for i in range(len(exponents))]


def _bisect(fits, low: float = 0.0, high: float = 1.0) -> float:
    """Smallest exponent in [low, high] from which on ``fits`` holds.  ``fits``
    takes a list of exponents and is monotone from False to True."""
    if fits([low])[0]:
        return low
    for _ in range(PASSES):
        grid = [low + (high - low) * (i + 1) / SECTIONS for i in range(SECTIONS)]
        ok = fits(grid)
        k = next((i for i, x in enumerate(ok) if x), SECTIONS - 1)
        low, high = (grid[k - 1] if k else low), grid[k]
    return high


def mixture(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id",
            budget: int | None = None, target_entropy: float | None = None,
            entropy_gain: float | None = 0.5, max_epochs: float | None = 4.0,
            keep_all: bool = False, seed: int = 17) -> DataFrame:
    """``docs`` as struct ``d`` plus source_tokens, n_tokens, exponent, weight,
    epochs, block, copies: how often the document stands in the mixture.

    budget: tokens of the mixture (default: those of the corpus).
    target_entropy: entropy of the weights in nats; entropy_gain: the same as
    a share of the way from the natural entropy to the uniform one.
    max_epochs: repetition limit.  keep_all: the budget is raised until the
    largest source has one whole epoch, so nothing is left out; the
    repetition limit then counts against that budget.
    """
    key = F.to_json(F.struct(F.col(source).alias("s")))
    rows = docs.select(F.struct("*").alias("d"), key.alias("__src"), F.col(doc_id).alias("__id"),
                       token_count(F.col(text)).alias("n_tokens"))
    sources = stage(rows.groupBy("__src").agg(F.sum("n_tokens").alias("tokens")), "sources")
    known = sources.filter("tokens > 0").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"),
                                             F.max("tokens").alias("m"), F.min("tokens").alias("least")).first()
    total, n_sources = float(known.t or 0), known.n
    wanted = float(budget if budget is not None else total)
    a = 1.0
    if n_sources > 1:
        if target_entropy is None and entropy_gain is not None:
            natural = _curves(sources, [1.0], total, wanted)[0][0]
            target_entropy = natural + entropy_gain * (math.log(n_sources) - natural)
        low = 0.0
        if target_entropy is not None:
            low = _bisect(lambda g: [h <= target_entropy for h, _ in _curves(sources, g, total, wanted)])
        if max_epochs is not None and keep_all:    # the largest source has one epoch
            low = max(low, _bisect(lambda g: [(known.m / known.least) ** (1.0 - x) <= max_epochs for x in g]))
        elif max_epochs is not None:
            low = max(low, _bisect(lambda g: [e <= max_epochs for _, e in _curves(sources, g, total, wanted)]))
        a = low
    if n_sources:
        z = sources.filter("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / total, F.lit(a)))).first()[0]
        if keep_all:
            wanted = max(wanted, total * z * (known.m / total) ** (1.0 - a))
    else:
        z = 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(max(total, 1.0)), F.lit(a)) / F.lit(z)).otherwise(0.0)
    plan = (sources.withColumn("weight", weight)
            .withColumn("epochs", F.when(F.col("tokens") > 0, F.round(F.col("weight") * wanted / F.col("tokens"), 9))
                        .otherwise(F.lit(1.0 if keep_all else 0.0)))
            .withColumn("blocks", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / BLOCK_TOKENS)))))
    plan = stage(plan.withColumn("exponent", F.lit(a)), "plan")
    return _realise(rows, plan, seed)


def _realise(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Copies per document by block permutations; see the module docstring."""
    per_row = _with_plan(rows, plan)
    placed = (per_row
              .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "__id"), F.col("blocks")).cast("int"))
              .withColumn("__whole", F.floor("epochs").cast("int")))
    # block permutation of the partial epoch
    sums = placed.groupBy("__src", "block").agg(F.sum("n_tokens").alias("__bt"), F.first("epochs").alias("__e"),
                                                 F.first("tokens").alias("__t"), F.first("__whole").alias("__w"))
    order = Window.partitionBy("__src").orderBy(F.xxhash64(F.lit(seed + 1), "__src", "block", "__w"), "block")
    cum = stage(sums.withColumn("__left", (F.col("__e") - F.col("__w")) * F.col("__t"))
                .withColumn("__end", F.sum("__bt").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                .select("__src", "block", (F.col("__left") - (F.col("__end") - F.col("__bt"))).alias("__room"), "__bt"),
                "blocks")
    whole = cum.filter(F.col("__room") >= F.col("__bt")).select("__src", "block", F.lit(1).alias("__in"))
    cut = cum.filter((F.col("__room") > 0) & (F.col("__room") < F.col("__bt"))).select("__src", "block", "__room")
    flagged = placed.join(whole.unionByName(cut.withColumn("__in", F.lit(2)), allowMissingColumns=True),
                          ["__src", "block"], "left")
    inside = Window.partitionBy("__src", "block").orderBy(
        F.xxhash64(F.lit(seed + 2), "__id"), "__id").rowsBetween(Window.unboundedPreceding, 0)
    edge = (flagged.filter("__in = 2").withColumn("__run", F.sum("n_tokens").over(inside))
            .withColumn("__more", (F.col("__run") <= F.col("__room")).cast("int")).drop("__run"))
    rest = flagged.filter("__in is null or __in = 1").withColumn("__more", F.coalesce("__in", F.lit(0)))
    return (rest.unionByName(edge)
            .select("d", F.col("tokens").alias("source_tokens"), "n_tokens", "exponent", "weight", "epochs", "block",
                    (F.col("__whole") + F.col("__more")).alias("copies")))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row with the plan of its source; a source with very many rows
    does not meet in one task (see ``lookup_join``)."""
    hot = stage(hot_keys(rows.select("__src"), "__src").select("__src"), "hot")
    few = plan.join(F.broadcast(hot), "__src", "left_semi")
    a = rows.join(F.broadcast(few), "__src")
    b = rows.join(F.broadcast(hot), "__src", "left_anti").join(plan, "__src")
    return a.unionByName(b)


def mix_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mixture itself: every row of ``docs`` as many times as its copies."""
    m = mixture(docs, **kw).filter("copies > 0")
    return m.select("d", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select("d.*")
