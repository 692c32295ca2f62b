"""Run summaries (A1-A6), language and category rules.

A run is a group of processed items with an order (``ordinal``) and an
outcome (``ok``).  Summaries are hash aggregates with partial aggregation;
running counts use the skew-safe prefix sums of ``ranking.py``, so one huge
run is not pulled into one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PY_WS
from .ranking import DEFAULT_WIDTH


def run_summary(items: DataFrame, run: str = "run_id", ok: str = "ok",
                execution_time: float = 0.0) -> DataFrame:
    """A1 + A2 + A5: per run total, successes, failures, success rate
    (``s / max(n, 1) * 100``, one decimal) and status."""
    agg = items.groupBy(run).agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(F.col(ok)).alias("successful_extractions"),
        F.count_if(~F.col(ok)).alias("failed_extractions"))
    return agg.select(
        run, "total_processed", "successful_extractions", "failed_extractions",
        F.lit(float(execution_time)).alias("execution_time"),
        success_rate(F.col("successful_extractions"), F.col("total_processed")).alias("success_rate"),
        run_status(F.col("successful_extractions"), F.col("failed_extractions")).alias("status"))


def success_rate(ok: Column, total: Column) -> Column:
    """A2: one decimal, halves to the even digit."""
    return one_decimal(ok * 100.0 / F.greatest(total, F.lit(1)))


def one_decimal(x: Column) -> Column:
    """Rounds the exact value of a double to one decimal, halves to even, as
    ``%.1f`` prints it.  Ten times x is 8x + 2x, both exact; what their sum
    loses says on which side of a half the exact product lies."""
    a, b = x * 8.0, x * 2.0
    t = a + b
    lost = (a - (t - (t - a))) + (b - (t - a))
    low = F.floor(t).cast("double")
    half = (t - low) == 0.5
    return F.when(half & (lost > 0), low + 1).when(half & (lost < 0), low).otherwise(F.rint(t)) / 10.0


def run_status(ok: Column, failed: Column) -> Column:
    """A5: the exit code of the command line as a label."""
    return F.when((ok == 0) & (failed >= 1), "failed").when(failed > 0, "partial").otherwise("ok")


def progress_points(items: DataFrame, run: str = "run_id", order: str = "ordinal",
                    ok: str = "ok", every: int = 10, width: int = DEFAULT_WIDTH) -> DataFrame:
    """A3: at every ``every``-th item and the last one of a run, the running
    success and failure counts and the percent done.

    ``order`` is a unique integer order within the run.  Running counts are a
    two-level prefix sum: bucket totals (a window over n/width rows per run)
    plus running sums inside a bucket (a window over at most ``width`` rows)."""
    x = items.select(run, order, F.col(ok).cast("int").alias("_ok"),
                     F.floor(F.col(order) / F.lit(width)).alias("_b")).repartition(run, "_b")
    buckets = x.groupBy(run, "_b").agg(F.count(F.lit(1)).alias("_bn"), F.sum("_ok").alias("_bok"))
    wb = Window.partitionBy(run).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(run)
    buckets = buckets.select(
        run, "_b",
        F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_noff"),
        F.coalesce(F.sum("_bok").over(wb), F.lit(0)).alias("_okoff"),
        F.sum("_bn").over(wt).alias("total"))
    wi = Window.partitionBy(run, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.select(run, order, "_b", F.count(F.lit(1)).over(wi).alias("_i"), F.sum("_ok").over(wi).alias("_k"))
    pos = x.join(buckets, [run, "_b"]).select(
        run, order, (F.col("_noff") + F.col("_i")).alias("item"), "total",
        (F.col("_okoff") + F.col("_k")).alias("ok_so_far"))
    return pos.filter((F.col("item") % every == 0) | (F.col("item") == F.col("total"))).select(
        run, F.col("item").cast("bigint").alias("item"), F.col("total").cast("bigint").alias("total"),
        one_decimal(F.col("item") * 100.0 / F.col("total")).alias("percent"),
        F.col("ok_so_far").cast("bigint").alias("successful"),
        (F.col("item") - F.col("ok_so_far")).cast("bigint").alias("failed"))


def first_failures(failures: DataFrame, run: str = "run_id", order: str = "ordinal",
                   k: int = 5) -> DataFrame:
    """A4: the first ``k`` failures of each run and how many more there are.
    ``row_number() <= k`` is planned as a WindowGroupLimit, so each task keeps
    at most k rows per run before the shuffle."""
    w = Window.partitionBy(run).orderBy(order)
    top = failures.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    counts = failures.groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    return top.join(counts, run).withColumn("more", F.greatest(F.col("_n") - k, F.lit(0))) \
        .withColumn("rank", F.col("rank").cast("bigint")).drop("_n")


# -- language and target (S3, S4, A6) ----------------------------------------------
# The configured listing page per language and the default.
BASE_URLS = {"en": "https://www.amazonaws.cn/en/new/", "zh": "https://www.amazonaws.cn/new/"}
DEFAULT_TARGET = "https://www.amazonaws.cn/en/new/"


def normalize_language(lang: Column) -> Column:
    """Exactly 'zh' or 'chinese' -> 'zh'; anything else -> 'en'."""
    return F.when(lang.isin("zh", "chinese"), "zh").otherwise("en")


def language_label(lang: Column) -> Column:
    """A6: 'English' iff 'en', else 'Chinese'."""
    return F.when(lang == "en", "English").otherwise("Chinese")


def target_url(lang: Column, base_urls: dict | None = None) -> Column:
    """S3: the configured URL of the language; missing or empty -> default."""
    urls = base_urls or BASE_URLS
    m = F.create_map(*[x for k, v in urls.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.nullif(F.try_element_at(m, lang), F.lit("")), F.lit(DEFAULT_TARGET))


# -- X1, X2 ---------------------------------------------------------------------
CJK = "[\\x{4E00}-\\x{9FFF}]"


def cjk_ratio(text: Column) -> Column:
    """Share of CJK ideographs among the non-blank characters."""
    # whole runs are replaced, as each replacement copies; plain ASCII holds none
    nonblank = F.length(F.regexp_replace(text, PY_WS + "++", ""))
    cjk = F.length(F.regexp_replace(text, "[^\\x{4E00}-\\x{9FFF}]++", ""))
    return (F.when(F.octet_length(text) == F.length(text), F.lit(0.0))
            .when(cjk == 0, F.lit(0.0)).when(nonblank > 0, cjk / nonblank).otherwise(F.lit(0.0)))


def detect_language(text: Column, threshold: float = 0.10) -> Column:
    """X1: 'zh' when at least ``threshold`` of the non-blank characters are
    CJK ideographs, else 'en'."""
    return F.when(cjk_ratio(text) >= threshold, "zh").otherwise("en")


# Fixed values (our rule table, the README advertises the feature without
# code): (category, keyword, priority); lower priority wins.
CATEGORY_RULES = [
    ("Compute", "compute", 1), ("Compute", "server", 2), ("Storage", "storage", 3),
    ("Storage", "bucket", 4), ("Database", "database", 5), ("Database", "table", 6),
    ("Networking", "network", 7), ("Security", "security", 8), ("Security", "password", 9),
    ("Analytics", "analytics", 10), ("Analytics", "data", 11), ("Machine Learning", "model", 12),
]


def categorize(title: Column, rules=None) -> Column:
    """The category of the first keyword (by priority) found in the
    lowercased title, else 'Other'.  The rule table is small and fixed, so it
    is compiled into one CASE expression rather than joined."""
    rules = sorted(rules or CATEGORY_RULES, key=lambda r: r[2])
    t = F.lower(title)
    expr = F.lit("Other")
    for cat, kw, _ in reversed(rules):
        expr = F.when(t.contains(kw), F.lit(cat)).otherwise(expr)
    return expr


# -- X2 with a table of rules ----------------------------------------------------------
RULE_BYTES = 32 << 20      # of keywords in one automaton, which every Python worker holds


def categorize_by(df: DataFrame, rules: DataFrame, text: str = "text", name: str = "category", most: int = RULE_BYTES) -> DataFrame:
    """``df`` with the category of the first rule whose keyword is in the
    lowercased text, else 'Other'.

    ``rules(category, keyword, priority)`` is a table; the lowest priority wins,
    then the smaller keyword and category.  Its keywords become one automaton
    that reads a text once whatever their number.  A table of more than ``most``
    bytes is split by a hash of the keyword into automata of that size, which
    read one after the other; the driver never holds more than one.  Null
    texts, and rules with a null, match nothing; an empty keyword matches every
    text.  Texts stay where they are: nothing shuffles."""
    known = rules.select("category", "keyword", F.col("priority").cast("long").alias("priority")).dropna()
    size = known.agg(F.coalesce(F.sum(F.octet_length("keyword") + F.octet_length("category")), F.lit(0))).first()[0]
    parts = max(1, -(-size // most))
    best = "struct<priority:bigint,keyword:string,category:string>"
    out = df.withColumn("__best", F.lit(None).cast(best)).withColumn("__low", F.lower(F.col(text)))
    for k in range(parts):
        rows = known.filter(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == k).collect()
        first: dict[str, tuple] = {}
        for r in rows:
            first[r.keyword] = min(first.get(r.keyword, (r.priority, r.keyword, r.category)), (r.priority, r.keyword, r.category))
        out = _first_rule(out, df.sparkSession.sparkContext.broadcast(list(first.values())))
    return out.withColumn(name, F.coalesce(F.col("__best.category"), F.lit("Other"))).drop("__best", "__low")


def _first_rule(df: DataFrame, shared) -> DataFrame:
    """``__best`` lowered to the least rule of one automaton found in ``__low``."""

    def run(batches):
        find = _finder(shared.value)
        for b in batches:
            at = b.schema.get_field_index("__best")
            kind = b.schema.field(at).type
            found = []
            for text, held in zip(b.column("__low").to_pylist(), b.column(at).to_pylist()):
                rule = find(text) if text is not None else None
                if held is not None and (rule is None or tuple(held.values()) < rule):
                    rule = tuple(held.values())
                found.append(rule and dict(zip(("priority", "keyword", "category"), rule)))
            yield b.set_column(at, b.schema.field(at), pa.array(found, kind))
    return df.mapInArrow(run, df.schema)


def _finder(rules: list[tuple]):
    """A function text -> least rule whose keyword it holds."""
    everywhere = min((r for r in rules if not r[1]), default=None)
    rules = [r for r in rules if r[1]]
    if not rules:
        return lambda text: everywhere
    try:
        import ahocorasick
    except ImportError:
        ordered = sorted(rules + ([everywhere] if everywhere else []))
        return lambda text: next((r for r in ordered if r[1] in text), None)
    machine = ahocorasick.Automaton()
    for r in rules:
        machine.add_word(r[1], r)
    machine.make_automaton()

    def find(text):
        hits = [r for _, r in machine.iter(text)]
        return min(hits + [everywhere] if everywhere else hits, default=None)
    return find
