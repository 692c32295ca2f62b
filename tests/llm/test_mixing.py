import math
from collections import defaultdict

from pyspark.sql import functions as F

from pagesift.llm import mixing as X
from llm_rows import none, odd, odd_rows  # noqa: F401


def corpus(spark):
    rows = []
    for s, n in enumerate([900, 300, 120, 60, 15]):
        rows += [(s * 10_000 + i, "w " * (5 + i % 20), f"s{s}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def by_source(m):
    rows = m.select("d.source", "n_tokens", "copies", "weight", "epochs", "exponent", "source_tokens").collect()
    got = defaultdict(float)
    for r in rows:
        got[r.source] += r.n_tokens * r.copies
    return rows, got


def test_entropy_target_and_budget(spark):
    docs, rows = corpus(spark)
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s] += len(t.split())
    total = sum(tokens.values())
    target = 1.3
    got, realised = by_source(X.mixture(docs, target_entropy=target, max_epochs=None, budget=2 * total))
    # bisection by hand
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        q = [(n / total) ** a for n in tokens.values()]
        h = -sum(x / sum(q) * math.log(x / sum(q)) for x in q)
        low, high = (a, high) if h > target else (low, a)
    assert abs(got[0].exponent - high) < 1e-6
    z = sum((n / total) ** high for n in tokens.values())
    for s, n in tokens.items():
        want = 2 * total * (n / total) ** high / z
        assert want - 25 <= realised[s] <= want + 1e-6           # at most one document short of the budget
    for r in got:
        assert r.copies in (math.floor(r.epochs), math.floor(r.epochs) + 1)


def test_repetition_limit(spark):
    docs, _ = corpus(spark)
    got, _ = by_source(X.mixture(docs, entropy_gain=None, max_epochs=3.0))
    assert abs(max(r.epochs for r in got) - 3.0) < 1e-4
    got, _ = by_source(X.mixture(docs, entropy_gain=None, max_epochs=2.0, keep_all=True))
    assert min(r.copies for r in got) == 1 and max(r.copies for r in got) == 2
    assert abs(max(r.epochs for r in got) - 2.0) < 1e-4


def test_partial_epoch_takes_whole_blocks_in_order(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_TOKENS", 200)
    docs, _ = corpus(spark)
    rows = X.mixture(docs, entropy_gain=1.0, max_epochs=None).filter("d.source = 's0'").collect()
    blocks = defaultdict(set)
    for r in rows:
        blocks[r.block].add(r.copies)
    assert len(blocks) > 20 and sum(len(x) > 1 for x in blocks.values()) <= 1      # one block is cut


def test_rows_and_columns(odd, none):
    mixed = X.mix_documents(odd, keep_all=True)
    assert mixed.columns == odd.columns and mixed.count() >= len(odd_rows())
    got = X.mixture(odd, entropy_gain=None).select("d.*", "copies")
    assert got.count() == len(odd_rows())
    assert X.mixture(none).collect() == [] and X.mix_documents(none).collect() == []
    one = odd.withColumn("source", F.lit("only"))
    assert {r.copies for r in X.mixture(one).collect()} == {1}
