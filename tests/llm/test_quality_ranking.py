import random
import re
import zlib

import numpy as np
import pytest
from llm_rows import SF, none, odd  # noqa: F401
from pyspark.sql import functions as F

from pagesift.llm import catalog
from pagesift.llm import quality_ranking as Q


def auc(score, label):
    good, bad = [s for s, y in zip(score, label) if y], [s for s, y in zip(score, label) if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in catalog.op13_quality(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 1000
    rows = [(got[r.doc_id], r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    for g in got.values():
        assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0)
        assert g.predicted == int(g.score >= 0.3) and 0 <= g.score <= 1
    held = [(g.score, y, g.predicted) for g, y in rows if g.held_out]
    assert len(held) > 50
    assert auc([s for s, _, _ in held], [y for _, y, _ in held]) >= 0.97
    assert np.mean([p == y for _, y, p in held]) >= 0.93
    assert np.mean([p for _, y, p in held if y]) >= 0.95          # clean documents stay


def test_labels_lang_and_ids_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    once = {r.doc_id: r.score for r in Q.classify(docs, labels).collect()}
    again = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in Q.classify(docs, again).collect()} == pytest.approx(once)
    texts = {r.doc_id: r.text for r in docs.collect()}
    same = {}
    for i, s in once.items():
        assert same.setdefault(texts[i], s) == s


def test_pairs_meet_the_other_label_evenly():
    good, bad = np.array([0, 2, 4]), np.array([1, 3, 5, 6, 7, 8, 9])
    a, b = Q.preference_pairs(good, bad, 4)
    assert set(a) <= set(good) and set(b) <= set(bad) and len(a) == 28
    assert (np.bincount(b, minlength=10)[bad] == 4).all()
    assert np.ptp(np.bincount(a, minlength=5)[good]) <= 4
    c, d = Q.preference_pairs(bad, good, 4)
    assert set(c) <= set(bad) and set(d) <= set(good)


def test_weights_minimise_the_pairwise_loss():
    """Against plain gradient descent over every single pair."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.0] + rng.normal(size=60) > 0
    first, second = (g.ravel() for g in np.meshgrid(np.flatnonzero(y), np.flatnonzero(~y)))
    d, w = x[first] - x[second], np.zeros(3)
    for _ in range(4000):
        w += 0.5 * ((1 / (1 + np.exp(d @ w)))[:, None] * d).mean(axis=0) - 0.5 * 1e-2 * w
    got = Q.rank_weights(x, first, second, steps=1500, decay=1e-2)
    assert np.allclose(got, w, atol=0.03)


def test_quantile_and_cut_agree():
    rng = np.random.default_rng(0)
    x = np.zeros((1000, Q.WIDTH), np.float32)
    x[:, 0] = rng.normal(size=1000)
    y = (x[:, 0] + 0.1 * rng.normal(size=1000) > 0.8).astype(int)
    m = Q.fit(x, y)
    s = Q.scores(m, x)
    assert ((s >= Q.CUT) == ((x - m["centre"]) @ m["weights"] >= m["threshold"])).all()
    assert abs((s >= Q.CUT).mean() - y.mean()) < 0.05
    assert Q.share_quantile(np.array([3.0, 1.0, 2.0, 4.0]), np.ones(4), 0.5) == 2.5
    assert Q.fit(x, np.ones(1000)) is None


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (7, 0), (8, 0), (10, 1), (10, 0), (None, 1), (9, None), (99, 1)], "doc_id long, quality int")
    got = Q.classify(odd.select("doc_id", "text"), labels).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score == got[11].score and got[8].held_out is False
    assert got[4].score == got[5].score
    assert {r.score for r in Q.classify(odd, none.selectExpr("doc_id", "1 AS quality")).collect()} == {0.5}
    assert Q.classify(none, labels).collect() == []
    few, share = Q.sample(odd, labels, 3)
    assert {r.quality for r in few.collect()} == {0, 1} and 0 < share < 1


def test_sample_follows_the_documented_bound(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, f"text {rng.random()}") for i in range(300)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS INT) AS quality")
    few, share = Q.sample(docs, labels, 20)
    rows = few.collect()
    assert len(rows) == 40 and not any(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert share == pytest.approx(2 / 3, abs=0.06)


def test_all_labels_train_not_the_sample(spark):
    """One clean word of many tells the label: five documents of each label cannot show them all."""
    rng = random.Random(4)
    rows = [(i, " ".join([f"{'good' if i % 2 else 'bad'}{rng.randrange(40)}", *(f"w{rng.randrange(50)}" for _ in range(8))])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    before = Q.BLOCK
    Q.BLOCK = 300                                    # several blocks
    try:
        got = [r for r in Q.classify(docs, labels, 5).collect() if r.held_out]
    finally:
        Q.BLOCK = before
    assert len(got) > 200 and auc([r.score for r in got], [r.doc_id % 2 for r in got]) > 0.97


def test_blocks_hold_every_training_document_once(spark):
    rows = [(i, f"text {i} of many") for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:50] + [(7, "a smaller text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 1)) for i in range(390)] + [(3, 0), (999, 1)], "doc_id long, quality int")
    each = Q.labelled(labels)
    before = Q.BLOCK
    Q.BLOCK = 50
    try:
        table = Q.blocks_of(docs, each, each.count())
    finally:
        Q.BLOCK = before
    found = [(b, y, a, x) for b, ys, apart, xs in Q._unpacked(table.toArrow().to_batches()) for y, a, x in zip(ys, apart, xs) for b in [b]]
    train = [i for i in range(390) if zlib.crc32(str(i).encode()) % 5]
    texts = dict(rows) | {7: "a smaller text"}
    want = sorted((i % 10 == 1, x.tobytes()) for i, x in zip(train, Q.features([texts[i] for i in train]).astype(float)))
    assert sorted((bool(y), x.tobytes()) for _, y, _, x in found) == want and len({b for b, *_ in found}) > 4
    blocks = Q.Blocks(table)
    assert not blocks.every and blocks.counts.sum() == len(train)
    rng = np.random.default_rng(2)
    blocks.spare = {1: np.array([x for _, y, a, x in found if y == 1 and not a])[:4]}       # most blocks lack the label 1
    w, d = rng.normal(size=(2, Q.WIDTH)) * 0.01
    value, g = blocks.loss(w)
    assert (blocks.loss(w + 1e-4 * d)[0] - blocks.loss(w - 1e-4 * d)[0]) / 2e-4 == pytest.approx(g @ d, rel=1e-4)
    x = np.array([x for _, _, a, x in found if not a])
    assert np.allclose(blocks.centre, x.mean(axis=0)) and np.allclose(blocks.scale, x.std(axis=0) + 0.01)


def test_labelled_texts_are_shuffled_once(spark, monkeypatch):
    """However many labels there are: no broadcast of them may be needed."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(None, "no id")], "doc_id long, text string")
    each = docs.filter("doc_id % 3 > 0").selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    staged, stage = {}, Q.stage
    monkeypatch.setattr(Q, "stage", lambda df, label, *more: staged.setdefault(label, df) and stage(df, label, *more))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        table = Q.blocks_of(docs, each, 200)
        plan = staged["vectors"]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert sum("text#" in columns for columns in moved) == 1
    assert sum(len(r.y) for r in table.collect()) == 200


def test_descent_reaches_the_least_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.0] + rng.normal(size=60) > 0
    d = x[y][:, None] - x[~y][None]
    d = d.reshape(-1, 3)

    def loss(w):
        z = d @ w
        return np.logaddexp(0, -z).mean() + 0.005 * w @ w, -((1 / (1 + np.exp(z)))[:, None] * d).mean(axis=0) + 0.01 * w
    w = Q.descend(loss, np.zeros(3), gain=1e-9)
    assert np.abs(loss(w)[1]).max() < 1e-3


def test_quantile_by_bins_equals_the_sorted_one(spark):
    rng = np.random.default_rng(1)
    for k, s in enumerate([rng.normal(size=500), np.exp(20 * rng.normal(size=300)), np.arange(7.0)]):
        y = rng.integers(0, 2, len(s))
        y[:2] = 0, 1
        df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double").coalesce(2)
        for share in (0.02, 0.5, 0.99) if k < 2 else (0.3, 1.0):
            weight = {0: share / (y == 0).sum(), 1: (1 - share) / (y == 1).sum()}
            want = Q.share_quantile(s, np.where(y == 0, weight[0], weight[1]), share)
            assert Q.quantile(df, weight, share, few=3) == pytest.approx(want)
    same = spark.createDataFrame([(0, 1.0)] * 50 + [(1, 2.0)] * 50, "y int, s double")
    assert Q.quantile(same, {0: 0.01, 1: 0.01}, 0.3, few=3) == 1.0 and Q.quantile(same, {0: 0.01, 1: 0.01}, 0.5, few=3) == 1.5
