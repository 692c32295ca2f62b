import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import language_id as G
from llm_rows import SF, none, odd  # noqa: F401


def test_marginals_against_enumeration(monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 3)
    rng = np.random.default_rng(0)
    lengths = np.array([1, 7, 4, 9])
    scores, trans = rng.normal(size=(21, 3)), rng.normal(size=(3, 3))
    got = G.marginals(scores, lengths, trans)
    at = 0
    for n in lengths:
        z = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(scores[at + i, y[i]] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            for i in range(n):
                z[i, y[i]] += w
        assert np.allclose(z / z.sum(axis=1, keepdims=True), got[at:at + n])
        at += n


def test_features_do_not_depend_on_neighbours():
    n, o = G.features(["the", "a", "straße"])
    m, p = G.features(["straße"])
    assert n[o[2]:o[3]].tolist() == m.tolist()


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, {r.doc_id: r for r in G.predict(docs).collect()}


def test_held_out_accuracy(fitted):
    docs, got = fitted
    rows = docs.filter("lang is not null").collect()
    held = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert len(held) > 20 and np.mean(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_inputs_are_the_text_alone(fitted):
    docs, got = fitted
    blind = docs.select((F.col("doc_id") + 0).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"))
    again = {r.doc_id: r for r in G.predict(blind, train=docs).collect()}
    assert all(again[i].lang_pred == r.lang_pred and abs(again[i].score - r.score) < 1e-9 for i, r in got.items())


def test_code_switching():
    texts = ["the house and the river of the town is open", "das haus und der fluss der stadt ist offen"] * 30
    m = G.fit(texts, ["en", "de"] * 30)
    words, p = G.Tagger(m).word_marginals(["the house and the town das haus und der fluss"])
    labels = [m["labels"][i] for i in p.argmax(axis=1)]
    assert labels[:4] == ["en"] * 4 and labels[-4:] == ["de"] * 4


def test_odd_rows(odd, none, fitted):
    docs, _ = fitted
    got = G.predict(odd, train=docs).collect()
    assert len(got) == 14
    by = [(r.lang_pred, r.score) for r in got]
    assert by[0] == by[1] == by[11] == by[12] == ("und", 0.0)
    assert got[8].held_out is False          # null doc_id
    assert all(r.lang_pred == "und" for r in G.predict(odd, train=none).collect())
    assert G.predict(none, train=docs).collect() == []
    kept = G.keep_known(odd, docs)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {4, 5}
    assert not {r.doc_id for r in kept.collect()} & {1, 2, 3, 8, 9}


def test_letters_are_letters_by_category(fitted, spark):
    assert G.Tagger(G.fit(["the house"], ["en"])).predict(["½ ² ① Ⅷ 12 _", ""]) == (["und", "und"], [0.0, 0.0])
    docs, _ = fitted
    odd = spark.createDataFrame([(1, "½ ² ① Ⅷ"), (2, "the m² of the house")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    by = {r.doc_id: r for r in G.predict(odd, train=docs).collect()}
    assert (by[1].lang_pred, by[1].score) == ("und", 0.0) and by[2].lang_pred != "und"


def test_sample_is_bounded_and_null_ids_train(spark):
    rows = [(None, f"no id {i}", "en") for i in range(9)] + [(1, f"again {i}", "de") for i in range(40)] + [(1, "same", "fr")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = G.sample(docs, 5).collect()
    assert sorted(r.lang for r in got) == ["de"] * 5 + ["en"] * 5 + ["fr"] * 5
    assert sorted(r.text for r in got if r.lang == "en") == [f"no id {i}" for i in range(5)]
    assert sorted(map(str, G.sample(docs.coalesce(1), 5).collect())) == sorted(map(str, got))
