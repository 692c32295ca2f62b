import public_tokenizers
import sentencepiece

import corpus_pipeline
from pagesift.llm import catalog
from llm_rows import SF, none, odd  # noqa: F401


def test_stages_and_result(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    sizes = []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF)
        out.write.parquet(str(tmp_path / f"s{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"s{k}"))
        sizes.append((name, before.count(), docs.count()))
        if k < 4:
            assert docs.columns == columns
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    (_, a0, a1), (_, b0, b1), (_, c0, c1), (_, d0, d1), (_, e0, e1) = sizes
    assert a1 >= 0.97 * a0                                    # clean documents stay
    texts = spark.read.parquet(str(tmp_path / "s0")).select("text").distinct().count()
    assert b1 == texts and c1 <= b1 and d1 >= c1 and e1 == d1
    mixed = spark.read.parquet(str(tmp_path / "s3"))
    assert mixed.select("doc_id").distinct().count() == c1     # mixing leaves nobody out
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text_of = {r.doc_id: r.text for r in mixed.collect()}
    for r in docs.limit(50).collect():
        assert list(r.token_ids) == library.encode(text_of[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.decoded == library.decode(list(r.token_ids))


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
