import hashlib
import random
from collections import defaultdict

from pagesift.llm import exact_dedup as X
from llm_rows import none, odd, odd_rows  # noqa: F401


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return out, groups


def test_odd_rows(odd):
    rows = [r[:2] for r in odd_rows()]
    got = X.duplicate_groups(odd).collect()
    want, groups = expected(rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_hot_group_and_many_rows(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"t{rng.randrange(4000)}") for i in range(6000)]
    got = X.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, _ = expected(rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(want)


def test_filter_has_no_false_negatives(spark):
    rows = [(f"k{i}",) for i in range(3000)] + [(f"k{i}",) for i in range(0, 3000, 7)]
    df = spark.createDataFrame(rows, "k string")
    bloom, n = X.repeated_filter(df, "k", len(rows))
    marked = X.mark_candidates(df, "k", bloom, n).collect()
    maybe = {r.k for r in marked if r["__maybe"]}
    assert {f"k{i}" for i in range(0, 3000, 7)} <= maybe
    assert len(maybe) < 900           # most unique keys pass straight through


def test_drop_keeps_columns_and_one_row_per_text(odd):
    got = X.drop_exact_duplicates(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert sorted(r.text or "" for r in rows) == sorted({t or "" for _, t, *_ in odd_rows()})
    same = next(r for r in rows if (r.text or "").startswith("token0 token1 ") and "other7" not in r.text)
    assert same.doc_id == 5


def test_empty(none):
    assert X.duplicate_groups(none).collect() == []
    assert X.drop_exact_duplicates(none).collect() == []
