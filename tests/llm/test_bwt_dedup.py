import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pagesift.llm import bwt_dedup as B
from llm_rows import none, odd, odd_rows  # noqa: F401


def expected(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + B.LENGTH] for _, b in raw for k in range(len(b) - B.LENGTH + 1))
    out = []
    for i, b in raw:
        mark = np.zeros(len(b) + 1, int)
        for k in range(len(b) - B.LENGTH + 1):
            if seen[b[k:k + B.LENGTH]] > 1:
                mark[k] += 1
                mark[k + B.LENGTH] -= 1
        gone = np.cumsum(mark[:-1]) > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def rows(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (30, 40, 60, 90)]
    out = []
    for i in range(90):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 60)))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 40)
            parts += [p[cut:], " ".join(word() for _ in range(rng.randrange(0, 30)))]
        out.append((i, " ".join(parts)))
    out += [(100 + i, out[5 * i][1]) for i in range(6)] + [(200, "a" * 700), (201, "ab" * 300), (202, "x" * 199), (203, None)]
    out += [(300 + i, passages[3][: 150 + i]) for i in range(0, 120, 7)]
    return out


def collected(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [40_000, 4])
def test_against_all_strings(spark, monkeypatch, limit):
    monkeypatch.setattr(B, "ROWS", limit)     # 4: most anchors take the way of large ones
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    assert collected(B.remove_repeats(df)) == expected(rows())


def test_odd_rows(odd, none, spark):
    assert collected(B.remove_repeats(odd)) == expected([r[:2] for r in odd_rows()])
    assert B.remove_repeats(none).collect() == []
    text = "q" * 10 + "".join(random.Random(1).choice("abcdef") for _ in range(260))
    df = spark.createDataFrame([(1, text), (2, text[10:] + "!")], "doc_id long, text string")
    got = {r.doc_id: r for r in B.remove_repeats(df, keep_bytes=True).collect()}
    assert bytes(got[1].kept) == b"q" * 10 and got[1].removed == [[10, 270]] and bytes(got[2].kept) == b"!"


def test_merge_orders_rows_and_finds_common_prefixes():
    rng = np.random.default_rng(4)
    table = rng.integers(97, 99, (60, B.WIDTH)).astype(np.uint8)
    table[20:40, 100:] = table[0, 100:]
    table[50:, :250] = table[3, :250]
    for c, order, common in B.merge(np.ascontiguousarray(table.T)):
        tails = [bytes(table[i, c:]) for i in order]
        assert tails == sorted(tails)
        if c % 40 == 0:
            for i in range(1, len(order)):
                a, b = tails[i - 1], tails[i]
                n = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
                assert common[i] == n


def test_long_texts_are_searched_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 5000).astype(np.uint8).tobytes().decode()
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"key": [b"k"], "text": [data]})
    whole = next(iter(B.texts_and_runs([batch])))[3]
    monkeypatch.setattr(B, "CHUNK", 700)
    parts = next(iter(B.texts_and_runs([batch])))[3]

    def windows(runs):
        return {w: a for a, _, f, z in zip(*runs) for w in range(f, z + 1)}
    assert windows(whole) == windows(parts) and len(windows(whole)) == 4801
