import math
import random
from collections import defaultdict

import numpy as np

from pagesift.llm import minhash as M
from pagesift.llm import shingles as S
from pagesift.llm.components import components
from llm_rows import none, odd, odd_rows  # noqa: F401


def brute_classes(rows):
    """class of every row by comparing all pairs of texts."""
    sets = S.shingle_sets([t or "" for _, t in rows])
    df = np.zeros(M.CELLS, np.int64)
    for h, _ in sets:
        df += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=M.CELLS)
    n = len(rows)
    idf = 1 + np.log(n / np.clip(df, 1, n)) / (4 * math.log(max(n, 3)))
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(n):
        for b in range(a):
            if M.similarity(sets[a], sets[b], idf) >= M.THRESHOLD:
                root[top(a)] = top(b)
    groups = defaultdict(list)
    for i in range(n):
        groups[top(i)].append(rows[i][0])
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids)) for i in ids]
    return sorted(out, key=str)


def near_copies(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 12])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(" ".join(t))
    shared = " ".join(rng.choice(vocab) for _ in range(40))
    rows += [shared + " " + " ".join(rng.choice(vocab) for _ in range(60)) for _ in range(15)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_against_all_pairs(spark):
    rows = near_copies()
    got = M.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == brute_classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_sampling_agrees_as_often_as_texts_are_alike():
    rng = random.Random(0)
    idf = 1 + np.random.default_rng(1).random(M.CELLS) / 4
    words = [f"w{rng.randrange(10_000)}" for _ in range(300)]
    agree, alike = [], []
    for _ in range(60):
        t = list(words)
        for _ in range(8):
            t[rng.randrange(300)] = f"z{rng.random()}"
        pair = S.shingle_sets([" ".join(words), " ".join(t)])
        x = M.sketch(pair, idf)
        agree.append((x[0] == x[1]).mean())
        alike.append(M.similarity(*pair, idf))
    assert abs(np.mean(agree) - np.mean(alike)) < 0.03


def test_shingles():
    a, b, c, d, e = S.shingle_sets(["a b c d e f", "A  b\tc d\ne f", "a b", "", "x a b c d e f"])
    assert len(a[0]) == 2 and a[0].tolist() == b[0].tolist() and len(c[0]) == 1 and len(d[0]) == 0
    assert set(a[0].tolist()) < set(e[0].tolist())
    words = [f"v{i}" for i in range(5000)]
    assert len(S.shingle_sets([" ".join(words)])[0][0]) == 4996


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}}


def test_odd_rows(odd, none):
    rows = [r[:2] for r in odd_rows()]
    got = M.near_classes(odd).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == brute_classes(rows)
    assert sum(r.kept for r in got) == len({(r.class_id, r.class_size) for r in got})
    kept = M.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [10, 3, 5, 6, 7, 9, None]      # equal texts first: the largest id
    assert M.near_classes(none).collect() == []
    assert M.drop_near_duplicates(none).collect() == []
