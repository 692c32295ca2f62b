import numpy as np

from pagesift.llm import ann_tree as A

SCHEMA = "vec_id long, embedding array<float>, label int, score double, leaf string"


def brute(rows, queries, k=5):
    """(query_id, [(vec_id, score)...]) over rows that take part."""
    out = {}
    for q, (qi, qv) in enumerate(rows):
        if qi not in queries:
            continue
        q64 = np.asarray(qv, np.float32).astype(float)
        cand = []
        for j, (vi, v) in enumerate(rows):
            if j != q:
                v64 = np.asarray(v, np.float32).astype(float)
                cand.append((-(q64 @ v64) / (np.linalg.norm(q64) * np.linalg.norm(v64)), vi))
        out.setdefault(qi, []).append([(v, -s) for s, v in sorted(cand)[:k]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 0.5, "x")
                                  for i, v in rows], SCHEMA)


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    rows = [(i, centres[i % 30] + 0.3 * rng.normal(size=16)) for i in range(1500)]
    rows += [(5000 + i, rows[50][1]) for i in range(700)]           # one vector a third of all rows have
    df = frame(spark, rows)
    got = A.search(df, df.filter("vec_id % 50 = 0")).collect()
    queries = {i for i, _ in rows if i % 50 == 0}
    want = brute(rows, queries)
    hits = total = 0
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == queries
    scores = {}
    for q in queries:
        ids = [v for v, _ in by[q]]
        assert len(ids) == 5
        top = want[q][0]
        floor = top[-1][1]
        hits += sum(s >= floor - 1e-12 for _, s in by[q])
        total += 5
        assert by[q] == sorted(by[q], key=lambda x: (-round(x[1], 12), x[0]))
    assert hits / total >= 0.9
    copy = next(q for q in sorted(queries) if q >= 5000)
    same = sorted([50] + [i for i, _ in rows if i >= 5000 and i != copy])
    assert [v for v, _ in by[copy]] == same[:5]


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(0, [1, 0, 0]), (50, [0.5, 0.5, 0]), (100, None), (150, []), (200, [0, 0, 0]), (250, [float("nan"), 1, 0]),
            (300, [float("inf"), 1, 0]), (350, [None, 1, 0]), (400, [1, 2]), (None, [1, 0, 0.1]), (7, [1, 0, 0]), (7, [1, 0, 0]),
            (450, [0, 0, -1])]
    df = frame(spark, rows)
    got = A.search(df, df.filter("vec_id % 50 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(by) == {0, 50, 450}
    assert by[0] == [(1, 7), (2, 7), (3, 50), (4, 450)]
    assert by[50] == [(1, 0), (2, 7), (3, 7), (4, 450)]
    assert by[450] == [(1, 0), (2, 7), (3, 7), (4, 50)]
    empty = frame(spark, [])
    assert A.search(empty, empty).collect() == []
    one = frame(spark, [(50, [1.0, 2.0])])
    assert A.search(one, one).collect() == []


def test_walk_visits_every_leaf_once():
    rng = np.random.default_rng(2)
    x = A._unit(rng.normal(size=(900, 8)))
    tree = A.Tree(x, 20)
    order = tree.best_bins(x[3], 10_000)
    assert sorted(order) == sorted(tree.leaves) and len(order) > 30
    assert order[0] == tree.leaf_of(x[3:4])[0]
    assert tree.best_bins(x[3], 4) == order[:4]


def test_an_outlier_among_small_leaves_gets_all_its_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "LEAF_ROWS", 4)
    monkeypatch.setattr(A, "MIN_SAMPLE_LEAF", 1)
    monkeypatch.setattr(A, "calibrate", lambda *a: 1)           # few visits suffice for the others
    rng = np.random.default_rng(4)
    centres = np.abs(rng.normal(size=(20, 8)))
    rows = [(i, centres[i % 20] + 0.01 * rng.normal(size=8)) for i in range(300)]
    rows += [(1000, -centres[0]), (1050, -centres[1] * [1, 1, 1, 1, 0, 0, 0, 0])]
    df = frame(spark, rows)
    got = A.search(df, df.filter("vec_id % 50 = 0")).collect()
    count = {q: sum(r.query_id == q for r in got) for q in [0, 50, 100, 150, 200, 250, 1000, 1050]}
    assert set(count.values()) == {5}, count


def test_calibration_leaves_the_query_out(spark):
    x = np.eye(4)
    tree = A.Tree(x, 1)
    df = spark.createDataFrame([(int(leaf), [float(v) for v in row], i) for i, (leaf, row) in enumerate(zip(tree.leaf_of(x), x))],
                               "leaf int, embedding array<double>, gid long")
    shared = spark.sparkContext.broadcast(tree)
    assert A.calibrate(df, df.select("gid", "embedding"), shared, 2, 0.5) > 1      # a query finds itself in its first leaf
