from pagesift.operators.fetchlog import attempt_verdict, fetch_outcome


def test_fx12_fetch_log(spark):
    log = spark.createDataFrame([
        ("u1", 0, 503, None), ("u1", 1, None, "timeout"), ("u1", 2, 200, None),
        ("u2", 0, 429, None), ("u2", 1, 429, None), ("u2", 2, 429, None), ("u2", 3, 429, None),
        ("u3", 0, 404, None), ("u4", 0, 500, None)], "url string, attempt int, status int, error_kind string")
    v = attempt_verdict(log)
    got = {(r.url, r.attempt): (r.verdict, r.delay) for r in v.collect()}
    assert got[("u1", 0)] == ("retry", 1.0) and got[("u1", 1)] == ("retry", 2.0) and got[("u1", 2)] == ("ok", 0.0)
    assert [got[("u2", i)] for i in range(4)] == [("retry", 5.0), ("retry", 10.0), ("retry", 20.0), ("fail", 0.0)]
    out = {r.url: (r.outcome, r.attempts, r.total_delay) for r in fetch_outcome(v).collect()}
    assert out == {"u1": ("ok", 3, 3.0), "u2": ("fail", 4, 35.0), "u3": ("fail", 1, 0.0), "u4": ("fail", 1, 0.0)}
