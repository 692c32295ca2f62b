import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_rows import SF, none, odd  # noqa: F401

from pagesift.llm import catalog
from pagesift.llm import periodic_runs as R


def brute(words):
    """All runs by trying every period and every maximal stretch."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(24, 3 * q):
                found.setdefault((a, i + q - a), q)
    return sorted((a, m, q) for (a, m), q in found.items())


def collapsed(words, runs):
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    words = []
    while len(words) < rng.choice([5, 30, 120, 400]):
        kind = rng.random()
        if kind < 0.4:
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        else:
            period = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 60]))]
            m = rng.randint(1, 5 * len(period) + 20)
            words += (period * m)[:m]
    return words


def test_all_runs_by_brute_force():
    rng = random.Random(5)
    docs = [random_words(rng) for _ in range(150)] + [[], ["a"] * 23, ["a"] * 24, ["a", "b"] * 200, ["a"] * 700]
    docs += [(["a"] * 40 + ["b"]) * 9, [f"w{i % 130}" for i in range(390)], [f"w{i % 130}" for i in range(389)]]
    got = R.summaries([" ".join(d) for d in docs])
    for words, (runs, rest) in zip(docs, got):
        assert runs == brute(words), words
        assert rest == collapsed(words, runs)


def test_best_run_compares_exactly():
    assert R.best_run([]) is None
    assert R.best_run([(0, 24, 7), (50, 48, 14), (200, 49, 14)]) == (200, 49, 14)
    assert R.best_run([(0, 48, 14), (50, 24, 7)]) == (0, 48, 14)


@pytest.mark.parametrize("p,n", [(R.FERMAT, 16), (R.FERMAT, 64), (R.FERMAT, 1024), (R.FERMAT, 65536), (R.WIDE, 128)])
def test_convolution_is_exact(p, n):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, p, (2, n)), rng.integers(0, p, (2, n))
    a[1], b[1] = p - 1, p - 1
    b[0, 40:] = 0
    got = (R._cyclic(a.astype(float), b.astype(float)) if p == R.FERMAT else R._wide_cyclic(a.copy(), b.copy())).astype(int) % p
    for i in (0, 1, 7, n - 1):
        assert got[0, i] == sum(int(a[0, (i - j) % n]) * int(b[0, j]) for j in range(min(n, 40))) % p
        assert got[1, i] == n % p


def test_wide_scale():
    """A period beyond the Fermat transforms: 40,000 words, three times."""
    words = [f"x{i}" for i in range(40_000)]
    (runs, rest), = R.summaries([" ".join(["q", *words * 3, "z"])])
    assert runs == [(1, 120_000, 40_000)]
    assert rest == " ".join(["q", *words, "z"])


def test_lying_hashes_are_noticed(monkeypatch):
    seen = []
    real = R._intervals
    monkeypatch.setattr(R, "_intervals", lambda *a: seen.append(a[-1]) or real(*a[:3], 1 if len(seen) < 3 else a[-1]))
    words = [f"w{i % 12}" for i in range(40)] + [f"v{i}" for i in range(30)] + ["b", "a"] * 3 + ["a", "b"] * 30
    assert R.summaries([" ".join(words)])[0][0] == brute(words)


def test_query_by_brute_force(spark):
    got = {r.doc_id: r for r in catalog.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    n_planted = 0
    for r in docs:
        words = (r.text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            n_planted += 1
        if n > 1500:
            continue
        runs, x = brute(words), got[r.doc_id]
        best = max(runs, key=lambda t: (t[1] / t[2], -t[0], -t[2]), default=(None, None, None))
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *best)
        assert x.exponent_milli == (best[1] * 1000 // best[2] if runs else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert n_planted > 5 and sum(r.n_runs for r in got.values()) > 10


def test_odd_rows(odd, none):
    got = R.detect(odd, plant=True, digests=True).collect()
    assert len(got) == 14 and {r.doc_id for r in got} == {*range(1, 11), None}
    empty = hashlib.sha256(b"").hexdigest()
    for r in (got[0], got[1], got[8], got[11]):
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (0, None, None, None, None)
        assert r.runs_sha256 == r.collapsed_sha256 == empty
    assert got[4] == got[5]
    plain = R.detect(odd).collect()
    assert [tuple(r) for r in plain[9].runs] == [(0, 40_000, 97 * 89)]
    assert plain[9].collapsed.split() == odd.collect()[9].text.split()[:97 * 89]
    assert R.detect(none, digests=True).collect() == []


def test_words_end_at_ascii_blanks_only():
    (runs, rest), = R.summaries(["\x0b".join(["a b"] * 30) + " \t\x0c end end"])
    assert runs == [(0, 30, 1)] and rest == "a b end end"
