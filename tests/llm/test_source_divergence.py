import random
from collections import Counter, defaultdict

import pytest
from llm_rows import none, odd  # noqa: F401

from pagesift.llm import source_divergence as S


def terms_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def brute(rows, min_docs, top):
    docs = [((a or ""), (b or ""), terms_of(c)) for a, b, c in rows]
    df, count = Counter(), defaultdict(Counter)
    for lang, source, ts in docs:
        count[lang, source].update(ts)
        df.update((lang, t) for t in set(ts))
    out = []
    for lang in {x[0] for x in docs}:
        kept = sorted(t for (g, t), n in df.items() if g == lang and n >= min_docs)
        sources = sorted({s for g, s, _ in docs if g == lang})
        v = len(kept)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(b, sum((p[s][t] - p[b][t]) ** 2 // (p[s][t] + p[b][t]) for t in kept)) for b in sources if b != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, f, k + 1) for k, (i, f) in enumerate(items)]
    return sorted(out)


def made(seed, n_sources):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ba", "ÉT", "ño", "x") for b in "abcdefgh"]
    rows = []
    for _ in range(150):
        source = f"s{min(rng.randrange(n_sources), rng.randrange(n_sources))}"
        text = rng.choice([None, "", "Ba1ba-BA ba"] + [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(12)])
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice([source, source, source, None]), text))
    rows += [("en", "s0", "the same long text of many words")] * 60 + [("en", "s1", "the same long text of many words")] * 3
    return rows + [("xx", "lonely", "few words"), ("yy", "a", "1 2"), ("yy", "b", None), ("zz", "", "")]


@pytest.mark.parametrize("block", [512, 2])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)       # 2: pairs across blocks of sources
    monkeypatch.setattr(S, "PAIRS", 50)
    monkeypatch.setattr(S, "HELD", 20 * block)
    rows = made(block, 7)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = S.audit(docs, min_docs=3, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 4)


def test_texts_are_collapsed_per_language(spark):
    rows = made(1, 4)
    texts = S.collapse(spark.createDataFrame(rows, "lang string, source string, text string")).collect()
    back = Counter()
    for r in texts:
        for s, n in zip(r.sources, r.copies):
            back[r.lang, s, r.text] += n
    assert back == Counter((a or "", b or "", c or "") for a, b, c in rows)
    assert sum(r.text.startswith("the same long") for r in texts) == 1


def test_terms_of_pieces():
    text = "AbÉ cd1EF\tnaïve'x 北京 " * 50 + "tail"
    assert S.term_counts(text, 7) == S.term_counts(text) == Counter(t.encode() for t in terms_of(text))
    assert S.term_counts("1 2 3 \x7f") == Counter()


def test_large_counts_stay_exact(spark):
    row = spark.createDataFrame([(4 * 10**12, 9 * 10**12, 3)], "n long, total long, v long")
    got = row.select(S.share("n", "total")).first()[0]
    assert got == 1 + 10**9 * (4 * 10**12 + 2) // (9 * 10**12 + 6)


def test_odd_rows(odd, none):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in S.audit(odd, 2, 10).collect()) == brute(rows, 2, 10)
    assert S.audit(none).collect() == []
