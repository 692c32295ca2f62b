"""Rows for edge cases, shared by the tests of this folder."""

import pytest

SF = "/root/testdata/sf0.001"

# columns whose names the operators use inside
CLASH = ["lang", "source", "n_chars", "kept", "key", "sha", "n", "d", "uid", "bucket", "text_sha256", "word", "block", "spans"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)


def odd_rows():
    """Nulls, empties, ties, repeated rows and a long text, with extra columns."""
    words = [f"w{i % 97}x{i % 89}" for i in range(40_000)]
    same = " ".join(f"token{i}" for i in range(120))
    texts = [(1, None), (2, ""), (3, ""), (4, same), (5, same), (5, same), (5, same.replace("token7 ", "other7 ")),
             (None, "a text without an id, of some words more than five"), (None, None), (6, " ".join(words)),
             (7, "Übergrößen ÄÖÜ naïve 北京 😀 \t\n  end "), (8, "   \n\t "), (9, "1234 5678 !!!"), (10, "one two")]
    return [(i, t, *[None if k % 3 == 0 else "en" if c == "lang" else f"{c}{k}" for c in CLASH])
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
