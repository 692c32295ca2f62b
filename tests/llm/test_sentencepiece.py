import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from pagesift.llm import sentencepiece_bpe as S
from llm_rows import none, odd, odd_rows  # noqa: F401

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(1)
    parts = ["a", "e", "t", "th", " ", "  ", "▁", "\n", "é", "😀", "\x00", "zz", "the", " of", "b", "1", "　", "ing", "​", ""]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    runs = [" " * n for n in range(120)] + ["x" + " " * n + "\n" + " " * (n % 5) for n in range(80)]
    return made + runs + ["a" * n for n in range(80)] + ["ab" * 3000, "é" * 500, "", " "]


def test_ids_are_those_of_the_library():
    t = texts()
    v = S.vocabulary(MODEL)
    for mine, theirs in zip(v.encode(t), LIBRARY.encode(t, add_bos=True, add_eos=True)):
        assert mine.tolist() == theirs


def test_decoding_any_ids():
    rng = random.Random(2)
    ids = [np.array([rng.choice([1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 172, 198, 230])
                     for _ in range(rng.randint(0, 9))], np.uint32) for _ in range(1500)]
    for got, x in zip(S.vocabulary(MODEL).decode(ids), ids):
        assert got == LIBRARY.decode(x.tolist())


def test_round_trip():
    t = [x for x in texts() if "▁" not in x]
    v = S.vocabulary(MODEL)
    assert v.decode(v.encode(t)) == t


def test_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(S, "WORD_CACHE", 5)
    v = S.Vocabulary(MODEL)
    for t in ["one two three four five six seven", "eight nine ten", "one two"]:
        assert v.encode([t])[0].tolist() == LIBRARY.encode(t, add_bos=True, add_eos=True)


def test_frame_of_odd_rows(odd, none):
    got = S.encode(odd, MODEL, digests=True).collect()
    rows = [r[:2] for r in odd_rows()]
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r, (_, t) in zip(got, rows):
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    plain = S.encode(odd, MODEL).collect()
    assert plain[1].token_ids == [1, 2] and plain[1].decoded == ""
    assert S.encode(none, MODEL).collect() == []
