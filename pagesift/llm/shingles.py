"""Hashed word shingles of texts, computed on flat byte arrays."""

from __future__ import annotations

import functools

import numpy as np

WIDTH = 5                 # words in a shingle
LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASE = 0x9E3779B97F4A7C15 | 1
STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
                np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    return (np.cumprod(np.concatenate((one, np.full(n, BASE, np.uint64)))),
            np.cumprod(np.concatenate((one, np.full(n, inverse, np.uint64)))))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text); words are runs of other than
    ASCII white space, A-Z in lower case."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    letter = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    hashes = mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.diff(np.concatenate(([0], np.searchsorted(start, ends))))


def shingle_sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingle hashes, how often each occurs) per text.  A
    text of one to four words is one shingle; a text without words has none."""
    words, count = word_hashes(texts)
    ends = np.cumsum(count)
    n = len(words) - WIDTH + 1
    if n > 0:
        five = np.zeros(n, np.uint64)
        for i in range(WIDTH):
            five += words[i:i + n] * STEP[i]
        five = mix(five)
    out = []
    for c, end in zip(count.tolist(), ends.tolist()):
        if c >= WIDTH:
            s = np.sort(five[end - c:end - WIDTH + 1])
        elif c:
            s = mix((words[end - c:end] * STEP[:c]).sum(keepdims=True) + np.uint64(c))
        else:
            s = np.zeros(0, np.uint64)
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        out.append((s[first], np.diff(np.append(first, len(s)))))
    return out
