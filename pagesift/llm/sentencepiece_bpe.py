"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text gets the dummy prefix and its spaces become U+2581.  No piece of the
vocabulary reaches across the start of a word (checked when the model is read),
so a text falls apart into words, each with at most one leading U+2581, and
runs of further U+2581.  The distinct words of a batch are encoded together:
one flat numpy array of symbols, a rank per adjacent pair, the smallest rank
of each word by a segmented minimum, and in every round each word merges its
leftmost pair of that rank (all non-overlapping ones of the rank at once where
no new pair could come before them); merged symbols are compacted away and
finished words leave, until no pair remains.  Characters outside the
vocabulary become byte pieces.  Runs of U+2581 follow the same rule (equal
scores, leftmost first) and are kept by length.

Decoding joins the bytes of all pieces of a batch in one gather.

Defined results: a null or empty text encodes to the begin and end ids and
decodes to the empty string; U+2581 in a text decodes to a space, as in the
library; repeated rows and ties need no rule, every row is encoded by itself;
only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

MARK = "▁"
NONE = np.int64(1) << 40
WORD_CACHE = 200_000      # distinct words a worker remembers; a full cache starts anew
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes):
    """(field number, value) pairs of a protocol buffer message."""
    def varint(i):
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i
    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, i = varint(i)
            value, i = data[i:i + n], i + n
        yield tag >> 3, value


SLOT_MASK = (1 << 18) - 1


def _slot(key: np.ndarray) -> np.ndarray:
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(46)).astype(np.int64)


class Vocabulary:
    """Pieces, pair ranks and piece bytes of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        pieces = []
        for number, value in message:
            if number == 1:
                d = dict(_fields(value))
                pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, bytes(4)))[0], d.get(3, NORMAL)))
        trainer = dict(_fields(next(v for n, v in message if n == 2)))
        normal = dict(_fields(next(v for n, v in message if n == 3)))
        if trainer.get(3) != 2 or normal.get(1) != b"identity" or normal.get(4, 1) or not normal.get(3, 1):
            raise ValueError("needs a BPE model with identity normalisation, a dummy prefix and all white space kept")
        self.pieces = pieces
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.ids):
            raise ValueError("a piece reaches across the start of a word")
        self.bos = next(i for i, x in enumerate(pieces) if x[2] == CONTROL and x[0] == "<s>")
        self.eos = next(i for i, x in enumerate(pieces) if x[2] == CONTROL and x[0] == "</s>")
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        if len(self.byte_ids) != 256:
            raise ValueError("needs byte pieces")
        # rank: 0 for the best score, equal scores share a rank
        scores = sorted({s for p, s, kind in pieces if kind == NORMAL}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        rank = {i: rank_of[pieces[i][1]] for i in self.ids.values()}
        pairs = []
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, i, rank[i]))
        pairs.sort()
        self.pair_key = np.array([x[0] for x in pairs], np.int64)
        self.pair_id = np.array([x[1] for x in pairs], np.int64)
        self.pair_rank = np.array([x[2] for x in pairs], np.int64)
        # open addressing: one probe finds nearly every pair
        self.slots = np.full(SLOT_MASK + 1, -1, np.int32)
        for i, slot in enumerate(_slot(self.pair_key).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & SLOT_MASK
            self.slots[slot] = i
        # a piece is "late" when every pair it is part of ranks after it: then
        # all leftmost pairs of a rank may merge in one round
        best = np.full(len(pieces), NONE)
        for side in (self.pair_key >> 32, self.pair_key & 0xFFFFFFFF):
            np.minimum.at(best, side, self.pair_rank)
        self.late = np.array([best[i] > rank.get(i, -1) for i in range(len(pieces))])
        self.pair_rank = np.append(self.pair_rank, NONE)
        longest = max(len(p) for p in self.ids if not p.strip(MARK))
        self.run_step, self.run_id = longest, self.ids.get(MARK * longest)
        self.mark = self.ids[MARK]
        self.piece_bytes = [self._bytes(p, kind) for p, _, kind in pieces]
        lens = np.array([len(b) for b in self.piece_bytes], np.int64)
        self.byte_start = np.concatenate(([0], np.cumsum(lens)))
        self.byte_pool = np.frombuffer(b"".join(self.piece_bytes), np.uint8)
        self.is_control = np.array([kind == CONTROL for _, _, kind in pieces])
        self.starts_word = np.array([kind == NORMAL and p.startswith(MARK) for p, _, kind in pieces])
        self._words: dict[str, int] = {}
        self._flat = np.zeros(0, np.uint32)
        self._offset = np.zeros(1, np.int64)
        self._runs: dict[int, np.ndarray] = {}

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the pair table, -1 if there is none."""
        key = np.where((left >= 0) & (right >= 0), left << 32 | np.maximum(right, 0), -1)
        slot = _slot(key)
        at = self.slots[slot]
        todo = np.flatnonzero((at >= 0) & (self.pair_key[at] != key))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & SLOT_MASK
            at[todo] = self.slots[slot[todo]]
            todo = todo[(at[todo] >= 0) & (self.pair_key[at[todo]] != key[todo])]
        return at

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words by vectorised merge rounds."""
        joined = "".join(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        uniq, inverse = np.unique(chars, return_inverse=True)
        # outside the vocabulary: minus (code point + 1), which joins no pair
        first = np.array([self.ids.get(chr(c), -int(c) - 1) for c in uniq], np.int64)
        sym = first[inverse] if len(uniq) else np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(words)), lens)
        done_word, done_sym = [], []
        at = np.full(len(sym), -1, np.int64)          # pair of each symbol with the next
        same = np.flatnonzero(word[:-1] == word[1:])
        at[same] = self._pair(sym[same], sym[same + 1])
        while len(sym):
            rank = self.pair_rank[at]                 # -1 reads the entry for "no pair"
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            keep = low < NONE
            if not keep.all():
                live = np.repeat(keep, sizes)
                done_word.append(word[~live])
                done_sym.append(sym[~live])
                sym, word, rank, at = sym[live], word[live], rank[live], at[live]
                low, sizes = low[keep], sizes[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            hit = self._leftmost(hit, word, self.late[self.pair_id[at[hit]]])
            sym[hit] = self.pair_id[at[hit]]
            left = np.ones(len(sym), bool)
            left[hit + 1] = False
            sym, word, at = sym[left], word[left], at[left]
            hit = hit - np.arange(len(hit))           # where the merged symbols are now
            fresh = np.concatenate((hit, hit[hit > 0] - 1))
            last = fresh == len(sym) - 1
            at[fresh[last]] = -1
            fresh = fresh[~last]
            joined_up = word[fresh] == word[fresh + 1]
            at[fresh[~joined_up]] = -1
            fresh = fresh[joined_up]
            at[fresh] = self._pair(sym[fresh], sym[fresh + 1])
        if done_sym:
            sym, word = np.concatenate(done_sym), np.concatenate(done_word)
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        return self._bytes_for_unknown(sym, word, len(words))

    @staticmethod
    def _leftmost(hit, word, late):
        """The pairs to merge in this round: of each word the leftmost, and
        beyond it every other one of the rank that does not overlap, if the
        merged piece is late."""
        n = len(hit)
        new_word = np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))
        # in a chain of adjacent hits (a a a a) every second one overlaps
        chain = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | new_word[1:]))
        start = np.maximum.accumulate(np.where(chain, np.arange(n), 0))
        pick = (np.arange(n) - start) % 2 == 0
        # pieces of one rank but different pairs, or early pieces: only the first
        group = np.cumsum(new_word) - 1
        all_late = np.ones(group[-1] + 1, bool)
        np.logical_and.at(all_late, group, late)
        return hit[(pick & all_late[group]) | new_word]

    def _bytes_for_unknown(self, sym, word, n_words):
        if (sym < 0).any():
            out, owner = [], []
            cuts = np.flatnonzero(sym < 0)
            last = 0
            for c in cuts:
                out.append(sym[last:c])
                owner.append(word[last:c])
                code = chr(-int(sym[c]) - 1).encode("utf-8", "surrogatepass")
                out.append(np.array([self.byte_ids[b] for b in code], np.int64))
                owner.append(np.full(len(code), word[c]))
                last = c + 1
            sym = np.concatenate([*out, sym[last:]])
            word = np.concatenate([*owner, word[last:]])
        return sym.astype(np.uint32), np.concatenate(([0], np.cumsum(np.bincount(word, minlength=n_words))))

    def _run(self, n: int) -> np.ndarray:
        """Ids of a run of n U+2581: long runs lose whole longest pieces from
        the left, as the leftmost-first rule builds them."""
        if n not in self._runs:
            head = max(0, (n - 2 * self.run_step) // self.run_step)
            rest, _ = self.encode_words([MARK * (n - head * self.run_step)])
            self._runs[n] = np.concatenate((np.full(head, self.run_id, np.uint32), rest))
        return self._runs[n]

    def _learn(self, words: list[str]) -> None:
        if len(self._words) > WORD_CACHE:
            self._words, self._flat, self._offset = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)
        new = [w for w in dict.fromkeys(words) if w not in self._words]
        if new:
            ids, offset = self.encode_words(new)
            base = len(self._offset) - 1
            self._words.update(zip(new, range(base, base + len(new))))
            self._offset = np.concatenate((self._offset, offset[1:] + self._offset[-1]))
            self._flat = np.concatenate((self._flat, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with begin and end ids."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        has_run = [MARK * 2 in t or t[-1:] == MARK for t in marked]
        split = [WORD.findall(t) for t in marked]
        self._learn([w for ws, runs in zip(split, has_run) for w in ws if not runs or w.strip(MARK)])
        out = []
        ends = np.array([self.bos], np.uint32), np.array([self.eos], np.uint32)
        for ws, runs in zip(split, has_run):
            if not ws:
                out.append(np.concatenate(ends))
            elif runs:
                out.append(np.concatenate([ends[0], *self._with_runs(ws), ends[1]]))
            else:
                at = np.fromiter(map(self._words.__getitem__, ws), np.int64, len(ws))
                out.append(np.concatenate((ends[0], _ragged(self._flat, self._offset, at), ends[1])))
        return out

    def _with_runs(self, ws: list[str]) -> list[np.ndarray]:
        """Units of one text where a run of U+2581 stands before a word or at
        the end; a word whose own mark joined nothing gives it to the run."""
        parts, i = [], 0
        while i < len(ws):
            w = ws[i]
            if w.strip(MARK):
                k = self._words[w]
                parts.append(self._flat[self._offset[k]:self._offset[k + 1]])
            else:
                n = len(w)
                if i + 1 < len(ws):
                    k = self._words[ws[i + 1]]
                    ids = self._flat[self._offset[k]:self._offset[k + 1]]
                    bare = ids[0] == self.mark
                    parts += [self._run(n + 1), ids[1:]] if bare else [self._run(n), ids]
                    i += 1
                else:
                    parts.append(self._run(n))
            i += 1
        return parts

    def decode(self, ids_of: list[np.ndarray]) -> list[str]:
        """Texts of id arrays, as the library's decode: control pieces vanish,
        the dummy prefix is dropped, bytes that form no character become
        U+FFFD each."""
        flat = np.concatenate(ids_of) if ids_of else np.zeros(0, np.uint32)
        flat = flat.astype(np.int64)
        lens = self.byte_start[flat + 1] - self.byte_start[flat]
        data = _ragged(self.byte_pool, self.byte_start, flat).tobytes()
        ends = np.concatenate(([0], np.cumsum(lens)))
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids_of])))
        out = []
        for i, ids in enumerate(ids_of):
            raw = data[ends[bounds[i]]:ends[bounds[i + 1]]]
            control = np.flatnonzero(self.is_control[ids])
            body = ids[~self.is_control[ids]]
            skip = len(body) > 0 and self.starts_word[body[0]]
            inner = control[(control > 0) & (control < len(ids) - 1)]
            if len(inner):    # bytes on either side of a control piece form no character together
                cuts = ends[bounds[i] + inner] - ends[bounds[i]]
                chunks = [raw[x:y] for x, y in zip([0, *cuts], [*cuts, len(raw)])]
            else:
                chunks = [raw]
            whole = "".join(_text(c) for c in chunks)
            out.append(whole[1:] if skip else whole)
        return out


#: a word with its own mark, a run of marks before such a word, or a run at the end
WORD = re.compile(f"{MARK}+(?={MARK}[^{MARK}])|{MARK}?[^{MARK}]+|{MARK}+")


def _ragged(flat: np.ndarray, offset: np.ndarray, at: np.ndarray) -> np.ndarray:
    """flat[offset[k]:offset[k + 1]] for every k of ``at``, joined."""
    start, size = offset[at], offset[at + 1] - offset[at]
    total = int(size.sum())
    if not total:
        return flat[:0]
    step = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    return flat[step + np.arange(total)]


def _text(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The model, read once per Python worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text",
           digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, token_ids array<int>, decoded string per row; with
    ``digests`` ids_sha256 and decoded_sha256 instead of the ids and the text."""
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, n_tokens bigint, "
    schema += "ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>, decoded string"

    def run(batches):
        v = vocabulary(model)
        for b in slices(batches, text, 2 << 20):
            ids = v.encode(texts_of(b, text))
            back = v.decode(ids)
            key = b.column(b.schema.get_field_index(doc_id))
            count = pa.array([len(x) for x in ids], pa.int64())
            if digests:
                more = [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])]
                names = ["ids_sha256", "decoded_sha256"]
            else:
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                more = [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(back, pa.string())]
                names = ["token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays([key, count, *more], [doc_id, "n_tokens", *names])

    return docs.select(doc_id, text).mapInArrow(run, schema)
