"""Language identification by a linear-chain conditional random field.

Every word (run of letters, lower case) of a text gets a label.  Emission
scores are sums of hashed feature weights: the word itself (lexicon), prefixes
and suffixes of one to three letters (affixes) and letter bigrams and trigrams
with word boundaries.  Transition scores between labels are learned with them
by maximum conditional likelihood (forward-backward gradients, Adagrad).  A
training sequence strings pieces of several labelled documents together, so
the field learns where text switches language.  Forward-backward over the
whole text gives every word's label probabilities; a document's language is
the label with the largest expected number of words, its score that share.

The field is fitted on a bounded sample of labelled rows: the first
``ROWS_PER_LANGUAGE`` rows of each language in the order of a hash of doc_id,
whole texts.  Its size is fixed (``DIMENSION`` x languages), so broadcasting
it is bounded.  Prediction is a map over whole texts: sequences are cut into
chunks whose transfer matrices are multiplied in step, so that one long text
costs no more per word than many short ones, with the same result as one chain.

Defined results: null, empty or letterless texts are ``und`` with score 0;
ties go to the language first in sort order; without labelled rows every text
is ``und``; a null doc_id counts as training row; rows are judged by
themselves; only the named columns are read, and the language, source and id
of a row are never inputs of its prediction.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, texts_of

DIMENSION = 1 << 18
ROWS_PER_LANGUAGE = 250
EPOCHS, BATCH, PIECE = 3, 256, 20      # sequences of three pieces of up to 2 * PIECE words
RATE, DECAY = 0.3, 1e-6
CHUNK = 64
RESCALE = 8               # steps between rescalings; emissions are cut at exp(-MOST)
MOST = 60.0
WORD_CACHE = 150_000
UNKNOWN = "und"
WORDS = regex.compile(r"\p{L}+")          # letters by category: no ², ½ or Ⅷ


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, offsets): the hashed features of each word."""
    text = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"),
                         np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(text)) - start[owner]
    m = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

    def mix(h, kind):
        h = (h + np.uint64(kind)) * m[0]
        h ^= h >> np.uint64(29)
        h *= m[1]
        return (h >> np.uint64(64 - 18)).astype(np.int64)

    power = np.cumprod(np.full(int(lens.max()), m[3]))
    lexicon = np.add.reduceat(text * power[place], start)
    two = text[:-1] * m[2] + text[1:]
    three = two[:-1] * m[2] + text[2:]
    last = lens[owner] - 1 - place         # letters to the right
    whole = np.arange(len(words))
    parts = [(mix(lexicon, 1), whole)]
    at = np.flatnonzero(last[:-1] >= 1)
    parts.append((mix(two[at], 2), owner[at]))
    at = np.flatnonzero(last[:-2] >= 2)
    parts.append((mix(three[at], 3), owner[at]))
    one = start + 1
    for k, (first, code) in enumerate(((one, text), (one, two), (one, three))):
        ok = lens - 2 > k                  # the affix has k + 1 letters
        parts.append((mix(code[first[ok]], 10 + k), whole[ok]))
        parts.append((mix(code[(start + lens - 2 - k)[ok]], 20 + k), whole[ok]))
    number, owner = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(owner, kind="stable")
    return number[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))


def emissions(weights: np.ndarray, number: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Scores of words for every label, scaled by the square root of the
    number of features so long words do not drown short ones."""
    scale = np.sqrt(np.diff(offset))[:, None]
    return np.add.reduceat(weights[number], offset[:-1], axis=0) / scale


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of every word of sequences laid end to end
    (forward-backward in linear space, rescaled at every step)."""
    n_labels = scores.shape[1]
    A = np.exp(transitions - transitions.max())
    e = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -MOST))
    lengths = lengths[lengths > 0]
    chunks = -(-lengths // CHUNK)
    n = int(chunks.sum())
    first_chunk = np.cumsum(chunks) - chunks
    nth = np.arange(n) - np.repeat(first_chunk, chunks)
    size = np.minimum(CHUNK, np.repeat(lengths, chunks) - nth * CHUNK)
    # chunks in order of size, so the chunks that have a step are the first ones
    order = np.argsort(-size, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    step = np.arange(CHUNK)
    real = step[None, :] < size[:, None]
    place = np.zeros((n, CHUNK), np.int64)
    place[real] = np.arange(len(e))
    place = np.ascontiguousarray(place[order].T)          # (steps, chunks): word of every step
    live = np.searchsorted(-size[order], -step, side="left")
    head = nth[order] == 0

    def forward(state, t):                 # (n, k, labels) messages, in order of size
        now = state[: live[t]]
        moved = now @ A
        if t == 0:
            moved[head] = now[head]
        moved *= e[place[t, : live[t]], None, :]
        if t % RESCALE == RESCALE - 1:
            moved /= moved.max(axis=(1, 2), keepdims=True)
        state[: live[t]] = moved

    transfer = np.broadcast_to(np.eye(n_labels), (n, n_labels, n_labels)).copy()
    for t in range(CHUNK):
        forward(transfer, t)
    transfer = (transfer / transfer.max(axis=(1, 2), keepdims=True))[rank]
    into, out = np.ones((n, n_labels)), np.ones((n, n_labels))
    by_length = np.argsort(-chunks, kind="stable")
    for k in range(1, int(chunks.max())):
        some = by_length[: np.searchsorted(-chunks[by_length], -k, side="left")]
        now = first_chunk[some] + k
        into[now] = np.einsum("ni,nij->nj", into[now - 1], transfer[now - 1])
        into[now] /= into[now].max(axis=1, keepdims=True)
    for k in range(int(chunks.max()) - 1, 0, -1):
        some = by_length[: np.searchsorted(-chunks[by_length], -k, side="left")]
        now = first_chunk[some] + k
        out[now - 1] = np.einsum("nij,nj->ni", transfer[now], out[now])
        out[now - 1] /= out[now - 1].max(axis=1, keepdims=True)
    p = np.empty_like(e)
    state = into[order][:, None, :]
    for t in range(CHUNK):
        forward(state, t)
        p[place[t, : live[t]]] = state[: live[t], 0]
    beta = out[order]
    back = A.T.copy()
    for t in range(CHUNK - 1, -1, -1):
        k = live[t]
        at = place[t, :k]
        p[at] *= beta[:k]
        moved = (e[at] * beta[:k]) @ back
        if t % RESCALE == 0:
            moved /= moved.max(axis=1, keepdims=True)
        beta[:k] = moved
    return p / p.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 5) -> dict | None:
    """Weights and transitions from labelled texts; None without any words."""
    labels = sorted(set(langs))
    vocabulary: dict[str, int] = {}
    seqs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    sizes = np.array([len(x) for x in seqs], np.int64)
    if not sizes.sum():
        return None
    flat = np.concatenate(seqs)
    gold = np.repeat([labels.index(g) for g in langs], sizes)
    number, offset = features(list(vocabulary))
    k = len(labels)
    rng = np.random.default_rng(seed)
    weights, grown = np.zeros((DIMENSION, k)), np.full((DIMENSION, k), 1e-3)
    trans, trans_grown = np.zeros((k, k)), np.full((k, k), 1e-3)
    for _ in range(EPOCHS):
        # cut all words into pieces of random length and string three together
        cuts = np.concatenate(([0], np.cumsum(rng.integers(5, 2 * PIECE + 1, size=len(flat) // 5 + 1))))
        cuts = np.append(cuts[cuts < len(flat)], len(flat))
        ends = np.cumsum(sizes)
        cuts = np.unique(np.concatenate((cuts, ends)))
        order = rng.permutation(len(cuts) - 1)
        for b in range(0, len(order), 3 * BATCH):
            some = order[b:b + 3 * BATCH]
            size = cuts[some + 1] - cuts[some]
            at = np.repeat(cuts[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            lengths = np.add.reduceat(size, np.arange(0, len(size), 3))
            word, inverse = np.unique(flat[at], return_inverse=True)
            feats = np.diff(offset)[word]
            pick = np.repeat(offset[word] - (np.cumsum(feats) - feats), feats) + np.arange(feats.sum())
            off = np.concatenate(([0], np.cumsum(feats)))
            num = number[pick]
            score = emissions(weights, num, off)[inverse]
            p = marginals(score, lengths, trans)
            y = gold[at]
            # emission gradient per distinct word, then per feature
            wrong = p.copy()
            wrong[np.arange(len(y)), y] -= 1.0
            per_word = np.stack([np.bincount(inverse, wrong[:, j], len(word)) for j in range(k)], 1)
            per_word /= np.sqrt(feats)[:, None] * len(y)
            spread = np.repeat(per_word, feats, axis=0)
            uniq, where = np.unique(num, return_inverse=True)
            g = np.stack([np.bincount(where, spread[:, j], len(uniq)) for j in range(k)], 1) + DECAY * weights[uniq]
            grown[uniq] += (g * len(lengths)) ** 2
            weights[uniq] -= RATE * g * len(lengths) / np.sqrt(grown[uniq])
            # transition gradient: expected pairs (from the marginals of neighbours) less seen ones
            begins = np.cumsum(lengths) - lengths
            inner = np.ones(len(y), bool)
            inner[begins] = False
            i = np.flatnonzero(inner)
            pair = _pairs(score, p, i, trans)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[i - 1], y[i]), 1.0)
            g = (pair - seen) / max(1, len(i))
            trans_grown += (g * len(lengths)) ** 2
            trans -= RATE * g * len(lengths) / np.sqrt(trans_grown)
    return {"labels": labels, "weights": weights.astype(np.float32), "transitions": trans}


def _pairs(score, p, i, trans) -> np.ndarray:
    """Expected label pairs of neighbours i-1, i.  The pair probability is
    p(a) * p(b) * exp(trans) fitted to both marginals (two rounds of
    proportional fitting), which the chain's marginals determine."""
    left, right = p[i - 1], p[i]
    A = np.exp(trans - trans.max())
    u, v = left.copy(), right.copy()
    for _ in range(3):
        u = left / np.maximum(v @ A.T, 1e-30)
        v = right / np.maximum(u @ A, 1e-30)
    return A * (u.T @ v)


class Tagger:
    """Predicts with a fitted field; remembers emission scores of words."""

    def __init__(self, model: dict):
        self.labels, self.weights, self.transitions = model["labels"], model["weights"], model["transitions"]
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.labels)))

    def word_marginals(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
        words = [words_of(t) for t in texts]
        if len(self.known) > WORD_CACHE:
            self._clear()
        flat = list(itertools.chain.from_iterable(words))
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if new:
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new))))
            self.scores = np.concatenate((self.scores, emissions(self.weights, *features(new))))
        lengths = np.array([len(w) for w in words], np.int64)
        if not lengths.sum():
            return words, np.zeros((0, len(self.labels)))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        return words, marginals(self.scores[at], lengths, self.transitions)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        words, p = self.word_marginals(texts)
        ends = np.cumsum([len(w) for w in words])
        langs, scores = [], []
        for ws, end in zip(words, ends):
            if not ws:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            share = p[end - len(ws):end].mean(axis=0)
            best = int(share.argmax())
            langs.append(self.labels[best])
            scores.append(float(min(1.0, share[best])))
        return langs, scores


def sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """The bounded training sample: ``rows`` rows of each language, whole texts."""
    keys = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), F.xxhash64("doc_id").alias("_h"))
    few = (keys.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_id")))
           .filter(F.col("_n") <= rows).select("_lang", "_id").distinct())
    found = (docs.join(F.broadcast(few), (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
             .select("doc_id", "text", "lang"))
    # a doc_id may come any number of times
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rows).drop("_n")


def predict(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs(doc_id, text,
    lang)``; the field is fitted on ``train`` (default: ``docs``)."""
    rows = sample(docs if train is None else train).orderBy("lang", F.xxhash64("doc_id"), "text").collect()
    model = fit([r.text or "" for r in rows], [r.lang for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tagger = Tagger(shared.value) if shared.value else None     # its words go with the task
        for b in slices(batches, "text"):
            texts = texts_of(b)
            langs, scores = tagger.predict(texts) if tagger else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, train: DataFrame, min_score: float = 0.35) -> DataFrame:
    """The rows of ``docs`` whose language is known, all columns: rows without
    letters go, and rows in which no language reaches ``min_score`` of the
    words."""
    rows = sample(train).orderBy("lang", F.xxhash64("doc_id"), "text").collect()
    model = fit([r.text or "" for r in rows], [r.lang for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tagger = Tagger(shared.value) if shared.value else None
        for b in slices(batches, "text") if tagger else ():
            langs, scores = tagger.predict(texts_of(b))
            ok = pa.array([g != UNKNOWN and s >= min_score for g, s in zip(langs, scores)], pa.bool_())
            yield b.filter(ok)

    return docs.mapInArrow(run, docs.schema)
