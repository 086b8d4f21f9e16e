"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good (1), bad (-1) or abstain (0) on a whole text.  Texts are counted by their pattern of votes
over all documents, and expectation-maximisation over these counts estimates the share of good texts and, for each labeller and each class,
how often it votes what; that gives the posterior of every pattern.  The posteriors label at most ``SAMPLE`` texts, taken by hash of their ids,
on which a logistic scorer over hashed words and word shapes is trained by stochastic gradient descent in numpy.  The scorer then scores
every whole text; a text is kept if its score is KEEP or more.

No true label is read.  Defined cases: null or empty text, or text without words, is bad on every labeller that judges it and scores as the
bias alone; an empty table gives an empty result; rows of one id, or without one, are answered each (and count in the labellers' statistics; the
scorer is trained on rows with an id, one of each).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, sample_rows, trim
from .wordcode import U, Words, counts_between, mix, slices, text_bytes

SAMPLE, BUCKETS, EPOCHS, RATE, BATCH, KEEP = 4000, 1 << 16, 6, 20.0, 32, 0.3
ROUNDS = 60


def _lut(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_SYMBOL = _lut("#$%&*+<=>@[\\]^_`{|}~")
_UPPER = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _lut("abcdefghijklmnopqrstuvwxyz")
_LETTER[0x80:] = True
_DIGIT = _lut("0123456789")
_STOP = _lut(".,;:?")
_BANG = _lut("!")
_NOT_LINE = np.ones(256, bool)
_NOT_LINE[[10, 13]] = False
NAMES = ("symbols", "capitals", "bare_words", "shouting", "digits", "short_words", "sentences", "repeated_lines", "length", "lone_signs", "repeated_words")


def _again(w: Words) -> np.ndarray:
    """Words that are the same as the one before in their text."""
    out = np.zeros(len(w.h), bool)
    out[1:] = (w.h[1:] == w.h[:-1]) & (w.text[1:] == w.text[:-1])
    return out


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of votes for each text."""
    w = Words(data, offsets)
    n = np.diff(offsets)
    words = np.diff(w.bounds)
    count = lambda t: counts_between(t[data], offsets)
    letters, safe = np.maximum(count(_LETTER), 1), np.maximum(n, 1)
    size = w.end - w.start
    at_least = np.maximum(words, 1)
    out = np.zeros((len(n), len(NAMES)), np.int8)

    def vote(k, bad, good):
        out[:, k] = np.where(bad, -1, np.where(good, 1, 0))

    symbols = count(_SYMBOL) / safe
    vote(0, symbols > 0.04, symbols < 0.01)
    capitals = count(_UPPER) / letters
    vote(1, capitals > 0.5, capitals < 0.2)
    plain = counts_between(_LETTER[data[w.start]] if len(w.start) else np.zeros(0, bool), w.bounds) / at_least
    vote(2, plain < 0.75, plain > 0.9)
    shout = count(_BANG) / at_least
    vote(3, shout > 0.3, shout < 0.05)
    digits = count(_DIGIT) / safe
    vote(4, digits > 0.2, digits < 0.05)
    short = counts_between(size <= 3, w.bounds) / at_least
    vote(5, (short < 0.08) | (words == 0), (short > 0.15) & (short < 0.6))
    ends = counts_between(_STOP[data[w.end - 1]] if len(w.end) else np.zeros(0, bool), w.bounds) / at_least
    vote(6, (words >= 20) & (ends < 0.02) | (words == 0), (words >= 20) & (ends > 0.05))
    lines = Words(data, offsets, _NOT_LINE)
    total = np.diff(lines.bounds)
    o = np.lexsort((lines.h, lines.text))
    new = np.ones(len(o), bool)
    new[1:] = (lines.h[o][1:] != lines.h[o][:-1]) | (lines.text[o][1:] != lines.text[o][:-1])
    repeated = 1 - counts_between(new, lines.bounds) / np.maximum(total, 1)
    vote(7, (total >= 4) & (repeated > 0.4), (total >= 4) & (repeated < 0.1))
    vote(8, words < 3, words >= 50)
    spelled = np.concatenate([[0], np.cumsum((_LETTER | _DIGIT)[data])])
    lone = counts_between(spelled[w.end] == spelled[w.start], w.bounds) / at_least
    vote(9, lone > 0.1, lone < 0.02)
    again = counts_between(_again(w), w.bounds) / at_least
    vote(10, again > 0.2, again < 0.05)
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    """A number for each row of votes."""
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts' numbers, by slices, so that memory is a slice's and not the texts'."""
    out = [pattern(votes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in slices(offsets)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def posterior(patterns: np.ndarray, counts: np.ndarray, labellers: int = len(NAMES), rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """(P(good) of each pattern, share of good, P(vote | class) as [class, labeller, vote + 1]) by expectation-maximisation."""
    v = patterns[:, None] // 3 ** np.arange(labellers) % 3
    p = np.clip(0.5 + (v == 2).sum(1) * 0.08 - (v == 0).sum(1) * 0.25, 0.05, 0.95)  # to begin with: more good votes than bad
    share, table = 0.5, np.zeros((2, labellers, 3))
    for _ in range(rounds):
        share = float((p * counts).sum() / max(counts.sum(), 1))
        for c, weight in ((0, (1 - p) * counts), (1, p * counts)):
            for k in range(3):
                table[c, :, k] = (weight[:, None] * (v == k)).sum(0) + 0.5
        table /= table.sum(2, keepdims=True)
        j = np.arange(labellers)
        good = np.log(max(share, 1e-9)) + np.log(table[1][j, v]).sum(1)
        bad = np.log(max(1 - share, 1e-9)) + np.log(table[0][j, v]).sum(1)
        p = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
    return p, share, table


_SHAPE = np.full(256, 4, np.uint8)
_SHAPE[_LETTER] = 1
_SHAPE[_UPPER] = 2
_SHAPE[_DIGIT] = 3
_SHAPE[_SYMBOL] = 5
_SHAPE[_BANG] = 6


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words, of their shapes, and of whether they repeat the word before; the words' bounds)."""
    w = Words(data, offsets, lower=False)
    shapes = Words(_SHAPE[data] + 64, offsets, hashes=False)
    shapes.start, shapes.end, shapes.bounds = w.start, w.end, w.bounds
    # shape: kinds of the first two and last two bytes, and the length up to 12
    if len(w.start):
        s, e = w.start, w.end - 1
        kinds = [_SHAPE[data[x]].astype(U) for x in (s, np.minimum(s + 1, e), np.maximum(e - 1, s), e)]
        shape = mix(sum(k << U(8 * i) for i, k in enumerate(kinds)) + (np.minimum(e - s, 12).astype(U) << U(40)))
    else:
        shape = np.zeros(0, U)
    half = U(buckets // 2)
    return np.stack([w.h & (half - U(1)), (shape & (half - U(1))) + half, U(buckets - 2) + _again(w).astype(U)], 1).astype(np.int64), w.bounds


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, data, offsets) -> np.ndarray:
        x, bounds = features(data, offsets, len(self.weights))
        c = np.concatenate([[0], np.cumsum(self.weights[x].sum(1), dtype=np.float64)])
        z = (c[bounds[1:]] - c[bounds[:-1]]) / np.maximum(np.diff(bounds), 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str], targets: np.ndarray, seed: int = 3, buckets: int = BUCKETS) -> Scorer:
    data, off = text_bytes(pa.array(texts, pa.large_string()))
    # by slices, as all texts' words at once are many times the text
    parts = [features(data[off[i] : off[j]], off[i : j + 1] - off[i], buckets) for i, j in slices(off)]
    x = np.concatenate([p[0].astype(np.int32) for p in parts]) if parts else np.zeros((0, 3), np.int32)
    b = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))]) if parts else np.zeros(1, np.int64)
    del data, parts
    w, bias, r = np.zeros(buckets), 0.0, np.random.default_rng(seed)
    steps, done = EPOCHS * (len(texts) // BATCH + 1), 0
    for _ in range(EPOCHS):
        for rows in np.array_split(r.permutation(len(texts)), max(1, len(texts) // BATCH)):
            rate = RATE * (1 - done / steps)
            done += 1
            n = b[rows + 1] - b[rows]
            ids = np.concatenate([x[b[k] : b[k + 1]] for k in rows]) if len(rows) else x[:0]
            of = np.repeat(np.arange(len(rows)), n)
            z = np.bincount(of, weights=w[ids].sum(1), minlength=len(rows)) / np.maximum(n, 1) + bias
            g = (targets[rows] - 1 / (1 + np.exp(-np.clip(z, -500, 500)))) / max(len(rows), 1)
            np.add.at(w, ids.ravel(), np.repeat(rate * g[of] / n[of], x.shape[1]))
            bias += 0.05 * rate * g.sum()
    return Scorer(w, bias)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """(id, pattern, posterior, score, keep) for each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))

    def vote(batch):
        u, c = np.unique(patterns(*text_bytes(batch.column("t"))), return_counts=True)
        return pa.record_batch({"p": pa.array(u), "n": pa.array(c)})

    counted = map_arrow(docs, vote, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).toArrow()  # 3 ** labellers rows at most
    p, n = counted.column("p").to_numpy(), counted.column("n").to_numpy()
    order = np.argsort(p)
    p, n = p[order], n[order]
    good, _, _ = posterior(p, n) if len(p) else (np.zeros(0), 0.5, None)
    texts = [t or "" for t in sample_rows(docs, "i", sample, "t").column("t").to_pylist()]
    if texts:
        seen = patterns(*text_bytes(pa.array(texts, pa.large_string())))
        scorer = train(texts, good[np.searchsorted(p, seen)])
        del texts
        trim()
    else:
        scorer = Scorer(np.zeros(BUCKETS), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((p, good, scorer))

    def step(batch):
        p, good, scorer = shared.value
        data, off = text_bytes(batch.column("t"))
        v, s = [], []
        for i, j in slices(off):
            part = data[off[i] : off[j]], off[i : j + 1] - off[i]
            v.append(pattern(votes(*part)))
            s.append(scorer.score(*part))
        v, s = np.concatenate(v), np.concatenate(s)
        return pa.record_batch({id_col: batch.column("i"), "pattern": pa.array(v), "posterior": pa.array(good[np.searchsorted(p, v)]), "score": pa.array(s), "keep": pa.array(s >= keep)})

    return map_arrow(docs, step, f"`{id_col}` long, pattern long, posterior double, score double, keep boolean")
