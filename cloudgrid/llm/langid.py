"""Language identification by averaged hashed subword embeddings.

Subwords are the byte n-grams (``ORDERS``) of a text whose ASCII letters are lower-cased and whose other ASCII bytes are one border sign.  Each is
hashed to one of ``BUCKETS`` rows of an embedding matrix; a text is the mean of its subwords' rows, and a linear softmax over that mean
predicts the language.  Both are trained by mini-batch stochastic gradient descent in numpy on at most ``SAMPLE`` labelled texts, taken by
hash of their ids, and on noise made of them (``noise``), which is one more class: what is none of the learned languages.

A part of both is held back.  It fits a temperature, so that scores are calibrated, and the rejection threshold: in log odds, the
middle between the score that ``KEEP`` of the rightly predicted texts exceed and that which ``CATCH`` of the noise stays below, or the
former, if that is less.  A text's label is its likeliest language,
and its score that language's probability, noise being possible too.

Prediction uses whole texts: as the classifier is linear, each bucket's row is multiplied out once, and a text's score is a mean of those.
Defined cases: null text, or text without a letter, is ``und`` with score 1 and is rejected; with no labelled text at all everything is
``und`` with score 0 and what has a letter is not rejected; ties go to the smaller label; rows of one id, or without one, are answered each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, sample_rows, trim, unused, with_fields
from .wordcode import ranges, slices, text_bytes

BUCKETS, DIM, ORDERS = 1 << 15, 16, (2, 3, 4)
SAMPLE = 2000
EPOCHS, RATE, BATCH = 8, 4.0, 16
#: of held-back texts: rightly predicted ones that must not be rejected, and noise that must be
KEEP, CATCH = 0.9995, 0.95
#: texts of noise for each labelled text, and the longest of them in characters
NOISE, NOISE_CHARS = 0.5, 2000
UNKNOWN = "und"
#: Where the letters of some scripts lie in Unicode.
SCRIPTS = ((0x430, 0x44F), (0x3B1, 0x3C9), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3093), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x561, 0x586), (0x10D0, 0x10F0))

_FOLD = np.full(256, 1, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def subwords(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, orders=ORDERS):
    """For each order: (buckets of the n-grams at each place, which places count).  Borders run together, and no n-gram crosses texts."""
    b = _FOLD[data].astype(np.uint32)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 1) | (b[:-1] != 1)
    c = np.concatenate([[0], np.cumsum(keep)])
    b, off = b[keep], c[offsets]
    code = b
    for k in range(2, max(orders) + 1):
        code = (code[:-1] << np.uint32(8)) | b[k - 1 :] if len(code) else code
        if k in orders:
            with np.errstate(over="ignore"):
                x = (code ^ np.uint32(k * 0x01000193)) * np.uint32(0x9E3779B1)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
            yield k, ((x ^ (x >> np.uint32(13))) & np.uint32(buckets - 1)).astype(np.int32), off, b


def _features(data, offsets, buckets, orders):
    """(bucket ids of all texts one after another, bounds); texts go through in slices, so only the ids themselves are held."""
    out, sizes = [np.zeros(0, np.int32)], np.zeros(len(offsets) - 1, np.int64)
    for i, j in slices(offsets, 1 << 17):
        parts = []
        for k, x, off, _ in subwords(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets, orders):
            n = np.maximum(np.diff(off) - k + 1, 0)
            text = np.repeat(np.arange(j - i, dtype=np.int32), n)
            parts.append((text, x[ranges(off[:-1], n)]))
            sizes[i:j] += n
        t, x = (np.concatenate(v) for v in zip(*parts, strict=True))
        out.append(x[np.argsort(t, kind="stable")])
    return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


def noise(text: str, kind: int, r: np.random.Generator) -> str:
    """Something with the text's lengths of words that is no language: letters drawn evenly, shuffled within and across words, another script's letters, or
    names, numbers and signs as in data and programs."""
    words = text[:NOISE_CHARS].split() or ["x"]
    if kind % 4 == 0:
        return " ".join("".join(chr(97 + c) for c in r.integers(0, 26, len(w))) for w in words)
    if kind % 4 == 1:
        letters = list("".join(words))
        r.shuffle(letters)
        letters, at = "".join(letters), np.cumsum([0] + [len(w) for w in words])
        return " ".join(letters[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
    if kind % 4 == 2:
        lo, hi = SCRIPTS[int(r.integers(len(SCRIPTS)))]
        some = r.integers(lo, hi + 1, 40)
        return " ".join("".join(chr(c) for c in some[r.integers(0, 40, len(w))]) for w in words)
    signs = '{}[]()<>:;,."=+-*/_#&|'
    name = lambda n: "".join("abcdefghijklmnopqrstuvwxyz0123456789_"[c] for c in r.integers(0, 37, n))
    return " ".join(f"{name(len(w))}{signs[int(r.integers(len(signs)))]}{int(r.integers(10**4))}{signs[int(r.integers(len(signs)))]}" for w in words)


class LanguageModel:
    """Labels, a score row for each bucket and class (the labels', then that of noise), the bias, the temperature and the rejection threshold."""

    def __init__(self, labels, rows, bias, temperature, threshold):
        self.labels, self.rows, self.bias, self.temperature, self.threshold = labels, rows, bias, temperature, threshold

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        out, count = np.zeros((n, len(self.rows))), np.zeros(n)
        for k, x, off, _ in subwords(data, offsets, len(self.rows[0])):
            stop = np.maximum(off[1:] - k + 1, off[:-1])
            for c in range(len(self.rows)):
                s = np.zeros(len(x) + 1)
                np.cumsum(self.rows[c][x], out=s[1:], dtype=np.float64)
                lo, hi = np.minimum(off[:-1], len(x)), np.minimum(stop, len(x))
                out[:, c] += s[hi] - s[lo]
            count += stop - off[:-1]
        return out / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data, offsets) -> tuple[np.ndarray, np.ndarray]:
        """(index of the label, calibrated probability)."""
        p = probabilities(self.logits(data, offsets), self.temperature)[:, : len(self.labels)]
        return p.argmax(1), p.max(1)


def probabilities(z: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    z = z / temperature
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def threshold_of(right: np.ndarray, wrong: np.ndarray, keep: float = KEEP, catch: float = CATCH) -> float:
    """The score below which a text is rejected, from scores of texts to keep and of noise."""
    if not len(right):
        return 0.0
    odds = lambda x: np.log(np.clip(x, 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(x, 1e-12, 1 - 1e-12))
    hi = float(np.quantile(odds(right), 1 - keep, method="lower"))
    lo = float(np.quantile(odds(wrong), catch, method="higher")) if len(wrong) else hi
    return float(1 / (1 + np.exp(-(hi + min(lo, hi)) / 2)))


def train(texts: list[str], langs: list[str], seed: int = 1, buckets: int = BUCKETS, dim: int = DIM) -> LanguageModel | None:
    if not texts:
        return None
    labels = sorted(set(langs))
    r = np.random.default_rng(seed)
    every = max(1, round(1 / NOISE))
    made = [noise(t, k, r) for k, t in enumerate(texts[::every])]
    y = np.concatenate([np.searchsorted(labels, langs), np.full(len(made), len(labels))])
    data, off = text_bytes(pa.array(texts + made, pa.large_string()))
    held = np.concatenate([np.arange(len(texts)) % 5 == 4, np.arange(len(made)) % 5 == 4]) if len(texts) >= 50 else np.zeros(len(y), bool)
    e = r.normal(0, 0.05, (buckets, dim)).astype(np.float32)
    w = r.normal(0, 0.05, (dim, len(labels) + 1)).astype(np.float32)
    bias = np.zeros(len(labels) + 1, np.float32)
    # each text's buckets once, with their shares
    bags = []
    for i, j in slices(off, 1 << 17):
        x, b = _features(data[off[i] : off[j]], off[i : j + 1] - off[i], buckets, ORDERS)
        for k in range(j - i):
            u, c = np.unique(x[b[k] : b[k + 1]], return_counts=True)
            bags.append((u, (c / max(b[k + 1] - b[k], 1)).astype(np.float32)))
    some = np.flatnonzero(~held)
    steps, done = EPOCHS * (len(some) // BATCH + 1), 0
    for _ in range(EPOCHS):
        order = r.permutation(some)
        for i in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            rows = order[i : i + BATCH]
            mean = np.stack([share @ e[u] for u, share in (bags[k] for k in rows)])
            p = probabilities(mean @ w + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = p / len(rows)
            back = g @ w.T
            w -= rate * (mean.T @ g)
            bias -= 0.1 * rate * g.sum(0)
            for k, step in zip(rows, back, strict=True):
                u, share = bags[k]
                e[u] -= (20 * rate) * share[:, None] * step
    model = LanguageModel(labels, np.ascontiguousarray((e @ w).T), bias.astype(float), 1.0, 0.0)
    if held.any():
        back = np.flatnonzero(held)
        z = np.concatenate([model.logits(data[off[k] : off[k + 1]], np.array([0, off[k + 1] - off[k]])) for k in back])
        loss = lambda t: -np.log(np.maximum(probabilities(z, t)[np.arange(len(back)), y[back]], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
        p = probabilities(z, model.temperature)[:, : len(labels)]
        model.threshold = threshold_of(p.max(1)[p.argmax(1) == y[back]], p.max(1)[y[back] == len(labels)])
    return model


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    """Trains on at most ``sample`` rows with text and label, the first by hash of their ids."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    got = sample_rows(rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")), "i", sample, "t").to_pydict()
    model = train(got["t"], got["l"])
    del got
    trim()
    return model


def outputs(docs: DataFrame) -> list[str]:
    """The names that predict() gives its columns beside those of docs: language, score, rejected."""
    return unused(docs.columns, "_lang", "_score", "_rejected", "_letter")[:3]


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with ``_lang``, ``_score`` and ``_rejected`` (where docs has such a name, see ``outputs``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang_, score_, rejected_ = outputs(docs)
    letter_ = unused(docs.columns, "_lang", "_score", "_rejected", "_letter")[3]
    schema = with_fields(docs, (lang_, "string"), (score_, "double"), (rejected_, "boolean"))
    letter = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))

    def step(batch):
        m, has = shared.value, batch.column(letter_).to_numpy(zero_copy_only=False)
        lang, score = np.full(len(has), UNKNOWN, object), np.where(has, 0.0, 1.0)
        reject = ~has
        if m is not None:
            data, off = text_bytes(batch.column(text_col))
            for i, j in slices(off):
                k, p = m.predict(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ok = has[i:j]
                lang[i:j] = np.where(ok, np.array(m.labels, object)[k], lang[i:j])
                score[i:j] = np.where(ok, p, score[i:j])
                reject[i:j] |= p < m.threshold
        cols = {n: batch.column(n) for n in batch.schema.names if n != letter_}
        return pa.RecordBatch.from_pydict(cols | {lang_: pa.array(lang.tolist(), pa.string()), score_: pa.array(score), rejected_: pa.array(reject)})

    return map_arrow(docs.withColumn(letter_, letter), step, schema, text_col)
