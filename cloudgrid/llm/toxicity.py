"""Toxicity severity by cumulative-link ordinal regression.

A text's features are its distinct words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``), sparse and each present or absent.  With grades 0..K-1
the model is P(grade > k) = sigmoid(w . x - b_k): one weight vector for all thresholds b_0 <= b_1 <= ...  It is fitted by maximum likelihood
with an L2 penalty, in numpy, on at most ``SAMPLE`` labelled texts taken by hash of their ids; words take part that occur in MIN_TEXTS of
them and whose share in graded texts differs from that in clean ones by MIN_Z standard errors, at most FEATURES of them.  Expected
severity is the sum of P(grade > k); a text is toxic if P(grade > 0) >= CUT.  All texts are scored whole.

The grades are those of the labels: labels of 0 and 1 give one threshold, grades 0..K-1 give K-1 of them.

Defined cases: null or empty text has no features and gets the prior; no labelled text at all gives severity 0 to all; a text labelled more
than once takes the highest grade; labels of texts that don't exist are ignored; rows of one id, or without one, are answered each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, map_arrow
from .wordcode import ALNUM, U, Words, i64, slices, text_bytes, u64

SAMPLE, MIN_Z, FEATURES = 8000, 3.5, 4096
PENALTY, STEPS, RATE, CUT = 0.02, 600, 0.3, 0.3
MIN_TEXTS = 4
#: distinct words of the sample's texts that reach the driver
WORDS = 4_000_000


class OrdinalModel:
    """Words' hashes (sorted), their weights, and the thresholds."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.words, self.weights, self.thresholds = words, weights, thresholds

    def margins(self, w: Words) -> np.ndarray:
        """w . x of each text."""
        n = len(w.bounds) - 1
        if not len(self.words) or not len(w.h):
            return np.zeros(n)
        k = np.minimum(np.searchsorted(self.words, w.h), len(self.words) - 1)
        at = np.flatnonzero(self.words[k] == w.h)
        pair = np.unique(w.text[at] * len(self.words) + k[at])
        return np.bincount(pair // len(self.words), weights=self.weights[pair % len(self.words)], minlength=n)

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and k."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thresholds, -500, 500)))


def fit_ordinal(text: np.ndarray, word: np.ndarray, grades: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) for a sparse 0/1 matrix given by the (text, word) places of its ones."""
    k = int(grades.max(initial=0))
    if not k:
        return np.zeros(words), np.zeros(0)
    w = np.zeros(words)
    share = np.array([np.clip((grades > i).mean(), 1e-4, 1 - 1e-4) for i in range(k)])
    first = np.log((1 - share) / share)
    t = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])  # first threshold, then logs of the gaps
    m, v, n = np.zeros(words + k), np.zeros(words + k), len(grades)
    for step in range(1, STEPS + 1):
        b = t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])
        z = np.bincount(text, weights=w[word], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - b, -500, 500)))  # P(grade > i)
        up = np.concatenate([np.ones((n, 1)), p], 1)
        low = np.concatenate([p, np.zeros((n, 1))], 1)
        r = np.arange(n)
        mass = np.maximum(up[r, grades] - low[r, grades], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], 1)
        d_up, d_low = slope[r, grades] / mass, slope[r, grades + 1] / mass
        gz = (d_up - d_low) / n
        gb = np.zeros(k)
        np.add.at(gb, grades[grades > 0] - 1, -d_up[grades > 0] / n)
        np.add.at(gb, grades[grades < k], d_low[grades < k] / n)
        gt = np.concatenate([[gb.sum()], np.cumsum(gb[::-1])[::-1][1:] * np.exp(t[1:])])
        g = np.concatenate([np.bincount(word, weights=gz[text], minlength=words) - PENALTY / n * w, gt])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w += move[:words]
        t += move[words:]
    return w, t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])


def fit(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE) -> OrdinalModel:
    """Trains on at most ``sample`` graded texts, the first by hash of their ids: one row of each id, the least by hash of its text.

    Of each text its distinct words reach the driver as hashes, of the first texts that hold WORDS of them together.
    """
    none = OrdinalModel(np.zeros(0, U), np.zeros(0), np.zeros(0))
    picked = grades.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(grade_col).cast("int").alias("g"))
    picked = picked.orderBy(F.xxhash64("i"), "i").limit(sample).toArrow()
    if not picked.num_rows:
        return none
    ids = np.sort(picked.column("i").to_numpy())
    wanted = docs.sparkSession.sparkContext.broadcast(ids)

    def step(batch):
        i = batch.column("i").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(wanted.value[np.minimum(np.searchsorted(wanted.value, i), len(wanted.value) - 1)] == i)
        if not len(at):
            return None
        data, off = text_bytes(batch.column("t").take(pa.array(at)))
        w = Words(data, off, ALNUM, lower=True)
        return pa.record_batch({"i": pa.array(i[at]), "h": pa.array([np.unique(w.h[a:b]).view(np.int64) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)], pa.list_(pa.int64()))})

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null")
    found = cut(map_arrow(rows, step, "i long, h array<long>", "t").groupBy("i").agg(F.min("h").alias("h")))
    sizes = found.select("i", F.size("h").alias("n")).toArrow().sort_by("i")
    if not sizes.num_rows:
        return none
    held = sizes.column("i").to_numpy()[: max(1, int((np.cumsum(sizes.column("n").to_numpy()) <= WORDS).sum()))]
    got = found.where(F.col("i").isin(held.tolist())).toArrow().sort_by("i").combine_chunks()
    drop(found)
    g = dict(zip(picked.column("i").to_pylist(), picked.column("g").to_pylist(), strict=True))
    y = np.array([g[i] for i in got.column("i").to_pylist()])
    lists = got.column("h").combine_chunks()
    h = u64(lists.flatten())
    text = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    u, inv = np.unique(h, return_inverse=True)
    graded = (y > 0)[text]
    a, b, na, nb = np.bincount(inv, weights=graded), np.bincount(inv, weights=~graded), max((y > 0).sum(), 1), max((y == 0).sum(), 1)
    share = (a + b) / (na + nb)
    z = np.abs(a / na - b / nb) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / na + 1 / nb))
    use = np.flatnonzero((a + b >= MIN_TEXTS) & (z >= MIN_Z))
    use = np.sort(use[np.argsort(-z[use], kind="stable")][:FEATURES])
    place = np.full(len(u), -1)
    place[use] = np.arange(len(use))
    ok = place[inv] >= 0
    weights, thresholds = fit_ordinal(text[ok], place[inv][ok], y, len(use))
    return OrdinalModel(u[use], weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, severity, grade, toxic) for each row; grade: the likeliest."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch):
        data, off = text_bytes(batch.column("t"))
        margin = np.concatenate([shared.value.margins(Words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM, lower=True)) for i, j in slices(off)])
        p = shared.value.above(margin)
        n = len(p)
        each = -np.diff(np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1), axis=1)
        return pa.record_batch({id_col: batch.column("i"), "severity": pa.array(p.sum(1)), "grade": pa.array(each.argmax(1).astype(np.int32)), "toxic": pa.array(p[:, 0] >= cut if p.shape[1] else np.zeros(n, bool))})

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return map_arrow(rows, step, f"`{id_col}` long, severity double, grade int, toxic boolean")
