"""The fitted models' scores, and how they are fitted, against plain loops over one text or one row at a time."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudgrid.llm import langid, quality, toxicity
from cloudgrid.llm.wordcode import ALNUM, Words, text_bytes

SCHEMA = "doc_id long, text string, i long, t string, h string, weights double, pattern long, severity double"


def texts(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(80)] + ["É", "hate", "awful", "THE", "!!!", "1234", "ñandú"]
    out = [" ".join(r.choices(vocab, k=r.choice([0, 1, 3, 20, 60]))) + r.choice(["", ".", "\n"]) for _ in range(n)]
    out[1], out[2], out[3], out[4], out[5] = None, "", " \n", out[6], " ".join(r.choices(vocab, k=20000))
    return out


def docs(spark, every):
    """Repeated ids, rows without one, and columns of names that the operators use."""
    ids = [None if k in (7, 8) else 9 if k == 10 else k for k in range(len(every))]
    return spark.createDataFrame([(i, t, 1, "t", "h", 0.5, 3, 0.1) for i, t in zip(ids, every, strict=True)], SCHEMA).repartition(4), ids


def hashed(word):
    data, off = text_bytes(pa.array([word]))
    return Words(data, off, ALNUM, lower=True).h[0]


def by_id(rows, *cols):
    return sorted(((str(r.doc_id), *(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols)) for r in rows), key=str)


def test_severity_is_the_sum_over_thresholds(spark):
    every = texts(1)
    df, ids = docs(spark, every)
    weights = {"hate": 1.5, "awful": 0.7, "w3": -0.4, "É": 0.2}
    h = {hashed(w): v for w, v in weights.items()}
    order = np.array(sorted(h), np.uint64)
    model = toxicity.OrdinalModel(order, np.array([h[k] for k in order.tolist()]), np.array([0.1, 0.9, 2.0]))
    want = []
    for i, t in zip(ids, every, strict=True):
        words = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")}
        margin = sum(v for w, v in weights.items() if w in words)
        p = [1 / (1 + math.exp(-(margin - b))) for b in (0.1, 0.9, 2.0)]
        each = [a - b for a, b in zip([1, *p], [*p, 0], strict=True)]
        want.append((str(i), round(sum(p), 9), each.index(max(each)), p[0] >= toxicity.CUT))
    assert by_id(toxicity.score(df, model).collect(), "severity", "grade", "toxic") == sorted(want, key=str)


def test_ordinal_fit_is_where_the_likelihood_is_flat():
    r = np.random.default_rng(2)
    n, words = 400, 6
    x = r.random((n, words)) < 0.4
    z = x @ np.array([2.0, -1.5, 1.0, 0, 0, 0.5]) + r.logistic(size=n)
    grades = (z[:, None] > np.array([0.0, 1.0, 2.0])).sum(1)
    text, word = np.nonzero(x)
    w, b = toxicity.fit_ordinal(text, word, grades, words)
    assert len(b) == 3 and (np.diff(b) > 0).all()

    def loss(v):
        p = 1 / (1 + np.exp(-((x @ v[:words])[:, None] - v[words:])))
        up, low = np.column_stack([np.ones(n), p]), np.column_stack([p, np.zeros(n)])
        return -np.log((up - low)[np.arange(n), grades]).mean() + toxicity.PENALTY / n / 2 * (v[:words] ** 2).sum()

    at, step = np.concatenate([w, b]), 1e-5
    slope = [(loss(at + step * e) - loss(at - step * e)) / (2 * step) for e in np.eye(len(at))]
    assert np.abs(slope).max() < 5e-3 and loss(at) < loss(np.concatenate([np.zeros(words), b])) - 0.05


def test_expectation_maximisation_over_patterns_is_that_over_rows():
    r = np.random.default_rng(3)
    good = r.random(500) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.6])
    votes = np.where(r.random((500, 4)) < 0.2, 0, np.where((r.random((500, 4)) < right) == good[:, None], 1, -1)).astype(np.int8)
    p, n = np.unique(quality.pattern(votes), return_counts=True)
    got, share, table = quality.posterior(p, n, 4, 25)
    mine = [min(max(0.5 + sum(v == 1 for v in row) * 0.08 - sum(v == -1 for v in row) * 0.25, 0.05), 0.95) for row in votes]
    for _ in range(25):
        s = sum(mine) / len(mine)
        t = [[[0.5] * 3 for _ in range(4)] for _ in range(2)]
        for q, row in zip(mine, votes, strict=True):
            for k, v in enumerate(row):
                t[1][k][v + 1] += q
                t[0][k][v + 1] += 1 - q
        t = [[[c / sum(x) for c in x] for x in side] for side in t]
        likely = lambda side, row, t=t: math.prod(t[side][k][v + 1] for k, v in enumerate(row))
        mine = [s * likely(1, row) / (s * likely(1, row) + (1 - s) * likely(0, row)) for row in votes]
    assert got[np.searchsorted(p, quality.pattern(votes))] == pytest.approx(mine, abs=1e-6)
    assert share == pytest.approx(s, abs=1e-6) and table == pytest.approx(np.array(t), abs=1e-6)
    assert ((np.array(mine) > 0.5) == good).mean() > 0.8


def test_quality_scores_are_means_of_weights_over_words(spark):
    every = texts(4)
    df, ids = docs(spark, every)
    got = quality.classify(df, sample=40).collect()
    assert len(got) == len(every) and sorted(str(r.doc_id) for r in got) == sorted(map(str, ids))
    scorer = quality.train([t or "" for t in every], np.linspace(0, 1, len(every)))
    data, off = text_bytes(pa.array([t or "" for t in every]))
    batch = scorer.score(data, off)
    for t, s in zip(every, batch, strict=True):
        d, o = text_bytes(pa.array([t or ""]))
        x, _ = quality.features(d, o, len(scorer.weights))
        z = scorer.bias + sum(scorer.weights[k] for row in x for k in row) / max(len(x), 1)
        assert s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert len(x) == len((t or "").split())


def test_language_scores_are_softmaxes_of_mean_rows(spark):
    r = np.random.default_rng(5)
    model = langid.LanguageModel(["aa", "bb"], np.ascontiguousarray(r.normal(0, 1, (3, langid.BUCKETS))), r.normal(0, 0.1, 3), 0.7, 0.4)
    every = texts(6) + ["tie tie", "...", "漢字"]
    df, ids = docs(spark, every)
    out = langid.predict(df, model)
    lang, score, rejected = langid.outputs(df)
    want = []
    for i, t in zip(ids, every, strict=True):
        if not any(c.isalpha() for c in t or ""):
            want.append((str(i), "und", None, True))
            continue
        d, o = text_bytes(pa.array([t]))
        x, _ = langid._features(d, o, langid.BUCKETS, langid.ORDERS)
        z = [(sum(model.rows[c][k] for k in x) / max(len(x), 1) + model.bias[c]) / 0.7 for c in range(3)]
        p = [math.exp(v - max(z)) / sum(math.exp(q - max(z)) for q in z) for v in z]
        best = 0 if p[0] >= p[1] else 1
        want.append((str(i), model.labels[best], round(p[best], 6), p[best] < 0.4))
    got = [(str(r.doc_id), r[lang], None if r[lang] == "und" else round(r[score], 6), r[rejected]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_two_languages_alike_take_the_first(spark):
    model = langid.LanguageModel(["aa", "bb"], np.zeros((3, langid.BUCKETS)), np.zeros(3), 1.0, 0.0)
    row = langid.predict(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), model).first()
    assert row[2] == "aa" and row[3] == pytest.approx(1 / 3)


@pytest.mark.parametrize("fit", ["toxicity", "quality"])
def test_rows_without_an_id_are_scored(spark, fit):
    df = spark.createDataFrame([(None, "hate hate"), (None, None), (1, "fine words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, grade int")
    got = toxicity.score(df, toxicity.fit(df, labels)) if fit == "toxicity" else quality.classify(df)
    assert sorted(str(r.doc_id) for r in got.select(F.col("doc_id")).collect()) == ["1", "None", "None"]


def test_training_quality_holds_little_beside_the_text():
    """The driver's arrays over all words of its sample are a few times the text, not tens of times."""
    import tracemalloc

    r = np.random.default_rng(3)
    texts = [" ".join(map(str, r.integers(0, 1 << 40, 60))) for _ in range(8000)]
    d, o = text_bytes(pa.array(texts, pa.large_string()))
    tracemalloc.start()
    try:
        p = quality.patterns(d, o)
        scorer = quality.train(texts, np.arange(8000) % 2 * 1.0)
        assert tracemalloc.get_traced_memory()[1] < 20 * len(d)
    finally:
        tracemalloc.stop()
    assert (p == quality.pattern(quality.votes(d, o))).all()
    x, b = quality.features(d, o)
    assert np.allclose(scorer.score(d, o), 1 / (1 + np.exp(-(np.add.reduceat(scorer.weights[x].sum(1), b[:-1]) / np.diff(b) + scorer.bias))))
