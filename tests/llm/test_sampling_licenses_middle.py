"""Resampling, license scans and fill-in-the-middle against brute force and their SQL."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloudgrid.llm import fim, licenses, registry, resample

SCHEMA = "doc_id long, text string, _text string, _row long, rule int, first long, _n long, _output string"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return ALNUM.findall(lower(t))


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, "y") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocab = [f"W{i}" for i in range(60)] + ["É", "ñu", "a", "K", "the", "x" * 300]
    out = [" ".join(r.choices(vocab, k=r.choice([0, 1, 5, 19, 20, 21, 60]))) for _ in range(80)]
    out[0], out[1], out[2] = None, "", " \t\n--\n"
    out[3] = ", ".join(r.choices(vocab, k=30000))  # some chunks long
    out[4] = out[5] = out[6]
    out[7] = "-" * 70000
    out[8] = "y" * 70000 + " z"
    return out


# --- resampling -----------------------------------------------------------------------------------------------------------------------


@given(st.lists(st.binary(max_size=140), max_size=12))
@settings(max_examples=100, deadline=None)
def test_crc32_of_spans(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    got = resample.crc32_spans(data, np.cumsum(size) - size, size)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


def naive(docs, target, width, buckets, percent, least, seed):
    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[p : p + n]).encode()) % buckets for n in range(1, width + 1) for p in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    rows = []
    for i, x in docs:
        f = features(x)
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    place = {id(r): k for k, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted(((*r, place.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("width", [1, 3])
def test_resampling_is_the_naive_one(spark, texts, width, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 700)
    monkeypatch.setattr(resample, "LONG", 500)
    target = ["W1 W2 the the É", None, "", "W3 W4, W5 nowhere else"]
    ids = [None if i in (10, 11) else 12 if i == 13 else i for i in range(len(texts))]
    got = resample.resample(table(spark, texts, ids), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"), width=width, buckets=50, percent=40, least=20, seed=5)
    assert got.columns == ["doc_id", "_n_words", "_n_features", "_weight", "_score", "_rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == naive(list(zip(ids, texts, strict=True)), target, width, 50, 40, 20, 5)


def test_chunks_own_every_start_once(spark, monkeypatch):
    text = "é".join(f" w{i}," for i in range(1000))
    rows = table(spark, [text]).withColumnRenamed("doc_id", "_id").select("_id", "text")
    got = sorted(resample.chunks(rows, "text", 64, 3).collect(), key=lambda r: r._chunk)
    w = words(text)
    assert sum(r._own for r in got) == len(w)
    assert [words(r._text) for r in got] == [w[k : k + 66] for k in range(0, len(w), 64)]


def test_resampling_of_nothing(spark, texts):
    empty = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample.resample(empty, items).collect() == []
    got = resample.resample(table(spark, texts), items.limit(0)).select("doc_id", "_n_words", "_rank").collect()
    assert len(got) == len(texts) and sum(r._rank is not None for r in got) == sum(len(words(t)) >= 20 for t in texts) // 10


# --- licenses -------------------------------------------------------------------------------------------------------------------------


def naive_scan(text):
    w = words(text)
    norm = " " + " ".join(w) + " "
    found = []
    for i, r in enumerate(licenses.RULES):
        if f" {r.keyword} " in norm:
            for m in re.finditer(r.body + "(?= )", norm):
                first = norm[: m.start()].count(" ")
                found.append((first, first + m[0].count(" ") - 1, r.priority, i))
    kept = [a for a in found if not any(b != a and b[0] <= a[0] and b[1] >= a[1] and b[2] <= a[2] and (b[:2] != a[:2] or b[2:] < a[2:]) for b in found)]
    base = sorted((label, k, k + p.count(" ")) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + p.count(" ") + 1] == p.split())
    return len(w), base, sorted((a, b, p, licenses.RULES[i].label) for a, b, p, i in kept), max([licenses.SCORES[k[2] - 1] for k in kept], default=0.0)


def example(pattern, r):
    """A text that a rule's pattern matches."""
    while (m := re.search(r"\(\?:([^()]*)\)(\?|\{\d+,\d+\})?", pattern)) is not None:
        some = "" if m[2] == "?" and r.random() < 0.5 else r.choice(m[1].split("|"))
        pattern = pattern[: m.start()] + some + pattern[m.end() :]
    pattern = re.sub(r"\[(\w)\w*\](?!\{)", r"\1", pattern).replace("[0-9]{4}", "1999")
    pattern = re.sub(r"f\\S\{0,4\}", "fine", pattern).replace("\\S+", "any")
    return re.sub(r"(.)\?", lambda m: m[1] if r.random() < 0.5 else "", pattern)


@pytest.fixture(scope="module")
def notices(texts):
    r = random.Random(9)
    lines = [example(x.pattern, r) for x in licenses.RULES]
    out = [f"Some text. {x.title()}! More text." for x in lines]
    out += [" ".join(r.choices([*lines, "license", "gnu", "the", "é", "mit", "General Public License"], k=r.choice([3, 8, 20]))) for _ in range(60)]
    out += ["mit license " * 3000, "MIT\nLicense", "“MIT License”", "émit license", "smit license mit licenses", "mİt license", "apacKe license", None, "", "mit license"] + texts
    return out


def test_rules_are_many_and_each_finds_its_own(spark):
    r = random.Random(1)
    assert len(licenses.RULES) > 300 and len(licenses._WRITTEN.strip().splitlines()) > 150
    for x in licenses.RULES:
        for _ in range(5):
            t = f" {example(x.pattern, r)} "
            assert re.search(x.body + "(?= )", t), (x, t)
            assert f" {x.keyword} " in t, (x, t)


def test_licenses_are_the_naive_ones(spark, notices):
    got = {r.doc_id: r for r in licenses.scan(table(spark, notices)).collect()}
    assert len(got) == len(notices)
    for i, t in enumerate(notices):
        n, base, kept, score = naive_scan(t)
        r = got[i]
        assert r._n_words == n and sorted(tuple(b) for b in r._base) == base, t
        assert [(d["first"], d["last"], d["priority"], d["label"]) for d in r._detections] == kept, t
        assert r._score == score, t


def test_a_longer_notice_suppresses_the_name_within_it(spark):
    t = "Licensed under the Apache License, Version 2.0. See the GNU Lesser General Public License, version 2.1."
    r = licenses.scan(table(spark, [t])).first()
    assert [(d["label"], d["priority"]) for d in r._detections] == [("apache-2.0", 1), ("lgpl-2.1", 2)]
    assert [b["label"] for b in r._base] == ["apache", "gpl"] and r._score == 1.0


def test_repeated_rows_and_no_rows_of_licenses(spark):
    got = licenses.scan(table(spark, ["MIT license"] * 4 + [None], [None, 7, 7, None, None])).collect()
    assert sorted((str(r.doc_id), len(r._base), r._score) for r in got) == [("7", 1, 0.6), ("7", 1, 0.6), ("None", 0, 0.0), ("None", 1, 0.6), ("None", 1, 0.6)]
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_licenses_stay_in_the_jvm(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (licenses.detections(docs), licenses.scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "InArrow", "InPandas", "ExternalRDD"))
    assert "Exchange" not in licenses.detections(docs)._jdf.queryExecution().executedPlan().toString()


# --- fill in the middle ---------------------------------------------------------------------------------------------------------------


def naive_middle(i, text, unit, rate, spm, seed):
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    ends = [0] + [m.end() for m in re.finditer(unit, text)]
    n = len(ends) - 1
    a, b = sorted((ends[h[0] % (n + 1)], ends[h[1] % (n + 1)]))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("unit", "rate"), [(fim.LINES, 100), (fim.WORDS, 60), (r"[a-z]+", 100)])
def test_middles_are_the_naive_ones_and_come_back(spark, texts, unit, rate):
    r = random.Random(4)
    more = ["".join(r.choices(["a", "b\n", "<", ">", "P", "<P", "S>", "\n\n", "é😀", "\r\n"], k=r.randrange(40))) for _ in range(200)] + ["x<M>y", "no end", "\n", "<", "<P"]
    every = texts + more
    ids = [None if i == 9 else 20 if i == 21 else i for i in range(len(every))]
    out = fim.transform(table(spark, every, ids), unit=unit, rate=rate, spm=30, seed=11)
    n, form, prefix, middle, made = fim.outputs(table(spark, []))
    assert out.columns[:8] == [c.split()[0] for c in SCHEMA.split(", ")] and (n, made) == ("__n", "__output")
    got = out.withColumn("back", fim.restored(F.col(made), F.col(form))).collect()
    rows = sorted(((str(x.doc_id), x.text or "", x[n], x[form], x[prefix], x[middle], x[made]) for x in got), key=str)
    assert rows == sorted(((str(i), t or "", *naive_middle(i, t, unit, rate, 30, 11)) for i, t in zip(ids, every, strict=True)), key=str)
    assert all(x.back == (x.text or "") for x in got)
    assert {x[form] for x in got} == {"plain", "psm", "spm"}


def test_the_matcher_keeps_no_units():
    import tracemalloc

    text = "a\n" * 500_000
    unit = re.compile(fim.LINES)
    tracemalloc.start()
    n, a, b = fim.cut_points(text, unit, 400_000, 100_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, a, b) == (500_000, 200_000, 800_000) and peak < 20_000


def test_marks_that_could_be_mistaken_are_refused(spark):
    for marks in (("<P>", "<P>x", "<M>"), ("aba", "c", "d"), ("", "a", "b")):
        with pytest.raises(ValueError, match="marks"):
            fim.transform(table(spark, ["x"]), marks=marks)


def test_no_rows_of_middles(spark):
    assert fim.transform(spark.createDataFrame([], SCHEMA)).collect() == []


# --- the registered queries -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_resampling", "op12_licenses", "op13_fill_in_middle"])
def test_query_is_its_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in os.listdir(d):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{d}/{t}'")
    got, want = registry.queries()[name](spark, d).toPandas(), con.execute(registry.oracle_sql()[name]).fetchdf()
    by = lambda df: df[sorted(df.columns)].sort_values("doc_id").reset_index(drop=True)
    assert len(got)
    pd.testing.assert_frame_equal(by(got), by(want), check_dtype=False)
