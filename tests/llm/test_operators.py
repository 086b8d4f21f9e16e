"""Operators against brute force on small tables that hold nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloudgrid.llm import decontaminate, html_text, jaccard, langid, lm_bloom, mih, packing, quality, registry, substring, toxicity
from cloudgrid.llm.shared import bloom, components
from cloudgrid.llm.wordcode import ALNUM, NON_SPACE, Table, U, Words, slices, text_bytes

SCHEMA = "doc_id long, text string, i string, t string, h long, shard int, s int, b int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus(seed=1, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ñu", "a", "B", "the"]
    texts = [" ".join(r.choices(vocab, k=r.choice([0, 1, 2, 5, 12, 13, 14, 40, 80]))) for _ in range(n)]
    passage = " ".join(r.choices(vocab, k=30))
    for k in range(0, n, 7):
        texts[k] = texts[k] + " " + passage + "\n" + " ".join(r.choices(vocab, k=5))
    for k in range(1, n, 9):
        w = texts[(k * 5) % n].split()
        if len(w) > 30:
            w[r.randrange(len(w))] = "edit"
        texts[k] = " ".join(w)
    texts[3], texts[4], texts[5] = None, "", " \t\r\n "
    texts[6] = " ".join(r.choices(vocab, k=30000))
    texts[8] = "the the the the the the the the the the the the the the the the"
    texts[10] = texts[20] = texts[30]
    return list(zip(range(10, 10 + n), texts, strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, 4) for i, t in corpus()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@given(st.lists(st.text(max_size=30), max_size=8), st.booleans())
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_pattern(texts, low):
    import pyarrow as pa

    for member, pattern in ((NON_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, off = text_bytes(pa.array(texts, pa.string()))
        w = Words(data, off, member, lower=low)
        got = [[w.word(k).decode() for k in range(a, b)] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
        low_all = [lower(t) if member is ALNUM else t for t in texts]
        want = [re.findall(pattern, t) for t in low_all]
        assert [[lower(x) if member is ALNUM else x for x in g] for g in got] == want
        assert len(set(w.h.tolist())) == len({lower(x) if low else x for g in got for x in g})


def test_slices_keep_rows_whole():
    off = np.array([0, 5, 5, 100, 101])
    assert list(slices(off, 10)) == [(0, 2), (2, 3), (3, 4)]


def test_table_of_hashes():
    r = np.random.default_rng(0)
    k = np.unique(r.integers(0, 2**64, 20000, dtype=U))
    t = Table(4)
    for part in np.array_split(k, 7):
        t.put(part, np.arange(len(part)))
    assert (t.get(k) >= 0).all() and (t.get(~k) < 0).all()


def test_bloom_has_all_and_few_others(spark):
    df = spark.range(20000).selectExpr("xxhash64(id) h")
    b = bloom(df, "h", 20000)
    inside = np.array([r.h for r in df.collect()], np.int64).view(U)
    outside = np.array([r.h for r in spark.range(10**6, 10**6 + 20000).selectExpr("xxhash64(id) h").collect()], np.int64).view(U)
    assert b.has(inside).all() and b.has(outside).mean() < 0.03


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[102] == 100


def test_substring_dedup(docs, empty):
    own, words = {}, {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in corpus()}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            own.setdefault(tuple(words[i][k : k + 13]), i)
    got = {r.doc_id: r for r in substring.remove_repeats(docs, keep_text=True).collect()}
    assert set(got) == set(words) and sum(r.n_removed for r in got.values())
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if own[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text, got[i].kept_sha256) == (len(w), sum(gone), left, hashlib.sha256(left.encode()).hexdigest())
    assert substring.remove_repeats(empty).count() == 0
    twice = docs.union(docs)
    assert sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(twice).collect()) == sorted([(i, r.n_removed) for i, r in got.items()] * 2)


def test_substring_dedup_takes_its_words_from_the_automata(docs, spark, monkeypatch):
    """With empty automata nothing goes; null ids lose nothing and take nothing away."""
    odd = docs.union(spark.createDataFrame([(None, corpus()[0][1], "x", "y", 1, 2, 3, 4)], SCHEMA))
    got = substring.remove_repeats(odd, keep_text=True).where("doc_id is null").first()
    assert got.n_removed == 0 and got.kept_text == " ".join(corpus()[0][1].split())
    ids = np.array([1, 2, 3])
    a = " ".join(f"a{i}" for i in range(40))
    data, off = text_bytes(__import__("pyarrow").array([a, "x " + a + " y " + a, a + " z"]))
    w = Words(data, off)
    at, n, _, h = substring._segments(w, 13)
    one, first = np.unique(h[w.text[at] == 0], return_index=True)
    args = ids, w, one, np.full(len(one), -1), np.full(len(one), 1)
    start, end, own = substring.phrases(*args[1:], 13)
    assert len(start) < len(one)  # pieces that follow one another are one phrase
    gone = substring.dedup_shard(*args)
    assert [int(gone[x:y].sum()) for x, y in zip(w.bounds[:-1], w.bounds[1:])] == [0, 80, 40]
    whole = substring.automata
    monkeypatch.setattr(substring, "automata", lambda *x: (whole(*x)[0], []))
    assert not substring.dedup_shard(*args).any()


def groups_of(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join(spark, docs, empty, block):
    rows = corpus()
    r = random.Random(5)
    base = [f"v{i}" for i in range(300)]
    for k in range(25):  # a chain of near copies: the ends don't link
        base[r.randrange(300)] = f"n{k}"
        rows.append((1000 + k, " ".join(base)))
    df = spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, 4) for i, t in rows], SCHEMA)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link_groups(df, block=block).collect()}
    assert got == groups_of(rows)
    if block == 3:
        assert jaccard.link_groups(empty).count() == 0
        odd = df.union(spark.createDataFrame([(None, rows[0][1], "x", "y", 1, 2, 3, 4), (None, "nobody else says this", "x", "y", 1, 2, 3, 4), (None, None, "x", "y", 1, 2, 3, 4)], SCHEMA))
        alone = sorted((x.n_shingles, x.component_id is None) for x in jaccard.link_groups(odd).where("doc_id is null").collect())
        assert alone == sorted([(0, True), (2, True), (len(set(zip(*[rows[0][1].split()[k:] for k in range(3)]))) or 1, False)])


@pytest.mark.parametrize("percent", [90, 80])
def test_linked_sets_share_a_segment(percent):
    """Each linked pair has a common key, however small the sets; unrelated sets have none."""
    r = np.random.default_rng(3)
    plan = jaccard.segments_of(percent)
    token = lambda n: r.integers(0, 2**64, n, dtype=U)
    seen = 0
    for n in list(range(1, 60)) + [100, 233, 400, 999]:
        for _ in range(3):
            a = np.unique(token(n))
            most = n * (100 - percent) // percent
            for gone in {0, 1, most // 2, most}:
                for add in {0, 1, most // 2, most}:
                    b = np.sort(np.concatenate([a[gone:], token(add)]))
                    if jaccard.linked(a, b, percent) and len(a) + len(b) != 2 * len(np.intersect1d(a, b)):
                        keys, of = jaccard._segments(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), plan)
                        assert np.intersect1d(keys[of == 0], keys[of == 1]).size, (n, gone, add)
                        seen += 1
    sizes = np.minimum(r.lognormal(4.5, 1.2, 20_000).astype(int) + 1, 3000)
    keys, of = jaccard._segments(token(int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)]), plan)
    o = np.lexsort((of, keys))
    met = (keys[o][1:] == keys[o][:-1]) & (of[o][1:] != of[o][:-1])
    assert seen > 200 and met.sum() <= 2, met.sum()


def test_long_sketches_tell_long_sets_apart():
    """Linked sets pass whatever their sizes, also folded; unrelated ones don't, however long they are."""
    r = np.random.default_rng(6)
    for n in (30, 2000, 2600, 9000, 70_000):
        a = np.unique(r.integers(0, 2**64, n, dtype=U))
        near = np.sort(np.concatenate([a[n // 20 :], r.integers(0, 2**64, n // 12, dtype=U)]))
        far = np.unique(r.integers(0, 2**64, n, dtype=U))
        sizes = np.array([len(a), len(near), len(far)])
        words = jaccard.sketch_words(sizes)
        sk, at = jaccard.sketches(np.concatenate([a, near, far]), np.concatenate([[0], np.cumsum(sizes)]), words)
        bits = jaccard._bits([sk[x:y].tobytes() for x, y in zip(at[:-1], at[1:])])
        assert jaccard.linked(a, near, 80) and jaccard._near(sizes, bits, 0, np.array([1, 2]), 80).tolist() == [1], n
        assert jaccard.forest([a, near, far], 3, 80) == [(0, 1)]


def test_sets_of_few_shingles_a_segment_are_dealt_again():
    """Also where every set is taken as hollow, down to the last seed, linked sets meet."""
    low, d, spare, m, least = jaccard.segments_of(80)
    r = np.random.default_rng(4)
    for need in (1, 3, 10**6):
        plan = low, d, spare, m, np.full(len(least), need)
        for n in (10, 30, 100):
            a = np.unique(r.integers(0, 2**64, n, dtype=U))
            b = np.sort(np.concatenate([a[n // 10 :], r.integers(0, 2**64, n // 10, dtype=U)]))
            keys, of = jaccard._segments(np.concatenate([a, b]), np.array([0, n, 2 * n]), plan)
            assert np.intersect1d(keys[of == 0], keys[of == 1]).size


def test_decontamination(spark, docs, empty):
    rows = corpus()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    long = next(t for i, t in rows if t and 40 <= len(t.split()) < 90)
    items = [(1, " ".join(long.split()[5:25]).upper()), (2, "the, the"), (3, None), (4, ""), (5, "É"), (6, " ".join(long.split()[5:25])), (7, "nothing of this is there")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else []:
            wins[tuple(w[k : k + 10])].add(i)
    got = {r.doc_id: r for r in decontaminate.mark_contamination(docs, bench).collect()}
    hits = 0
    for i, t in rows:
        w, found = words(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit[k : k + n] = [True] * n
                    found |= wins[x]
        assert (got[i]._n_words, got[i]._n_hit, got[i]._items) == (len(w), sum(hit), sorted(found))
        hits += bool(found)
    assert hits and max(r._longest for r in got.values()) == len(words(items[0][1]))
    old = decontaminate.BLOCK_WORDS
    try:
        decontaminate.BLOCK_WORDS = 1  # a block for each item
        many = {r.doc_id: r for r in decontaminate.mark_contamination(docs, bench).collect()}
    finally:
        decontaminate.BLOCK_WORDS = old
    assert all((many[i]._n_hit, many[i]._items, many[i]._longest) == (got[i]._n_hit, got[i]._items, got[i]._longest) for i in got)
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - hits
    assert decontaminate.mark_contamination(empty, bench).count() == 0
    assert decontaminate.mark_contamination(docs, bench.limit(0)).where("_n_hit > 0").count() == 0


TEXTS = ["Hello, World! It's 42 o'clock.", None, "", "naïve café é́ x.y'z--w", "a<|endoftext|>b <|startoftext|>", "tab\tand\nline   nbsp  em", "don't can't we'll I'M 'twas rock'n'roll", "x" * 3000 + "...", "日本語 テキスト, 12345 ١٢٣", "İstanbul ΣΑΣ ß"]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tok = Tokenizer.from_file(path)
    r = random.Random(2)
    texts = TEXTS + [" ".join(r.choices([f"word{i}," for i in range(50)] + ["don't", "UPPER", "(x)"], k=r.randrange(1, 9000, 37))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, 4) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    out = packing.pack(df, path, keep_ids=True).toPandas()
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids + [2]
        g = out[out.doc_id == i].sort_values("start")
        assert [x for ids in g.ids for x in ids] == want and set(g.doc_tokens) == {len(want)}
        at = 0
        for p in g.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes())
            at += p.length
    lost = 0
    for _, g in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]]
        n = int(g.length.sum())
        assert n <= 4096
        lost += 0 if n & (n - 1) == 0 else 4096 - n
    assert lost < 0.02 * out.length.sum()
    assert packing.pack(df.limit(0), path).count() == 0


def test_language_model(spark, docs, empty):
    import math
    from collections import Counter

    rows = corpus()
    toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    c = Counter(x for i, t in rows if i % 3 for x in toks(t))
    n, v = sum(c.values()), len(c)
    for most in (10**6, 5):
        got = {r.doc_id: r for r in lm_bloom.score(docs, docs.where("doc_id % 3 <> 0"), max_words=most).collect()}
        for i, t in rows:
            w = toks(t)
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in c for x in w), n)
            assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
            assert got[i].score < 0
    none = lm_bloom.score(docs, docs.limit(0)).collect()
    assert {r.base_score for r in none} == {0.0} and {r.train_tokens for r in none} == {0}
    assert lm_bloom.score(empty, docs).count() == 0


def test_bloom_levels_stand_for_counts():
    """Small counts exactly, and large ones on average."""
    value, key = lm_bloom.level_value(), np.random.default_rng(1).integers(0, 2**63, 20_000).astype(U)
    for c in (1, 2, 3, 10, 1000, 10**6):
        got = value[lm_bloom.level_of(np.full(len(key), c), key)]
        assert got.mean() == pytest.approx(c, rel=0.01) and (got / c).max() < 1.6 and (c > 3 or (got == c).all())


def test_language_model_adds_up_to_one():
    """Over the vocabulary and one unknown word, after every token, with exact counts."""
    from collections import Counter

    texts = [(t or "").split() for _, t in corpus()]
    one, two = Counter(), Counter()
    for w in texts:
        one.update([*w, None])
        two.update(zip([None, *w], [*w, None], strict=True))
    n, v = sum(one.values()), len(one)
    words = np.array(list(one.values()) + [0])
    for before in [None, "the", *list(one)[:20]]:
        pairs = np.array([two[before, w] for w in one] + [0])
        assert lm_bloom.smoothed(pairs, one[before], words, n, v).sum() == pytest.approx(1, abs=1e-9)


def test_language_id(spark, empty):
    r = random.Random(4)
    words = {"aa": ["the", "thing", "with", "and", "ought"], "bb": ["der", "schön", "und", "ßach", "nicht"], "cc": ["que", "ñandú", "los", "ción", "para"]}
    rows = [(i, " ".join(r.choices(words[k], k=r.randrange(3, 40))), k) for i, k in enumerate(r.choices(list(words), k=300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(df.where("doc_id % 4 <> 2"))
    odd = spark.createDataFrame([(1000, None, "x"), (1001, "", "x"), (1002, "123 !?", "x"), (1003, "the und que", None)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.predict(df.union(odd), m).collect()}
    assert np.mean([got[i]._lang == k for i, _, k in rows if i % 4 == 2]) > 0.97
    assert [got[i]._lang for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]._lang in words
    assert all(0 <= x._score <= 1 for x in got.values()) and got[1002]._rejected and not got[rows[0][0]]._rejected
    assert {x._lang for x in langid.predict(df, langid.fit(df.limit(0))).collect()} == {"und"}
    assert langid.predict(empty, m).count() == 0


def test_language_id_rejects_noise(spark):
    r = random.Random(14)
    words = {k: ["".join(r.choices(s, k=r.randrange(2, 5))) for _ in range(60)] for k, s in {"aa": ["th", "er", "ing", "on", "at"], "bb": ["sch", "ei", "un", "ge", "ü"], "cc": ["ci", "ó", "el", "as", "que"]}.items()}
    rows = [(i, " ".join(r.choices(words[k], k=r.randrange(5, 60))), k) for i, k in enumerate(r.choices(list(words), k=600))]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = ["Съешь ещё этих мягких французских булок, да выпей чаю", "qzxv wkjq pxzf vvkq zzkp", '{"x1": 12, "k_9": [3, 4], "zq": "w7"}', "这是一个中文句子，模型从未见过"]
    new = [(1000 + i, " ".join(r.choices(words[k], k=30)), k) for i, k in enumerate(r.choices(list(words), k=200))]
    got = langid.predict(spark.createDataFrame([(i, t, None) for i, t in enumerate(odd)] + new, "doc_id long, text string, lang string"), m).collect()
    assert all(x._rejected for x in got if x.doc_id < 1000) and np.mean([x._rejected for x in got if x.doc_id >= 1000]) < 0.01
    assert all(x._lang in words for x in got)


def test_ordinal_regression(spark, empty):
    r = random.Random(6)
    rows, grades = [], []
    for i in range(400):
        g = r.choice([0, 0, 0, 1, 2])
        rows.append((i, " ".join(r.choices([f"c{k}" for k in range(200)], k=30) + r.sample(["vile", "awful", "horrid", "nasty", "foul", "rotten"], 2 * g))))
        grades.append((i, g))
    rows += [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.fit(df, spark.createDataFrame([*grades, (5000, 2), (3, None)], "doc_id long, grade int"))
    assert len(m.thresholds) == 2 and m.thresholds[0] <= m.thresholds[1]
    got = {x.doc_id: x for x in toxicity.score(df, m).collect()}
    g = dict(grades)
    assert np.mean([got[i].grade == g[i] for i in g]) > 0.95
    assert np.mean([got[i].severity for i in g if g[i] == 2]) > np.mean([got[i].severity for i in g if g[i] == 1]) > np.mean([got[i].severity for i in g if g[i] == 0])
    assert all(got[i].toxic == (g[i] > 0) for i in list(g)[:100]) and not got[1000].toxic
    two = toxicity.fit(df, spark.createDataFrame([(i, int(x > 0)) for i, x in grades], "doc_id long, grade int"))
    assert len(two.thresholds) == 1
    assert toxicity.score(df, toxicity.fit(df, spark.createDataFrame([], "doc_id long, grade int"))).where("toxic").count() == 0
    assert toxicity.score(empty.select("doc_id", "text"), m).count() == 0


def test_quality(spark, empty):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdeéfghijklmnop", k=r.randrange(1, 9)))
    good = [" ".join(word() + ("." if r.random() < 0.12 else "") for _ in range(80)) for _ in range(150)]
    bad = [" | ".join(word() + "%%%" for _ in range(60)) for _ in range(30)] + [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(30)]
    rows = list(enumerate(good + bad)) + [(900, None), (901, "")]
    out = {x.doc_id: x for x in quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([out[i].keep for i in range(150)]) > 0.97 and np.mean([out[i].keep for i in range(150, 210)]) < 0.1
    assert all(0 <= x.posterior <= 1 and 0 <= x.score <= 1 for x in out.values())
    assert quality.classify(empty).count() == 0


def test_em_recovers_the_labellers():
    r = np.random.default_rng(8)
    y = r.random(40000) < 0.8
    acc = [0.95, 0.85, 0.7, 0.9, 0.6]
    v = np.stack([np.where(r.random(len(y)) < 0.2, 0, np.where(r.random(len(y)) < a, 1, -1) * np.where(y, 1, -1)) for a in acc], 1)
    p, n = np.unique(quality.pattern(v), return_counts=True)
    post, share, table = quality.posterior(p, n, 5)
    assert share == pytest.approx(0.8, abs=0.03)
    for k, a in enumerate(acc):
        assert table[1][k][2] / (table[1][k][0] + table[1][k][2]) == pytest.approx(a, abs=0.04)


def test_nearest(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(1500, 32))
    x[200:260] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(9000, None), (9100, [0.0] * 32), (9200, [float("nan")] * 32), (9300, []), (9400, [None] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out = mih.nearest(df, df.where("vec_id % 100 = 0")).toPandas()
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        g = out[out.query_id == q].sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(g.score, d[g.vec_id])
        assert list(g.sort_values(["score", "vec_id"]).vec_id) == list(g.vec_id)
        hit += len(set(want) & set(g.vec_id))
    assert hit / 150 >= 0.9 and set(out.query_id) == set(range(0, 1500, 100))
    # repeated rows, rows of one id with different vectors, other lengths
    more = df.union(df).union(spark.createDataFrame([(100, [float(v) for v in x[700]]), (101, [1.0] * 5), (None, [1.0] * 32), (200, [2.0] * 31)], df.schema))
    again = mih.nearest(more, more.where("vec_id % 100 = 0")).toPandas()
    hit = 0
    for q, g in again.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        if q == 100:
            d = np.minimum(d, np.sqrt(((x - x[700]) ** 2).sum(1)))
        d[100] = min(d[100], np.sqrt(((x[700] - x[q]) ** 2).sum()))
        d[q] = np.inf
        assert np.allclose(g.score, d[g.vec_id]) and list(g.sort_values(["score", "vec_id"]).vec_id) == list(g.sort_values("rank").vec_id)
        hit += len(set(np.lexsort((np.arange(1500), d))[:10]) & set(g.vec_id))
    assert hit / 150 >= 0.9
    assert (again.groupby("query_id").vec_id.nunique() == 10).all()
    few = df.where("vec_id < 4 or vec_id = 100")
    assert mih.nearest(few, few.where("vec_id % 100 = 0")).count() == 2 * 4
    assert mih.nearest(df.limit(0), df.limit(0)).count() == 0


def test_index_finds_every_code_within_the_radius():
    r = np.random.default_rng(10)
    codes = r.integers(0, 256, (600, 8), dtype=np.uint8)
    index = mih.Index(codes)
    for radius in (0, 3, 9, 20, 27):
        q = codes[r.integers(600)] ^ (r.random(8) < 0.2).astype(np.uint8)
        d = mih.distance(q[None], codes)[0]
        assert sorted(index.within(q, radius)) == sorted(np.flatnonzero(d <= radius))


PAGES = [
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>Title &amp; more</h1><p>First   para<p>Second <b>bo</b>ld&eacute;.</article><div class='ad'>Buy</div><footer>Foot</footer></body></html>", "Title & more First para Second boldé."),
    ("<body><div id=main-text><p>One sentence that is long enough to matter here.</p><p>Two.</p><ul class='share'><li>Tweet</ul></div><div class='sidebar'><p>Other text here and there.</p></div><section id='comments'><p>Reader says hello at length, more than the article does.</p></section></body>", "One sentence that is long enough to matter here. Two."),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", "yes"),
    ("<p>unclosed <b>bold<p>next <a href='a>b'>link</a> text, with a few words more", "unclosed bold next link text, with a few words more"),
    ("<header>H</header><form><p>F</p></form><aside>A</aside>", ""),
    ("", ""),
    (None, ""),
    ("<div>" * 3000 + "deep", "deep"),
    ("no markup at all &lt;x&gt;", "no markup at all <x>"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_extract_keeps_columns(spark):
    df = spark.createDataFrame([(i, "u", h, "text") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    out = html_text.extract(df)
    assert out.columns == [*df.columns, "_text"] and {r.page_id: r._text for r in out.collect()} == {i: w for i, (_, w) in enumerate(PAGES)}


def test_language_model_keeps_all_levels(spark, docs, monkeypatch):
    """However many shards the tokens need, each has its exact count, and each pair its level, also where it occurs once."""
    import pyarrow as pa

    monkeypatch.setattr(lm_bloom, "MAX_PAIRS", 2_000)
    table, shards, n, v = lm_bloom.fit(docs)
    h, bounds = lm_bloom._whole(pa.array([t for _, t in corpus()]))
    u, k = np.unique(lm_bloom.pair(lm_bloom._previous(h, bounds), h), return_counts=True)
    of, level = lm_bloom._shard(u, shards), lm_bloom.level_of(k, u)
    words = dict(zip(*np.unique(h, return_counts=True), strict=True))
    seen = pairs = 0
    for x in table.collect():
        seen += len(np.frombuffer(x.h, U))
        assert all(words[a] == b for a, b in zip(np.frombuffer(x.h, U), np.frombuffer(x.c, np.int64), strict=True))
        mine = of == x.s
        pairs += int(mine.sum())
        assert (lm_bloom.Filter.levels(lm_bloom.Filter.read(x.bits), u[mine]) >= level[mine]).all()
    assert pairs == len(u) and shards > 10 and seen == v and len(np.unique([r.s for r in table.select("s").collect()])) <= shards


def test_language_model_counts_all_pairs(spark, monkeypatch):
    """Every token has the score of a brute-force model in which each pair counts, however rare, over many shards and buckets."""
    import math
    from collections import Counter

    for name, to in (("MAX_PAIRS", 60_000), ("BUCKET_BYTES", 100_000)):
        monkeypatch.setattr(lm_bloom, name, to)
    r = random.Random(12)
    rows = [(i, " ".join(r.choice("abc") + str(int(r.paretovariate(0.3)) % 10**6) for _ in range(300))) for i in range(600)]
    rows[7] = (7, "once seen pair " + rows[7][1])
    one, two = Counter(), Counter()
    for i, t in rows:
        w = [None, *t.split(), None]
        one.update(w[1:])
        two.update(zip(w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    assert min(one["once"], one["seen"]) == 1 and 1 / n < 1e-5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in lm_bloom.score(df, df).collect()}
    want, cut = {}, {}
    for i, t in rows:
        w = [None, *t.split(), None]
        p = [lm_bloom.smoothed(two[a, b], one[a], one[b], n, v) for a, b in zip(w, w[1:], strict=False)]
        q = [lm_bloom.smoothed(two[a, b] if two[a, b] > 1 else 0, one[a], one[b], n, v) for a, b in zip(w, w[1:], strict=False)]
        want[i] = sum(math.log10(x) for x in p) / len(p)
        cut[i] = sum(math.log10(x) for x in q) / len(q)
    off = [abs(got[i].score / got[i].n_tokens - want[i]) for i in want]
    assert max(off) < 0.02 < max(abs(got[i].score / got[i].n_tokens - cut[i]) for i in want), max(off)


_LONG = "This sentence of the article has words enough, with clauses and commas, to be taken for text by any measure of density."
_LINKS = "".join(f"<li><a href='/{k}'>Another story number {k}</a></li>" for k in range(8))
ARTICLES = [
    # unnamed link list and teaser in the one article
    (f"<body><div><article><h1>Head</h1><p>{_LONG}</p><p>Short.</p><div><ul>{_LINKS}</ul></div><p>{_LONG}</p><div><h3><a href=x>A teaser of a story</a></h3><a href=x>go on</a></div></article></div></body>", f"Head {_LONG} Short. {_LONG}"),
    # text split over two articles
    (f"<body><main><article><h2>One</h2><p>{_LONG}</p><p>{_LONG}</p></article><article><h2>Two</h2><p>{_LONG}</p></article></main></body>", f"One {_LONG} {_LONG} Two {_LONG}"),
    # a link list beside two articles
    (f"<body><main><article><p>{_LONG}</p></article><div>{_LINKS}</div><article><p>{_LONG}</p></article></main></body>", f"{_LONG} {_LONG}"),
    # links within running text stay
    (f"<body><article><p>{_LONG} <a href=x>A link</a>, then on.</p><p>{_LONG}</p></article></body>", f"{_LONG} A link, then on. {_LONG}"),
]


_MENU = "".join(f"<a href='/{k}'>Section {k}</a> " for k in range(6))
PLAIN = [
    # no article element and no telling name: a menu, a plain foot and a teaser list beside the text
    (f"<body><div>{_MENU}</div><div><h1>Head</h1><p>{_LONG}</p><p>{_LONG}</p><p>{_LONG}</p></div><div><ul>{_LINKS}</ul></div><div>Printed in 2020.</div></body>", f"Head {_LONG} {_LONG} {_LONG}"),
    # the heading stands before the text's own block, and the text goes on in another
    (f"<body><div>{_MENU}</div><h1>Head</h1><div><p>{_LONG}</p><p>{_LONG}</p><p>{_LONG}</p></div><div><p>{_LONG}</p><p>{_LONG}</p></div><div>Printed in 2020.</div></body>", f"Head {_LONG} {_LONG} {_LONG} {_LONG} {_LONG}"),
    # a sentence of the body's own takes neither menu nor foot with it
    (f"<body>{_LONG}<nav>{_MENU}</nav><article><p>{_LONG}</p><p>{_LONG}</p></article><div>Printed in 2020.</div></body>", f"{_LONG} {_LONG} {_LONG}"),
    # names that only touch boilerplate's
    (f"<body><div class='content has-sidebar'><article id='post-no-comments'><h2 class='article-header'>Head</h2><p class='legal'>{_LONG}</p><p>{_LONG}</p></article><div class='sidebar'><p>{_LONG}</p></div></div></body>", f"Head {_LONG} {_LONG}"),
    # a wrapper named like boilerplate that holds the article; comments longer than it
    (f"<body><div class='comments'><article><p>{_LONG}</p></article></div><section class='user-comments'><p>{_LONG}</p><p>{_LONG}</p><p>{_LONG}</p></section></body>", _LONG),
    # a page header holds no text, an article's does
    (f"<body><header><p>{_LONG}</p></header><article><header><h1>Head</h1><p>By line.</p></header><p>{_LONG}</p></article><p hidden>{_LONG}</p><p data-x='hidden'>.</p></body>", f"Head By line. {_LONG}"),
]


@pytest.mark.parametrize(("page", "want"), PLAIN)
def test_density_chooses_without_telling_names(page, want):
    assert html_text.main_text(page) == want


def test_density_of_every_node_is_the_naive_one():
    import math

    for page, _ in [*ARTICLES, *PLAIN]:
        p = html_text.Page(page)
        density, total, links, chars = p.measure()
        n = len(p.tag)
        below = lambda i: [j for j in range(n) if any(k == i for k in up(j))]

        def up(j, p=p):
            while j >= 0:
                yield j
                j = p.parent[j]

        text = {j: sum(len("".join(t.split())) for k, t in p.events if k == j and isinstance(t, str)) for j in range(n)}
        for i in range(1, n):
            nodes = below(i)
            c, lc = sum(text[j] for j in nodes), sum(text[j] for j in nodes if any(p.tag[k] == "a" for k in up(j) if k >= 0))
            t, lt = max(len(nodes) - 1, 1), max(sum(p.tag[j] == "a" for j in nodes if j != i), 1)
            assert (c, lc) == (chars[i], links[i])
            share = links[0] / max(chars[0], 1)
            want = c / t * math.log(max(c / max(lc, 1) * t / lt, 1)) / max(math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e)), 1e-6) if c else 0
            assert density[i] == pytest.approx(want)
            assert total[i] == pytest.approx(sum(density[j] for j in range(n) if p.parent[j] == i))


@pytest.mark.parametrize(("page", "want"), ARTICLES)
def test_density_chooses_within_articles(page, want):
    assert html_text.main_text(page) == want
