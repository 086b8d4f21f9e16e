"""Language-model scoring with a log-frequency Bloom filter in shards.

Tokens of a text: A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+``, then one end.  From all training documents come exact counts of tokens and of
all pairs of neighbours, whatever their counts.  The filter holds each pair once for each level up to that of its count, and a probe
for levels 1, 2, ... until one misses gives the level back.  Levels stand for counts that grow by BASE; a count between two of them takes
the upper one with just the probability (by a hash of the pair) that makes its mean right, so sums over pairs stay right too.

A token w after v has the probability

    p(w | v) = (c(v, w) + a(v) p(w)) / (c(v) + a(v)),    p(w) = (c(w) + 1) / (N + V + 1),    a(v) = ALPHA * c(v) ** POWER

with c(v, w) from the filter, c(v, w) <= min(c(v), c(w)), and c(v), c(w) exact, as the base needs these anyway.  With exact counts this adds
up to 1 over the V words and one unknown word, after every v: the sum of c(v, w) over w is c(v), as each token but an end is followed by one, and
each end is taken to begin a document.  a(v) estimates how many different words follow v, which is what Witten-Bell smoothing takes.

The filter is dealt by hash into shards of bounded size, whose number follows the training tokens, so no level is dropped and nothing of
it is broadcast or reaches the driver.  Documents are dealt into buckets of about ``BUCKET_BYTES``; each bucket asks each shard for its
distinct tokens and pairs, and the answers come back in the order of their hashes.  Shards also hold the exact counts of their tokens.

The exact base: sum of log10((c + 1) / (N + V + 1)).
Defined cases: null or empty text is the end token alone; no training documents: N = V = 0 and base 0; rows of one id, or without one, are scored each;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, prepare, release
from .wordcode import Bloom, U, Words, counts_between, i64, mix, slices, text_bytes, u64

BASE = 1.5
ALPHA, POWER = 2.0, 0.8
BITS_PER_ENTRY = 12
PROBES = 5
#: of a shard: training tokens (so distinct pairs at most), and words with exact counts
MAX_PAIRS, MAX_WORDS = 1_000_000, 250_000
BUCKET_BYTES = 4 << 20
END = mix(np.array([20], U))[0]
_PAIR = U(0xA24BAED4963EE407)
#: Within a shard, 5 bytes of a pair's hash are its key.
_KEY = U((1 << 40) - 1)


def level_value(base: float = BASE, most: int = 400) -> np.ndarray:
    """The counts that the levels stand for: 0, 1, 2, ... and on by about ``base``."""
    out = [0, 1]
    while len(out) < most and out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, int(out[-1] * base)))
    return np.array(out, np.float64)


def level_of(c: np.ndarray, key: np.ndarray, base: float = BASE) -> np.ndarray:
    """Levels of counts, rounded up with the share of the way to the next level, by the key's hash: the mean value of a count's levels is the count."""
    value = level_value(base)
    low = np.searchsorted(value, c.astype(float), side="right") - 1
    way = (c - value[low]) / (value[np.minimum(low + 1, len(value) - 1)] - value[low] + (low == len(value) - 1))
    return low + ((mix(key ^ U(0x2545F491)) >> U(11)).astype(float) / 2.0**53 < way)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * _PAIR + b)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with an end after each text, bounds)."""
    bounds = w.bounds + np.arange(len(w.bounds))
    h = np.full(bounds[-1], END, U)
    body = np.ones(len(h), bool)
    body[bounds[1:] - 1] = False
    h[body] = w.h
    return h, bounds


def _previous(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    p = np.empty_like(h)
    p[1:] = h[:-1]
    p[bounds[:-1]] = END
    return p


def _texts(col):
    data, off = text_bytes(col)
    for i, j in slices(off):
        h, bounds = tokens(Words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True))
        yield i, j, h, bounds


def _whole(col) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of all texts of a bucket."""
    parts = [(h, bounds) for _, _, h, bounds in _texts(col)]
    size = np.concatenate([np.diff(b) for _, b in parts])
    return np.concatenate([h for h, _ in parts]), np.concatenate([[0], np.cumsum(size)])


def _sums(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(h, return_inverse=True)
    return u, np.bincount(inv, weights=c, minlength=len(u)).astype(np.int64)


def _summed(parts, room: int = 1_500_000):
    """(sorted hashes, counts) of a task's parts, added up as far as ``room`` allows."""
    have, size = [], 0
    for part in parts:
        have.append(part)
        size += len(part[0])
        if size > room:
            have = [_sums(*(np.concatenate(x) for x in zip(*have, strict=True)))]
            size = len(have[0][0])
            if size > room // 2:
                yield have[0]
                have, size = [], 0
    if have:
        yield _sums(*(np.concatenate(x) for x in zip(*have, strict=True)))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Grows with the hash."""
    return ((h >> U(40)) * U(shards) >> U(24)).astype(np.int64)


def _borders(h: np.ndarray, shards: int) -> np.ndarray:
    """Where the shards begin and end in sorted hashes."""
    return np.searchsorted(_shard(h, shards), np.arange(shards + 1))


def _low(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _high(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view(U).ravel()


def _joined(col) -> bytes:
    return b"".join(col.to_pylist())


def _counted(df: DataFrame) -> DataFrame:
    """(h, c): counts of tokens, added up in each task first."""
    prepare(df.sparkSession)

    def run(batches):
        for u, c in _summed(np.unique(h, return_counts=True) for b in batches for _, _, h, _ in _texts(b.column("t"))):
            yield pa.record_batch({"h": i64(u), "c": pa.array(c)})

    return df.select("t").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Filter:
    """The bits of a shard: each key with all levels up to its own."""

    @staticmethod
    def build(h: np.ndarray, level: np.ndarray) -> bytes:
        key = np.repeat(mix(h & _KEY), level)
        lv = np.arange(len(key)) - np.repeat(np.cumsum(level) - level, level) + 1
        blocks = len(key) * BITS_PER_ENTRY // Bloom.BLOCK_BITS + 1
        bits = np.zeros(blocks * Bloom.BLOCK_BITS, bool)
        base = Bloom.block(key, blocks) * Bloom.BLOCK_BITS
        for i in range(PROBES):
            bits[base + Bloom.bit(key, lv, i)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    @staticmethod
    def read(data: bytes) -> Bloom:
        return Bloom(np.frombuffer(data, np.uint8), len(data) * 8 // Bloom.BLOCK_BITS, PROBES)

    @staticmethod
    def levels(bits: Bloom, key: np.ndarray) -> np.ndarray:
        return bits.level(mix(key & _KEY), 200).astype(np.uint8)


def fit(train: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS) -> tuple[DataFrame, int, int, int]:
    """((s, bits, h, c): shards of the filter of pairs with the exact counts of the shard's tokens; number of shards; N; V)."""
    train = train.select(F.col(text_col).alias("t"))
    words = cut(_counted(train))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-n // MAX_PAIRS), -(-v // max_words))

    def dealt(u, c, word):
        at = _borders(u, shards)
        s = np.flatnonzero(np.diff(at))
        h, c = u.tobytes(), c.astype(np.int64).tobytes()
        cuts = [(8 * int(at[k]), 8 * int(at[k + 1])) for k in s]
        return pa.record_batch({"s": pa.array(s), "w": pa.array([word] * len(s), pa.bool_()), "h": pa.array([h[a:b] for a, b in cuts], pa.binary()), "c": pa.array([c[a:b] for a, b in cuts], pa.binary())})

    def pairs(batches):
        for u, c in _summed(np.unique(pair(_previous(h, bounds), h), return_counts=True) for b in batches for _, _, h, bounds in _texts(b.column("t"))):
            yield dealt(u, c, False)

    def exact(batches):
        for u, c in _summed((u64(b.column("h")), b.column("c").to_numpy()) for b in batches):
            yield dealt(u, c, True)

    def build(key, table):
        word = table.column("w").to_numpy(zero_copy_only=False)
        h, c = [], []
        for kind in (True, False):
            rows = table.filter(pa.array(word == kind))
            u, k = _sums(np.frombuffer(_joined(rows.column("h")), U), np.frombuffer(_joined(rows.column("c")), np.int64))
            h.append(u)
            c.append(k)
        bits = Filter.build(h[1], level_of(c[1], h[1]))
        return pa.table({"s": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits], pa.binary()), "h": pa.array([h[0].tobytes()], pa.binary()), "c": pa.array([c[0].tobytes()], pa.binary())})

    schema = "s long, w boolean, h binary, c binary"
    table = cut(train.mapInArrow(pairs, schema).unionByName(words.mapInArrow(exact, schema)).groupBy("s").applyInArrow(build, "s long, bits binary, h binary, c binary"))
    drop(words)
    return table, shards, n, v


def smoothed(c_pair, c_before, c_word, n: int, v: int, alpha: float = ALPHA, power: float = POWER):
    """p(w | v) of the module's formula."""
    one = (c_word + 1) / (n + v + 1)
    a = alpha * np.maximum(c_before, 1.0) ** power
    return (np.minimum(c_pair, np.minimum(c_before, c_word)) + a * one) / (c_before + a)


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, power: float = POWER, **options) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    spark = docs.sparkSession
    model, shards, n, v = fit(train, text_col, **options)
    release(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    docs = docs.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(size // BUCKET_BYTES + 1)))
    whole = float(np.log10(n + v + 1))

    def ask(key, table):
        h, bounds = _whole(table.column("t"))
        u, p = np.unique(h), np.unique(pair(_previous(h, bounds), h))
        a, b = _borders(u, shards), _borders(p, shards)
        s = np.flatnonzero(np.diff(a) + np.diff(b))
        return pa.table({"b": pa.array(np.full(len(s), key[0].as_py(), np.int64)), "s": pa.array(s), "u": pa.array([u[a[k] : a[k + 1]].tobytes() for k in s], pa.binary()), "p": pa.array([_low(p[b[k] : b[k + 1]]) for k in s], pa.binary())})

    def answer(key, asked, shard):
        bits = Filter.read(shard.column("bits")[0].as_py() if shard.num_rows else b"")
        known = np.frombuffer(shard.column("h")[0].as_py() if shard.num_rows else b"", U)
        count = np.frombuffer(shard.column("c")[0].as_py() if shard.num_rows else b"", np.int64)
        out = []
        for i in range(0, asked.num_rows, 256):
            part = asked.slice(i, 256)
            u, p = np.frombuffer(_joined(part.column("u")), U), _high(_joined(part.column("p")))
            c = np.zeros(len(u), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, u), len(known) - 1)
                c = np.where(known[at] == u, count[at], 0)
            lp, c = Filter.levels(bits, p).tobytes(), c.tobytes()
            a = np.concatenate([[0], np.cumsum([len(x) // 8 for x in part.column("u").to_pylist()])]).tolist()
            b = np.concatenate([[0], np.cumsum([len(x) // 5 for x in part.column("p").to_pylist()])]).tolist()
            k = range(part.num_rows)
            out.append(pa.table({"b": part.column("b"), "s": part.column("s"), "c": pa.array([c[8 * a[j] : 8 * a[j + 1]] for j in k], pa.binary()), "p": pa.array([lp[b[j] : b[j + 1]] for j in k], pa.binary())}))
        return pa.concat_tables(out) if out else pa.table({"b": pa.array([], pa.int64()), "s": pa.array([], pa.int64()), "c": pa.array([], pa.binary()), "p": pa.array([], pa.binary())})

    def rate(key, table, answers):
        h, bounds = _whole(table.column("t"))
        answers = answers.sort_by("s")
        value = level_value()
        _, inv = np.unique(h, return_inverse=True)
        c = np.frombuffer(_joined(answers.column("c")), np.int64)[inv]
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[bounds[:-1]] = c[bounds[1:] - 1]  # of the end, which each text has
        _, inv = np.unique(pair(_previous(h, bounds), h), return_inverse=True)
        both = value[np.frombuffer(_joined(answers.column("p")), np.uint8)][inv]
        own = np.add.reduceat(np.log10(smoothed(both, before, c, n, v, alpha, power)), bounds[:-1])
        base = np.add.reduceat(np.log10(c + 1.0), bounds[:-1]) - np.diff(bounds) * whole
        return pa.table({id_col: table.column("i"), "n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(counts_between(c > 0, bounds)), "train_tokens": pa.array(np.full(table.num_rows, n, np.int64)), "base_score": pa.array(base), "score": pa.array(own)})

    prepare(spark)
    asked = docs.groupBy("b").applyInArrow(ask, "b long, s long, u binary, p binary")
    answers = cut(asked.groupBy("s").cogroup(model.groupBy("s")).applyInArrow(answer, "b long, s long, c binary, p binary"))
    drop(model)
    release(spark)
    return docs.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(rate, f"`{id_col}` long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
