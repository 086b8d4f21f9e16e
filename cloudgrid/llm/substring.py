"""Substring dedup by repeated-phrase automata.

A window is ``width`` consecutive words of one document (words ``[^\\x20\\x09-\\x0D]+``, unchanged).  A word is removed if a window
that covers it also starts in a document with a smaller id.  Steps:

1. *candidates*: each window is stood for by the smallest hash among its ``GRAM``-word grams (equal windows have equal ones);
   the grams that stand for windows of two rows or more go into a Bloom filter of bounded size;
2. *confirmation*: consecutive windows with one gram are a segment.  Segments whose gram is in the filter are grouped by gram and words.
   A gram with one segment only has its windows nowhere else, so the segment's smallest document owns them.  For the other grams the
   windows themselves are grouped by a 96-bit hash of their words, and the smallest document of each is its owner.  Partial
   aggregation collapses hot segments and windows in each task;
3. *phrases*: documents with candidates are dealt into shards by id, and a shard gets the recurring segments and windows that occur in it
   with their owners.  Pieces that always follow one another in the shard and have one owner are joined to one phrase, whose words are taken
   from its first occurrence; all distinct phrases that a document of the shard owes to a smaller one are compiled into Aho-Corasick
   automata (two letters for each word, ``LETTERS`` letters or one phrase in each automaton);
4. *location*: all documents of the shard are streamed through its automata, and only what these report is removed: an occurrence of a
   phrase in a document after the phrase's owner.  A document none of whose grams is in the filter holds no phrase and is answered where it is.

Defined cases: null or empty text has no words; a document of fewer words than ``width`` keeps them all; copies of a document keep
the one of the smallest id; rows of one id count as one document (each row is answered); a row with a null id stands after and before no
other: it is answered, loses no word and takes none away; windows that recur only inside one document stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bloom, cut, drop, map_arrow, prepare, release
from .wordcode import U, Words, counts_between, cover, gram_starts, grams, i64, mix, ranges, slices, span_hash, text_bytes, u64

WIDTH = 13
GRAM = 5
#: letters of the phrases in one automaton
LETTERS = 400_000
#: bytes of text in a shard of documents, about
SHARD_BYTES = 2 << 20


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _windows(w: Words, width: int):
    """(positions, hash of the gram that stands for it) of all windows."""
    n, gram = len(w.h), min(GRAM, width)
    ok = gram_starts(w.bounds, width, n)
    at = np.flatnonzero(ok)
    if not len(at):
        return at, np.zeros(0, U)
    return at, mix(_sliding_min(grams(w.h, gram, 7), width - gram + 1)[at])  # mixed, as minima are small


def _shard(ids: np.ndarray, shards: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) % U(shards)).astype(np.int64)


def _each(batch, id_col: str, text_col: str):
    ids = batch.column(id_col).cast(pa.int64()).to_numpy(zero_copy_only=False)
    data, off = text_bytes(batch.column(text_col))
    for i, j in slices(off):
        yield ids[i:j], Words(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _keys(w: Words, at: np.ndarray, width: int):
    a = grams(w.h, width, 11)[at]
    b = (grams(w.h, width, 13)[at] >> U(33)).astype(np.int64)
    return a, b


def _segments(w: Words, width: int):
    """(first window's position, number of windows, gram, hash of the words) of all runs of windows with one gram."""
    at, g = _windows(w, width)
    if not len(at):
        return at, at, g, g
    new = np.ones(len(at), bool)
    new[1:] = (g[1:] != g[:-1]) | (at[1:] != at[:-1] + 1)
    k = np.flatnonzero(new)
    n = np.diff(np.append(k, len(at)))
    return at[k], n, g[k], span_hash(w.h, at[k], at[k] + n - 1 + width)


def _first_rows(*cols):
    """Order of the rows and places of the first of each group of equal rows, the last column left out."""
    o = np.lexsort(cols[::-1])
    new = np.ones(len(o), bool)
    new[1:] = np.logical_or.reduce([c[o][1:] != c[o][:-1] for c in cols[:-1]])
    return o, np.flatnonzero(new)


def _owners(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, s, owner: for the rows (key, s, lo, hi) of each shard that has a document after the owner."""
    owner = rows.groupBy(*key).agg(F.min("lo").alias("owner"), F.max("hi").alias("last")).where("owner < last").drop("last")
    return rows.join(owner, key).where("hi > owner").drop("lo", "hi")


class Confirmed:
    """Which grams are candidates (a broadcast filter), and what recurs in which shard: (h, c, s, owner), c being -1 for segments."""

    def __init__(self, docs: DataFrame, width: int, shards: int):
        spark = docs.sparkSession

        def stand(batch):
            h = []
            for _, w in _each(batch, "i", "t"):
                at, _, g, _ = _segments(w, width)
                o, one = _first_rows(g, w.text[at], np.zeros(len(at), np.int8))
                h.append(g[o][one])  # once for each document
            h, n = np.unique(np.concatenate(h), return_counts=True)
            return pa.record_batch({"h": i64(h), "n": pa.array(n)})

        # rows of one id count apart here, which only adds candidates
        grams_ = cut(map_arrow(docs, stand, "h long, n long", "t").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
        self.seen = seen = spark.sparkContext.broadcast(bloom(grams_, "h", grams_.count()))
        drop(grams_)

        def segments(batch):
            out = []
            for ids, w in _each(batch, "i", "t"):
                at, _, g, h = _segments(w, width)
                ok = seen.value.has(g)
                out.append((g[ok], h[ok], ids[w.text[at[ok]]]))
            g, h, d = (np.concatenate(x) for x in zip(*out, strict=True))
            s = _shard(d, shards)
            o, at = _first_rows(g, h, s, d)
            if not len(at):
                return None
            return pa.record_batch({"g": i64(g[o][at]), "h": i64(h[o][at]), "s": pa.array(s[o][at].astype(np.int32)), "lo": pa.array(d[o][at]), "hi": pa.array(np.maximum.reduceat(d[o], at))})

        by = map_arrow(docs, segments, "g long, h long, s int, lo long, hi long", "t").groupBy("g", "h", "s").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        by = cut(by)
        different = by.groupBy("g").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("g")
        different = cut(different)
        mixed = spark.sparkContext.broadcast(bloom(different, "g", different.count()))
        drop(different)

        def windows(batch):
            out = []
            for ids, w in _each(batch, "i", "t"):
                at, n, g, _ = _segments(w, width)
                ok = mixed.value.has(g)
                at = ranges(at[ok], n[ok])
                if len(at):
                    a, b = _keys(w, at, width)
                    out.append((a, b, ids[w.text[at]]))
            if not out:
                return None
            a, b, d = (np.concatenate(x) for x in zip(*out, strict=True))
            s = _shard(d, shards)
            o, at = _first_rows(a, b, s, d)
            return pa.record_batch({"h": i64(a[o][at]), "c": pa.array(b[o][at].astype(np.int32)), "s": pa.array(s[o][at].astype(np.int32)), "lo": pa.array(d[o][at]), "hi": pa.array(np.maximum.reduceat(d[o], at))})

        def alone(batch):
            return batch.filter(pa.array(~mixed.value.has(u64(batch.column("g"))))).drop_columns(["g"])

        single = map_arrow(by, alone, "h long, s int, lo long, hi long")
        several = cut(map_arrow(docs, windows, "h long, c int, s int, lo long, hi long", "t").groupBy("h", "c", "s").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        whole = _owners(single, ["h"]).select("h", F.lit(-1).alias("c"), "s", "owner")
        self.rows = whole.unionByName(_owners(several, ["h", "c"]).select("h", "c", "s", "owner"))


def phrases(w: Words, h: np.ndarray, c: np.ndarray, owner: np.ndarray, width: int):
    """(first word, end, owner) of one occurrence of each distinct phrase of a shard, given its recurring segments (h, -1) and windows (h, c), sorted.

    A piece is a recurring segment, or a recurring window of other segments.  Piece v is joined to u if every u of the shard is followed by v,
    every v follows u, and both have one owner; so a phrase occurs wherever one of its pieces does.
    """
    none = np.zeros(0, np.int64)
    at, count, _, hash_ = _segments(w, width)
    if not len(at) or not len(h):
        return none, none, none
    absent = np.iinfo(np.int64).max
    whole = _lookup(h, c, owner, hash_, np.full(len(at), -1))
    ok = whole != absent
    single = ranges(at[~ok], count[~ok])
    a, b = _keys(w, single, width)
    own = _lookup(h, c, owner, a, b)
    hit = own != absent
    start = np.concatenate([at[ok], single[hit]])
    size = np.concatenate([count[ok], np.ones(int(hit.sum()), np.int64)])
    own = np.concatenate([whole[ok], own[hit]])
    key = np.concatenate([hash_[ok], mix(a[hit] ^ mix(b[hit].view(U)))])
    if not len(start):
        return none, none, none
    o = np.argsort(start, kind="stable")
    start, size, own, key = start[o], size[o], own[o], key[o]
    text = np.searchsorted(w.bounds, start, side="right") - 1
    _, first, unit = np.unique(key, return_index=True, return_inverse=True)
    beside = (start[1:] == start[:-1] + size[:-1]) & (text[1:] == text[:-1]) & (own[1:] == own[:-1])
    after, before = np.full(len(unit), -1), np.full(len(unit), -1)
    after[:-1] = np.where(beside, unit[1:], -1)
    before[1:] = np.where(beside, unit[:-1], -1)

    def only(x):
        """The one value that all of a piece's occurrences have, or -1."""
        lo, hi = np.full(len(first), len(unit)), np.full(len(first), -1)
        np.minimum.at(lo, unit, x)
        np.maximum.at(hi, unit, x)
        return np.where(lo == hi, hi, -1)

    after, before = only(after), only(before)
    goes = (after >= 0) & (before[after] == np.arange(len(first)))  # a piece joined to the next one
    comes = np.zeros(len(first), bool)
    comes[after[goes]] = True
    ends = np.flatnonzero(~goes[unit])
    begin = np.sort(first[~comes])
    last = ends[np.searchsorted(ends, begin)]
    return start[begin], start[last] + size[last] - 1 + width, own[begin]


def automata(w: Words, start: np.ndarray, end: np.ndarray, owner: np.ndarray):
    """(texts with two letters for each word, automata of the phrases start..end); a phrase's value: its length in words and its owner.

    A word's letters are the two digits of its number, from two alphabets: no match begins or ends within a word, and no node of an automaton has
    more than a few hundred children, among which it looks one after another.
    """
    letters, codes = np.unique(w.h, return_inverse=True)
    base = max(2, int(np.ceil(np.sqrt(len(letters) + 1))))
    if base >= 0x5000:
        raise ValueError("a shard has more words than letters")
    pair = np.empty((len(codes), 2), np.uint32)
    pair[:, 0], pair[:, 1] = 0x100 + codes // base, 0x6000 + codes % base
    whole = pair.tobytes().decode("utf-32-le")
    made, size = [], LETTERS
    for p, e, o in zip(start.tolist(), end.tolist(), owner.tolist(), strict=True):
        if size + 2 * (e - p) > LETTERS:
            made.append(ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING))
            size = 0
        made[-1].add_word(whole[2 * p : 2 * e], (e - p, o))
        size += 2 * (e - p)
    for a in made:
        a.make_automaton()
    return whole, made


def _lookup(h, c, owner, a, b):
    """Owners of the keys (a, b) by the sorted keys (h, c); no owner: the largest long."""
    none = np.iinfo(np.int64).max
    out = np.full(len(a), none)
    if not len(h):
        return out
    k = np.searchsorted(h, a)
    todo = np.arange(len(a))
    while len(todo):  # equal first halves, if any, lie side by side
        k, todo = k[k < len(h)], todo[k < len(h)]
        same = h[k] == a[todo]
        k, todo = k[same], todo[same]
        hit = c[k] == b[todo]
        out[todo[hit]] = owner[k[hit]]
        k, todo = k[~hit] + 1, todo[~hit]
    return out


def dedup_shard(ids: np.ndarray, w: Words, h: np.ndarray, c: np.ndarray, owner: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which words of a shard's documents go, given its recurring segments (h, -1) and windows (h, c), sorted, and their owners."""
    n = len(w.start)
    whole, made = automata(w, *phrases(w, h, c, owner, width)) if n else ("", [])
    starts, lengths = [], []
    lo, hi = w.bounds[:-1].tolist(), w.bounds[1:].tolist()
    for d, i in enumerate(ids.tolist()):
        letters = whole[2 * lo[d] : 2 * hi[d]]
        for automaton in made:
            for e, (size, owner_) in automaton.iter(letters):
                if owner_ < i:
                    starts.append(lo[d] + (e + 1) // 2 - size)
                    lengths.append(size)
    return cover(np.array(starts, np.int64), np.array(lengths, np.int64), n)


def kept_text(w: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the words left of each text, joined by one space."""
    n = len(w.data)
    out = np.empty(n + 1, np.uint8)
    out[:n], out[n] = w.data, 0x20
    ok = ~gone
    s, e, t = w.start[ok], w.end[ok], w.text[ok]
    last = np.ones(len(s), bool)
    last[:-1] = t[1:] != t[:-1]
    out[e[~last]] = 0x20
    stop = e + ~last
    d = np.zeros(n + 2, np.int8)
    d[s] += 1
    np.add.at(d, stop, -1)
    mask = np.cumsum(d[: n + 1], dtype=np.int8) > 0
    ends = np.zeros(n + 2, np.int64)
    np.cumsum(mask, out=ends[1:])
    return out[mask], ends[w.offsets]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]) for each row."""
    prepare(docs.sparkSession)
    release(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    docs, nameless = rows.where("i is not null"), rows.where("i is null")
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = int(size // SHARD_BYTES) + 1
    found = Confirmed(docs, width, shards)
    seen = found.seen
    release(docs.sparkSession)
    kinds = [(id_col, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * keep_text
    schema = ", ".join(f"`{n}` {'long' if t == pa.int64() else 'string'}" for n, t in kinds)

    def answer(ids, w: Words, gone: np.ndarray) -> pa.RecordBatch:
        b, off = kept_text(w, gone)
        mem = memoryview(b)
        sha = [hashlib.sha256(mem[x:y]).hexdigest() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        cols = [pa.array(ids, pa.int64()), pa.array(np.diff(w.bounds)), pa.array(counts_between(gone, w.bounds)), pa.array(sha)]
        if keep_text:
            cols.append(pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(b.tobytes())]).cast(pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=[n for n, _ in kinds])

    def busy(w: Words) -> np.ndarray:
        """Texts with candidates."""
        at, _, g, _ = _segments(w, width)
        out = np.zeros(len(w.bounds) - 1, bool)
        out[w.text[at[seen.value.has(g)]]] = True
        return out

    def alone(batch):
        out = []
        for ids, w in _each(batch, "i", "t"):
            some = ~busy(w)
            if some.all():
                out.append(answer(ids, w, np.zeros(len(w.start), bool)))
            elif some.any():
                out.append(answer(ids, w, np.zeros(len(w.start), bool)).filter(pa.array(some)))
        return pa.Table.from_batches(out) if out else None

    def deal(batch):
        at = np.flatnonzero(np.concatenate([busy(w) for _, w in _each(batch, "i", "t")]))
        ids = batch.column("i").take(pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array(_shard(ids.to_numpy(zero_copy_only=False), shards).astype(np.int32)), ids, batch.column("t").take(pa.array(at))], names=["s", "i", "t"])

    def one(key, left, right):
        h, c, own = u64(right.column("h")), right.column("c").to_numpy().astype(np.int64), right.column("owner").to_numpy()
        o = np.lexsort((c, h))
        h, c, own = h[o], c[o], own[o]
        out = []
        for batch in left.combine_chunks().to_batches():
            out += [answer(ids, w, dedup_shard(ids, w, h, c, own, width)) for ids, w in _each(batch, "i", "t")]
        return pa.Table.from_batches(out, pa.schema(kinds))

    dealt = map_arrow(docs, deal, "s int, i long, t string", "t").groupBy("s").cogroup(found.rows.groupBy("s")).applyInArrow(one, schema)

    def whole(batch):
        ids, data, off = batch.column("i").cast(pa.int64()), *text_bytes(batch.column("t"))
        w = [Words(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)]
        at = [i for i, _ in slices(off)]
        return pa.Table.from_batches([answer(ids[i : i + len(x.bounds) - 1], x, np.zeros(len(x.start), bool)) for i, x in zip(at, w, strict=True)])

    return map_arrow(docs, alone, schema, "t").unionByName(dealt).unionByName(map_arrow(nameless, whole, schema, "t"))
