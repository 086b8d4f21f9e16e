"""Harmonic packing of documents into sequences of fixed capacity.

A document's ids (with the end id) are cut from the front into pieces whose lengths belong to reciprocal-capacity classes:
whole sequences, then again and again the largest floor(capacity / k) that fits (k up to ``MOST``); what is then left, shorter than
capacity / MOST, is a class of its exact length.  A class's pieces have one length, so its bins hold a fixed number of pieces and each
worker fills them on its own, in the order of its rows; a full bin lacks fewer tokens than it has pieces.  At a worker's end the pieces of
its open bins (less than one bin of each class) are cut into powers of two, and those fill bins the same way; a last bin of these is split
into sequences of powers of two, which need no padding.

No shuffle takes place; a worker holds its open bins only.
Defined cases: null text is empty, and an empty document has the end id alone; rows of one id, or without one, are packed each; other columns are ignored;
texts that hold the tokenizer's special strings are encoded whole, as the tokenizer does.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, prepare
from .wordcode import _BYTE_LOWER, NON_SPACE, Table, U, Words, ranges, slices, text_bytes

CAPACITY, END_ID = 4096, 2
MOST = 32
#: words that a worker remembers the ids of
MEMORY = 1_500_000


class Encoder:
    """Ids of whole texts by a tokenizer that drops white space: words are encoded once and remembered by hash.

    White space, and a border between an ASCII letter or digit and ASCII punctuation other than the apostrophe, always separates tokens of
    a tokenizer whose pre-tokenizer matches runs of letters, single digits and runs of other characters; so texts are cut there.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [s.content.encode() for s in self.tok.get_added_tokens_decoder().values()]
        kind = np.full(256, 3, np.uint8)  # 0 space, 1 ASCII letter or digit, 2 punctuation, 3 anything else
        kind[~NON_SPACE] = 0
        kind[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
        kind[[x for x in range(0x21, 0x7F) if kind[x] == 3 and x != 0x27]] = 2
        self.kind = kind
        self.forget()

    def forget(self):
        self.table, self.at, self.flat, self.n = Table(1 << 14), [np.zeros(1, np.int64)], [], 0
        self._off, self._ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str], h: np.ndarray):
        got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        self.table.put(h, np.arange(self.n, self.n + len(h)))
        self.n += len(h)
        off = np.cumsum([len(x) for x in got]) + self._off[-1]
        self._off = np.concatenate([self._off, off])
        self._ids = np.concatenate([self._ids, np.array([y for x in got for y in x], np.uint32)])

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        w = Words(data, offsets, hashes=False)
        if not len(data):
            w.h = np.zeros(0, U)
            return w
        k = self.kind[data]
        border = np.flatnonzero((k[:-1] == 1) & (k[1:] == 2) | (k[:-1] == 2) & (k[1:] == 1)) + 1
        border = border[~np.isin(border, offsets)]
        w.start = np.sort(np.concatenate([w.start, border]))
        w.end = np.sort(np.concatenate([w.end, border]))
        w.bounds = np.searchsorted(w.start, offsets, side="left")
        w.bounds[-1] = len(w.start)
        w.h = w._hash(_BYTE_LOWER)
        return w

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; bounds)."""
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            ids = [np.array(self.tok.encode(t, add_special_tokens=False).ids + [end], np.uint32) for t in texts]
            return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        w = self._pieces(data, offsets)
        if self.n > MEMORY:
            self.forget()
        k = self.table.get(w.h)
        if (miss := np.flatnonzero(k < 0)).size:
            h, one = np.unique(w.h[miss], return_index=True)
            first = miss[one]
            self._learn([raw[a:b].decode() for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)], h)
            k[miss] = self.table.get(w.h[miss])
        length = self._off[k + 1] - self._off[k]
        total = np.concatenate([[0], np.cumsum(length)])
        bounds = total[w.bounds] + np.arange(len(offsets))
        out = np.full(bounds[-1], end, np.uint32)
        body = np.ones(len(out), bool)
        body[bounds[1:] - 1] = False
        out[body] = self._ids[ranges(self._off[k], length)]
        return out, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def class_lengths(capacity: int = CAPACITY, most: int = MOST) -> np.ndarray:
    """The lengths of the reciprocal classes, longest first."""
    return np.unique(capacity // np.arange(1, most + 1))[::-1]


def cuts(n: int, lengths: list[int], capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    for x in lengths:
        while x <= n:
            out.append(x)
            n -= x
    return out + [n] * (n > 0)


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Bins:
    """Bins of one worker, by class."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next, self.open = capacity, base, {}

    def add(self, piece: tuple, length: int):
        """Puts a piece into its class's open bin; a full bin comes back as (sequence, pieces)."""
        have = self.open.setdefault(length, [])
        have.append(piece)
        if len(have) == self.capacity // length:
            del self.open[length]
            return self._close(have)
        return None

    def _close(self, pieces):
        self.next += 1
        return self.next - 1, pieces

    def rest(self, recut):
        """What is open at the end: cut into powers of two, packed once more, and closed in powers of two."""
        left = [p for length in sorted(self.open, reverse=True) for p in self.open[length]]
        self.open = {}
        for p in left:
            for q in recut(p):
                if full := self.add(q, q[2]):
                    yield full
        for length in sorted(self.open, reverse=True):
            have, at = self.open[length], 0
            for n in powers(len(have)):
                yield self._close(have[at : at + n])
                at += n
        self.open = {}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, most: int = MOST, keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for each piece of each row."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"`{n}` long" for n in names) + ", ids array<int>" * keep_ids
    lengths = class_lengths(capacity, most).tolist()

    def run(batches):
        enc = encoder(tokenizer)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def place(full):
            at = 0
            for p in full[1]:
                rows.append((p[0], p[1], p[2], p[3], p[4], full[0], at, p[5]))
                at += p[2]

        def flush():
            cols = list(zip(*rows, strict=True))
            b = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array([np.frombuffer(x, np.uint32) for x in cols[7]], pa.list_(pa.int32()))] * keep_ids
            rows.clear()
            return pa.RecordBatch.from_arrays(b, names=names + ["ids"] * keep_ids)

        def recut(p):
            at = 0
            for n in powers(p[2]):
                ids = p[5][4 * at : 4 * (at + n)]
                yield p[0], p[1] + at, n, zlib.crc32(ids), p[4], ids
                at += n

        for batch in batches:
            data, off = text_bytes(batch.column("t"))
            ids = batch.column("i").to_pylist()
            for i, j in slices(off):
                tokens, bounds = enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i], end_id)
                raw, bounds = tokens.tobytes(), bounds.tolist()
                for d in range(j - i):
                    lo, n, at = bounds[d], bounds[d + 1] - bounds[d], 0
                    for x in cuts(n, lengths, capacity):
                        part = raw[4 * (lo + at) : 4 * (lo + at + x)]
                        if full := bins.add((ids[i + d], at, x, zlib.crc32(part), n, part), x):
                            place(full)
                        at += x
                if len(rows) > 20_000:
                    yield flush()
        for full in bins.rest(recut):
            place(full)
        if rows:
            yield flush()

    return docs.mapInArrow(run, schema)
