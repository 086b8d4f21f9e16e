"""Benchmark decontamination by suffix arrays.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is ``width`` consecutive words of an item; an item of fewer
words (but not none) is one window.  Every batch of documents is a shard with its own suffix array: the suffixes whose first words start
some item suffix, sorted by their first ``width`` words.  Every item suffix is binary-searched in it, which gives all its occurrences;
occurrences that follow one another in both texts join to the longest verbatim matches.

Items go to the workers in blocks of ``BLOCK_WORDS`` words at most, one pass of the same stage for each block.  No shuffle takes place.
Defined cases: null or empty text has no words, is never hit and hits nothing; items of one id are one item; an empty benchmark hits
nothing; documents of one id, or without one, are answered each, items without an id are left out; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, unused, with_fields
from .wordcode import ALNUM, Table, U, Words, counts_between, cover, grams, ranges, slices, text_bytes

WIDTH = 10
BLOCK_WORDS = 2_000_000
LEAD = 4


def _compare(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """-1, 0, 1 for rows of a against rows of b, over the first ``length`` columns."""
    off = (a != b) & (np.arange(a.shape[1]) < length[:, None])
    any_, at = off.any(1), off.argmax(1)
    r = np.arange(len(a))
    return np.where(any_, np.where(a[r, at] < b[r, at], -1, 1), 0)


class Items:
    """The item suffixes of a block: their first words, how many must match, their item and place."""

    def __init__(self, ids: list[int], texts: list[str | None], width: int):
        col = pa.array([t or "" for t in texts], pa.large_string())
        data, off = text_bytes(col)
        w = Words(data, off, ALNUM, lower=True)
        n = np.diff(w.bounds)
        count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
        item = np.repeat(np.arange(len(n)), count)
        self.place = ranges(np.zeros(len(n), np.int64), count)
        at = w.bounds[:-1][item] + self.place
        self.length = np.minimum(width, n[item])
        padded = np.concatenate([w.h, np.zeros(width, U)])
        self.words = padded[at[:, None] + np.arange(width)]
        self.words[np.arange(width) >= self.length[:, None]] = 0
        self.item = np.array(ids, np.int64)[item] if len(ids) else np.zeros(0, np.int64)
        self.width = width
        self.lead = min(LEAD, int(self.length.min())) if len(item) else 1
        self.leads = np.unique(grams(padded, self.lead)[at]) if len(item) else np.zeros(0, U)
        self.table: Table | None = None

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(item suffix, word position) of all occurrences in a shard."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.item) or not len(w.h):
            return none
        if self.table is None:
            self.table = Table(len(self.leads))
            self.table.put(self.leads, np.arange(len(self.leads)))
        # suffix array of the suffixes that can match
        g = grams(w.h, self.lead)
        pos = np.flatnonzero(self.table.get(g) >= 0)
        if not len(pos):
            return none
        stop = w.bounds[1:][np.searchsorted(w.bounds[1:], pos, side="right")]
        padded = np.concatenate([w.h, np.zeros(self.width, U)])
        rows = padded[pos[:, None] + np.arange(self.width)]
        rows[pos[:, None] + np.arange(self.width) >= stop[:, None]] = 0
        order = np.lexsort(rows.T[::-1])
        pos, rows = pos[order], rows[order]
        ends = []
        for upper in (0, 1):
            lo, hi = np.zeros(len(self.item), np.int64), np.full(len(self.item), len(pos))
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                less = _compare(rows[mid], self.words[open_], self.length[open_]) < upper
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            ends.append(lo)
        n = ends[1] - ends[0]
        return np.repeat(np.arange(len(n)), n), pos[ranges(ends[0], n)]


def _blocks(bench: DataFrame, id_col: str, text_col: str, width: int):
    """Items of the benchmark in blocks of bounded size, read one partition at a time."""
    ids, texts, size = [], [], 0
    rows = bench.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    for r in rows.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t) // 2 + 1
        if size >= BLOCK_WORDS:
            yield Items(ids, texts, width)
            ids, texts, size = [], [], 0
    yield Items(ids, texts, width)


NAMES = ("_n_words", "_n_hit", "_items", "_longest", "_matches")


def outputs(docs: DataFrame) -> list[str]:
    """The names that mark_contamination() gives its columns beside those of docs, in the order of NAMES."""
    return unused(docs.columns, *NAMES)


def mark_contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """All rows of docs as they are, with ``_n_words``, ``_n_hit``, ``_items`` (sorted item ids), ``_longest`` (words of the longest verbatim match) and ``_matches`` (item, item word, document word, words: the maximal matches); where docs has such a name, see ``outputs``."""
    out = docs
    names = dict(zip(NAMES, outputs(docs), strict=True))
    fields = "struct<item:bigint,item_at:bigint,doc_at:bigint,words:bigint>"
    types = [pa.field(x, pa.int64()) for x in ("item", "item_at", "doc_at", "words")]
    for items in _blocks(bench, item_col, item_text, width):
        block = docs.sparkSession.sparkContext.broadcast(items)
        first = out is docs
        added = zip(names.values(), ("long", "long", "array<long>", "long", f"array<{fields}>"), strict=True)
        schema = with_fields(out, *added) if first else out.schema

        def step(batch, block=block, first=first):
            data, off = text_bytes(batch.column(text_col))
            made = {k: [] for k in ("_n_words", "_n_hit", "_items", "_longest", "_matches")}
            for i, j in slices(off):
                w, q = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM, lower=True), block.value
                suffix, pos = q.search(w)
                text = np.searchsorted(w.bounds, pos, side="right") - 1
                item, place, length = q.item[suffix], q.place[suffix], q.length[suffix]
                # matches that follow one another in both texts
                o = np.lexsort((pos, pos - place, item, text))
                t, it, pl, p, ln = text[o], item[o], place[o], pos[o], length[o]
                new = np.ones(len(o), bool)
                new[1:] = (t[1:] != t[:-1]) | (it[1:] != it[:-1]) | (p[1:] != p[:-1] + 1) | (pl[1:] != pl[:-1] + 1)
                at = np.flatnonzero(new)
                end = np.concatenate([at[1:], [len(o)]])[: len(at)] - 1
                mt, mi, mp, md = t[at], it[at], pl[at], p[at]
                ml = p[end] - p[at] + ln[end]
                if not first:  # earlier blocks' matches
                    old = batch.column(names["_matches"])[i:j]
                    flat, k = old.flatten(), np.repeat(np.arange(j - i), [len(x) for x in old])
                    get = lambda name, flat=flat: flat.field(name).to_numpy()
                    mt, mi, mp, md, ml = (np.concatenate(x) for x in ((k, mt), (get("item"), mi), (get("item_at"), mp), (get("doc_at") + w.bounds[:-1][k], md), (get("words"), ml)))
                    o = np.lexsort((md, mi, mt))
                    mt, mi, mp, md, ml = mt[o], mi[o], mp[o], md[o], ml[o]
                n = np.bincount(mt, minlength=j - i)
                o32 = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                made["_n_words"].append(pa.array(np.diff(w.bounds)))
                made["_n_hit"].append(pa.array(counts_between(cover(md, ml, len(w.h)), w.bounds)))
                longest = np.zeros(j - i, np.int64)
                np.maximum.at(longest, mt, ml)
                made["_longest"].append(pa.array(longest))
                made["_matches"].append(pa.ListArray.from_arrays(pa.array(o32), pa.StructArray.from_arrays([pa.array(x) for x in (mi, mp, md - w.bounds[:-1][mt], ml)], fields=types)))
                pair = np.unique(np.stack([mt, mi], 1), axis=0) if len(mt) else np.zeros((0, 2), np.int64)
                o32 = np.concatenate([[0], np.cumsum(np.bincount(pair[:, 0], minlength=j - i))]).astype(np.int32)
                made["_items"].append(pa.ListArray.from_arrays(pa.array(o32), pa.array(pair[:, 1])))
            cols = {n: batch.column(n) for n in batch.schema.names} | {names[k]: pa.chunked_array(v).combine_chunks() for k, v in made.items()}
            return pa.Table.from_pydict(cols)

        out = map_arrow(out, step, schema, text_col)
    return out


def items_digest(items) -> str:
    """Lowercase hex SHA-256 of the ids, sorted as strings, comma-joined."""
    return hashlib.sha256(",".join(sorted(str(x) for x in items)).encode()).hexdigest()


def remove_contaminated(docs: DataFrame, bench: DataFrame, **names) -> DataFrame:
    """The rows of docs that no window of the benchmark occurs in, with their columns."""
    hit = outputs(docs)[NAMES.index("_n_hit")]
    return mark_contamination(docs, bench, **names).where(F.col(hit) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
