"""Importance resampling towards a target: hashed n-gram weights of whole texts, the best of which are drawn with Gumbel noise.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A feature is a run of 1 to ``width`` words joined by one space; its
bucket is the crc32 of its bytes modulo ``buckets``.  Texts longer than ``LONG`` bytes are split at word boundaries into chunks of
``CHUNK`` words, each with the ``width - 1`` words after them; a chunk owns the features that start in its own words, so every
feature is counted once.  Chunks, a table in the shared folder, are dealt over all tasks by hash, so one very long text is no task of
its own; counts of buckets are added up in each task before the shuffle, and weights of chunks are summed by document.

Ranks come from ranges of scores that tasks sort and number for themselves: no task sees all documents.

Defined cases: null or empty text has no features and weight 0; a document is a row, also if its id is repeated or null (null ids come
last among equal scores and hash like the empty text); an empty target or source gives the smoothed gains; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, map_arrow, pieces, prepare, trim
from .wordcode import _LOWER, ALNUM, Words, gram_starts, ranges, slices, text_bytes

WIDTH, BUCKETS = 1, 10_000
CHUNK, LONG = 4096, 64 << 10

with np.errstate(over="ignore"):
    _CRC = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1).astype(np.uint32)


def crc32_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray, most: int = 96) -> np.ndarray:
    """Unsigned crc32 of spans of bytes: byte by byte for all spans at once; the few longer than ``most`` one by one."""
    out = np.zeros(len(start), np.uint32)
    short = np.minimum(length, most + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]
    at, n = start[order], short[order]
    longer = int(np.searchsorted(-n.astype(np.int16), -most, side="left"))
    for k in order[:longer]:
        out[k] = zlib.crc32(data[start[k] : start[k] + length[k]].tobytes())
    order, at, n = order[longer:], at[longer:], n[longer:]
    left = len(n) - np.searchsorted(n[::-1], np.arange(most), side="right")  # spans of more than k bytes
    crc = np.full(len(n), 0xFFFFFFFF, np.uint32)
    for k, live in enumerate(left):
        if not live:
            break
        c = crc[:live]
        crc[:live] = _CRC[(c ^ data[at[:live] + k]) & 0xFF] ^ (c >> np.uint32(8))
    out[order] = ~crc
    return out


def _features(data: np.ndarray, off: np.ndarray, own, width: int, buckets: int):
    """(words of each text, [(bucket, text) of its runs of 1, 2.. words]); ``own``: how many words of each text may start a run, or None for all."""
    w = Words(_LOWER[data], off, ALNUM, hashes=False)
    data, start, size = w.data, w.start, w.end - w.start
    if width > 1:  # words joined by one space
        joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        at = np.cumsum(size + 1) - size - 1
        joined[ranges(at, size)] = data[ranges(start, size)]
        data, start = joined, at
    text = w.text
    n_words = np.diff(w.bounds)
    first = np.ones(len(start), bool) if own is None else np.arange(len(start)) - w.bounds[:-1][text] < own[text]
    runs = []
    for n in range(1, width + 1):
        p = np.flatnonzero(gram_starts(w.bounds, n, len(start)) & first[: max(0, len(start) - n + 1)])
        crc = crc32_spans(data, start[p], start[p + n - 1] + size[p + n - 1] - start[p])
        runs.append(((crc % np.uint32(buckets)).astype(np.int64), text[p]))
    return n_words, runs


def _parts(batch, text_col: str, width: int, buckets: int):
    """The features of a batch's texts, slice by slice, so memory is bounded by a slice or one chunk or text of at most LONG bytes."""
    data, off = text_bytes(batch.column(text_col))
    own = batch.column("_own").to_numpy(zero_copy_only=False) if "_own" in batch.schema.names else None
    for i, j in slices(off):
        yield j - i, None if own is None else own[i:j], *_features(data[off[i] : off[j]], off[i : j + 1] - off[i], None if own is None else own[i:j], width, buckets)


def chunks(docs: DataFrame, text_col: str = "text", words: int = CHUNK, width: int = WIDTH) -> DataFrame:
    """(row, id, chunk, text, own): each text cut at word boundaries into ``words`` own words and the ``width - 1`` after them; a text without words has no chunk.

    Rows are numbered as they stand, so the table is written before it is used: a lost task must not number them anew.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "_id", F.col(text_col).alias("_text"))

    def step(batch):
        out = {"_row": [], "_id": [], "_chunk": [], "_own": [], "_text": []}
        ids, numbers = batch.column("_id"), batch.column("_row").to_numpy()
        for k in range(batch.num_rows):
            data, off = text_bytes(batch.column("_text").slice(k, 1))
            w = Words(data, off, ALNUM, hashes=False)
            n = len(w.start)
            for c, a in enumerate(range(0, n, words)):
                own = min(words, n - a)
                out["_row"].append(numbers[k])
                out["_id"].append(ids[k].as_py())
                out["_chunk"].append(c)
                out["_own"].append(own)
                out["_text"].append(data[w.start[a] : w.end[min(a + own + width - 1, n) - 1]].tobytes().decode())
        types = (pa.int64(), ids.type, pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    kind = dict(rows.dtypes)["_id"]
    made = map_arrow(rows, step, f"_row long, _id {kind}, _chunk long, _own long, _text string", "_text")
    return cut(made.repartition("_row", "_chunk"))


class Corpus:
    """The texts of a table: short ones where they stand, and the chunks of long ones."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int):
        rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        self.short = rows.where(F.octet_length("_text") <= LONG)
        # texts without a word have no chunk; a single byte of a word is enough to be one
        has = F.col("_text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
        self.blank = rows.where((F.octet_length("_text") > LONG) & ~has)
        self.long = chunks(rows.where((F.octet_length("_text") > LONG) & has), "_text", CHUNK, width)


def bucket_counts(corpus: Corpus, width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds over the whole corpus; tasks send one row for each of their buckets, the driver gets ``buckets`` at most."""

    def step(batches):
        total = np.zeros(buckets, np.int64)
        for batch in (x for b in batches for x in pieces(b, "_text")):
            for _, _, _, runs in _parts(batch, "_text", width, buckets):
                for bucket, _ in runs:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
        trim()

    prepare(corpus.short.sparkSession)
    parts = [x.mapInArrow(step, "bucket long, n long") for x in (corpus.short.select("_text"), corpus.long.select("_own", "_text"))]
    out = np.zeros(buckets, np.int64)
    for r in parts[0].union(parts[1]).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for its counts s, t and their sums S, T over B buckets."""
    b = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weigh(corpus: Corpus, gain: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(_id, _n_words, _n_features, _weight) of every document: the sum of its features' gains."""
    spark = corpus.short.sparkSession
    table = spark.sparkContext.broadcast(gain)  # one number for each bucket

    def step(batch):
        made = []
        for n, own, words, runs in _parts(batch, "_text", width, len(table.value)):
            features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for bucket, text in runs:
                features += np.bincount(text, minlength=n)
                weight += np.bincount(text, weights=table.value[bucket], minlength=n).astype(np.int64)
            made.append((words if own is None else own, features, weight))
        keep = [c for c in ("_row", "_id") if c in batch.schema.names]
        sums = [pa.array(np.concatenate(x)) for x in zip(*made, strict=True)]
        return pa.table([batch.column(c) for c in keep] + sums, keep + ["_n_words", "_n_features", "_weight"])

    kind = dict(corpus.short.dtypes)["_id"]
    sums = "_n_words long, _n_features long, _weight long"
    short = map_arrow(corpus.short, step, f"_id {kind}, {sums}", "_text")
    parts = map_arrow(corpus.long.select("_row", "_id", "_own", "_text"), step, f"_row long, _id {kind}, {sums}", "_text")
    names = ("_n_words", "_n_features", "_weight")
    long = parts.groupBy("_row").agg(F.first("_id").alias("_id"), *[F.sum(c).alias(c) for c in names]).select("_id", *names)
    blank = corpus.blank.select("_id", *[F.lit(0).cast("long").alias(c) for c in names])
    return short.unionByName(long).unionByName(blank)


def draw(weighted: DataFrame, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """All rows with ``_score`` (weight plus Gumbel noise from a hash of the id) and ``_rank``: of the N documents of ``least`` words or more, the floor(percent N / 100) of the highest scores (ties: smaller ids) get 1, 2.., all others null."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = cut(weighted.withColumn("_score", F.col("_weight") + noise))
    able = rows.where(F.col("_n_words") >= least)
    most = able.count() * percent // 100
    order = [F.desc("_score"), F.asc_nulls_last("_id"), F.asc("_tie")]
    own = able.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    own = cut(own.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1}))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("_p").agg(F.max("_i").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_i")
    ranked = own.join(F.broadcast(sizes), "_p").withColumn("_rank", F.when(place <= most, place)).select(*rows.columns, "_rank")  # a row for each partition
    return ranked.unionByName(rows.where(F.col("_n_words") < least).withColumn("_rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", width: int = WIDTH, buckets: int = BUCKETS, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """(id, _n_words, _n_features, _weight, _score, _rank) of every row of docs, weighed towards the texts of target."""
    source = Corpus(docs, id_col, text_col, width)
    gain = gains(bucket_counts(source, width, buckets), bucket_counts(Corpus(target, target_id, target_text, width), width, buckets))
    return draw(weigh(source, gain, width), percent, least, seed).withColumnRenamed("_id", id_col)
