"""Nearest neighbours by multi-index hashing.

A rotation is learned on at most ``SAMPLE`` vectors: random orthogonal frames, each turned so that the signs of the rotated vectors are close to
the vectors (alternating Procrustes steps); the signs give a code of ``BITS`` bits, split into substrings of ``PART`` bits.  A query's
radius r is where a ``SHARE`` of the sample's codes (``LEAST`` codes at least) lies within it.  Every task indexes its own rows: for each
substring, postings by value.  By pigeonhole a code within r agrees with the query's in one substring up to r / parts bits, so the buckets
within that distance are probed, the whole codes are compared, and every code within r is reranked by the float vectors in double precision.
The tasks' best are merged for each query by a grouped top-k.

Queries go to the workers in blocks of ``QUERY_BLOCK``; each block is one pass whose results are written to the shared folder, so the plan doesn't
grow with the queries and a lost executor costs one pass at most.  Equal vectors of a hot value stay rows of their own task, of which each hands
on k at most, so no task gathers them.
Defined cases: vectors that are null, empty, zero, of another length than the commonest of all in the table (the shorter one, if two
are as common), or hold null or non-finite components take no part, neither as query nor as candidate, nor do rows without an id; rows of one id are
one candidate and one query, and their distance is the smallest of any two of their vectors; a query's own id is never its neighbour;
ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import folder, prepare, sample_rows

BITS, PART, SAMPLE, SHARE, LEAST = 256, 8, 4096, 0.06, 200
QUERY_BLOCK = 4096
#: rows that are compared with a block of queries at once
ROWS = 4096
K = 10
_POP = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def vectors(col, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the valid vectors of this length, their components as doubles)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    none = np.zeros(0, np.int64), np.zeros((0, width))
    if not len(col):
        return none
    off = col.offsets.to_numpy()
    size = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, np.diff(off))
    at = np.flatnonzero(size == width)
    if not len(at):
        return none
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[off[:-1][at][:, None] + np.arange(width)]
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], x[good]


class Coder:
    """The learned rotation, and the sample's codes."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, seed: int = 5, rounds: int = 12):
        self.dim = sample.shape[1]
        self.center = sample.mean(0)
        x = sample - self.center
        scale = np.sqrt((x**2).sum(1).mean()) or 1.0
        x = x / scale
        r = np.random.default_rng(seed)
        frames, left = [], bits
        while left > 0:
            q = np.linalg.qr(r.normal(size=(self.dim, self.dim)))[0]
            for _ in range(rounds):
                b = np.where(x @ q >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(x.T @ b)
                q = u @ v
            frames.append(q[:, : min(left, self.dim)])
            left -= self.dim
        self.turn = np.concatenate(frames, 1)
        self.parts = bits // PART
        self.codes = self.code(sample)

    def code(self, x: np.ndarray) -> np.ndarray:
        """Bytes of the codes, one substring each."""
        return np.packbits((x - self.center) @ self.turn >= 0, axis=1)

    def radius(self, code: np.ndarray, share: float = SHARE, least: int = LEAST) -> np.ndarray:
        """For each query code: the distance within which enough of the sample lies."""
        n = len(self.codes)
        want = min(n, max(int(np.ceil(share * n)), least)) - 1
        d = distance(code, self.codes)
        return np.partition(d, want, axis=1)[:, want] if n else np.zeros(len(code), np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all codes of a from all of b."""
    a, b = (np.ascontiguousarray(np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))).view(np.uint64) for x in (a, b))
    out = np.zeros((len(a), len(b)), np.int32)
    for i in range(a.shape[1]):
        out += np.bitwise_count(a[:, i][:, None] ^ b[:, i])
    return out


class Index:
    """Postings of one chunk of codes: for each substring, places by value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, p], kind="stable") for p in range(codes.shape[1])]
        self.bounds = [np.searchsorted(codes[o, p], np.arange(257)) for p, o in enumerate(self.order)]
        self.long = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of every code within the radius."""
        parts = self.codes.shape[1]
        base, more = divmod(int(radius), parts)  # the first more + 1 substrings up to base, the others up to base - 1
        seen = np.zeros(len(self.codes), bool)
        for p in range(parts):
            most = base if p <= more else base - 1
            if most < 0:
                break
            for v in np.flatnonzero(_POP[np.arange(256) ^ code[p]] <= most).tolist():
                lo, hi = self.bounds[p][v], self.bounds[p][v + 1]
                if lo < hi:
                    seen[self.order[p][lo:hi]] = True
            if seen.all():
                break
        at = np.flatnonzero(seen)
        own = np.ascontiguousarray(np.pad(code, (0, -len(code) % 8))).view(np.uint64)
        return at[np.bitwise_count(self.long[at] ^ own).sum(1, dtype=np.int64) <= radius]


def _first(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest different ids, nearest first, ties to the smaller id."""
    o = np.lexsort((ids, d))
    return o[np.sort(np.unique(ids[o], return_index=True)[1])[:k]]


def _best(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, q_ids, q, q_codes, radii, k: int):
    """(query, id, score) of each query's k best in a chunk."""
    index, out = Index(codes), []
    for i in range(len(q_ids)):
        at = index.within(q_codes[i], radii[i])
        at = at[ids[at] != q_ids[i]]
        if len(at):
            d = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
            near = np.flatnonzero(d <= np.partition(d, 4 * k - 1)[4 * k - 1]) if len(at) > 4 * k else np.arange(len(at))
            o = near[_first(ids[at[near]], d[near], k)]
            if len(o) < k and len(near) < len(at):  # repeated ids
                o = _first(ids[at], d, k)
            out.append((np.full(len(o), q_ids[i]), ids[at[o]], d[o]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None


def _merged(both: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of (query, id, score), one row for each pair of ids."""
    o = np.lexsort((both[2], both[1], both[0]))
    both = [c[o] for c in both]
    new = np.ones(len(o), bool)
    new[1:] = (both[0][1:] != both[0][:-1]) | (both[1][1:] != both[1][:-1])
    both = [c[new] for c in both]
    o = np.lexsort((both[1], both[2], both[0]))
    both = [c[o] for c in both]
    return [c[np.arange(len(o)) - np.searchsorted(both[0], both[0]) < k] for c in both]


def nearest(table: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found of each query, nearest first."""
    spark = table.sparkSession
    prepare(spark)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v")).where("i is not null and size(v) > 0")
    table, queries = pick(table), pick(queries)
    schema = f"query_id long, `{id_col}` long, score double"
    none = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    common = table.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return none
    dim = common.d
    table, queries = table.where(F.size("v") == dim), queries.where(F.size("v") == dim)
    _, x = vectors(sample_rows(table, "i", sample).column("v"), dim)
    if not len(x):
        return none
    coder = Coder(x)
    wide = spark.sparkContext.broadcast(coder)

    def blocks():
        ids, vecs = [], []
        for r in queries.toLocalIterator():
            v = np.array([np.nan if y is None else y for y in r.v])
            if np.isfinite(v).all() and v.any():
                ids.append(r.i)
                vecs.append(v)
            if len(ids) == QUERY_BLOCK:
                yield np.array(ids), np.array(vecs)
                ids, vecs = [], []
        if ids:
            yield np.array(ids), np.array(vecs)

    found = f"{folder(spark)}/cloudgrid-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(found)
    for q_ids, q in blocks():
        codes = coder.code(q)
        block = spark.sparkContext.broadcast((q_ids, q, codes, coder.radius(codes, share)))

        def run(batches, block=block):
            best = None
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def work(best):
                ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                held.clear()
                got = _best(ids, x, wide.value.code(x), *block.value, k)
                if got is None:
                    return best
                return _merged(got if best is None else [np.concatenate(c) for c in zip(best, got, strict=True)], k)

            for b in batches:
                at, x = vectors(b.column("v"), dim)
                if len(at):
                    held.append((b.column("i").to_numpy(zero_copy_only=False)[at], x))
                if sum(len(i) for i, _ in held) >= ROWS:
                    best = work(best)
            if held:
                best = work(best)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["query_id", id_col, "score"])

        table.mapInArrow(run, schema).write.mode("append").parquet(found)
        block.destroy()

    def top(key, t):
        q, i, d = _merged([t.column(c).to_numpy() for c in ("query_id", id_col, "score")], k)
        return pa.table({"query_id": pa.array(q), "rank": pa.array(np.arange(1, len(q) + 1, dtype=np.int32)), id_col: pa.array(i), "score": pa.array(d)})

    return spark.read.schema(schema).parquet(found).groupBy("query_id").applyInArrow(top, f"query_id long, rank int, `{id_col}` long, score double")
