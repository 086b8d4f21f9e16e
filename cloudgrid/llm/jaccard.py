"""N-gram Jaccard join by parity sketches.

The set of a document: hashes of its distinct ``width``-word shingles (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``; with fewer words, the
whole sequence as one).  Two sets link if 100 * intersection >= percent * union.  Equal sets are one node.

1. *sketch*: a set of size n lies in a size band, and each pair of linked sets in one band or two neighbouring ones.  For each of its two
   band pairs a set has a bit sketch that every shingle flips one bit of, so the sketches' Hamming distance never exceeds the symmetric
   difference.  The sketch is 2^64 bits wide, and is cut by hash into d + 1 + s segments, d being the largest symmetric difference
   that a link in that band pair allows; a segment is held as the XOR of the hashes of its set bits.  By pigeonhole linked sets agree in
   s + 1 segments at least.  Segments of few set bits, in which unrelated sets agree by chance, are left out where a set has no more than s of
   them (``segments_of``); a set with more is dealt again with another seed, beside its other segments (``SEEDS`` times; then it keeps all).
2. *join*: nodes that share a segment are tied if they may link by their sizes and long parity sketches (a bit for each shingle or more), first each to the smallest
   node it meets, then, in segments whose nodes that leaves apart, all of different classes (a forest of these ties, no list of pairs).
   Connected components of the ties hold all links, as a link's ends share a segment and pass the sketches.
3. *verify*: the nodes of a component are dealt into blocks bounded in nodes and bytes.  Within a block a pair not yet connected is
   compared by a long parity sketch first, then exactly, and a forest of the links is kept.  A component of several blocks goes on: the
   smallest nodes of its classes meet in blocks, as long as that joins classes; then all nodes outside its largest class meet all others
   of another class, block by block.  So a large group of near copies is not compared in all pairs, and no link between classes is lost.

Defined cases: null or empty text or text without words has an empty set, is alone, and counts 0 shingles; rows of one id are answered
each; a row with a null id links by its text, and its component is the smallest id there or, if none, null; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bloom, components, cut, drop, map_arrow, prepare, release
from .wordcode import U, Words, grams, i64, mix, ranges, slices, text_bytes, u64

WIDTH, PERCENT = 3, 90
#: standard deviations above the mean number of small segments that the spare ones allow; how often sets with more of them are dealt
SURE, SEEDS = 0.8, 8
#: nodes of a block in verification, and bytes of their sets
BLOCK, BLOCK_BYTES = 256, 32 << 20
#: rows of shared segments that are looked at in one call, about
ROWS = 4096
#: a class of more than one of so many rows is hot
HOT = 1024
#: 64-bit words of the long sketch, at least
SKETCH = 32


def sets_of(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, bounds)."""
    n = np.diff(w.bounds)
    size = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(size)])
    h = np.empty(at[-1], U)
    g = grams(w.h, width, 3)
    b, at_, long = w.bounds.tolist(), at.tolist(), (n >= width).tolist()
    for i, full in enumerate(long):
        if full:
            x = h[at_[i] : at_[i + 1]]
            x[:] = g[b[i] : b[i + 1] - width + 1]
            x.sort()
        elif at_[i + 1] > at_[i]:
            h[at_[i]] = grams(w.h[b[i] : b[i + 1]], b[i + 1] - b[i], 3 + 100 * (width - (b[i + 1] - b[i])))[0]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = at[:-1][size > 0]
    new[first] = True
    c = np.concatenate([[0], np.cumsum(new)])
    return h[new], c[at]


def bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the size bands: the sizes linked with a band's lie in it or in its neighbours."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def differences(b: np.ndarray, percent: int) -> np.ndarray:
    """For band pair i (bands i and i + 1): the largest symmetric difference of linked sets."""
    small = b[1:] - 1
    large = np.minimum(small * 100 // percent, np.append(b[2:], 1 << 62) - 1)
    return (small + large) * (100 - percent) // (100 + percent)


def segments_of(percent: int) -> tuple[np.ndarray, ...]:
    """(lower bounds of the bands; for each band pair: largest difference, spare segments, segments, bits that a segment must hold to stay).

    A segment must hold as many bits (3 at most) as there is a number of spare segments for, not above the others, with which most sets of
    the pair's least size have no more small ones.  The more bits, the fewer unrelated sets agree, as those that share some shingles do in segments of
    one or two.
    """
    low = bands(percent)
    d = differences(low, percent)
    spare, least = 3 + d // 12, np.ones(len(d), np.int64)
    for i in np.flatnonzero((d > 0) & (low[:-1] < 1 << 20)):
        more = np.arange(3, d[i] + 5)
        m = d[i] + 1 + more
        load = low[i] / m
        for bits in (3, 2):
            p = np.exp(-load) * sum(load**k / math.factorial(k) for k in range(bits))
            ok = np.flatnonzero(m * p + SURE * np.sqrt(m * p * (1 - p)) <= more)
            if len(ok):
                spare[i], least[i] = more[ok[0]], bits
                break
    last = np.flatnonzero(low[:-1] < 1 << 20)[-1]
    beyond = np.arange(len(d)) > last
    spare[beyond], least[beyond] = d[beyond] * spare[last] // max(d[last], 1) + 3, least[last]
    return low, d, spare, d + 1 + spare, least


def _segments(h: np.ndarray, bounds: np.ndarray, plan: tuple[np.ndarray, ...]):
    """(keys, set index) of the segments of all sets in both of their band pairs.

    Two linked sets in a band pair agree in s + 1 segments or more.  If one of them has s small ones at most, a segment that isn't small is among
    those, and both keep it; if both have more, they meet again with the next seed, and with the last one they keep all.  Where a link
    allows no difference, linked sets are equal, so one node, and need no key.
    """
    low, diff, spare, count, least = plan
    n = np.diff(bounds)
    band = np.searchsorted(low, np.maximum(n, 1), side="right") - 1
    keys, sets = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for back in (0, 1):
        pair = band - back
        of = np.flatnonzero((n > 0) & (pair >= 0) & (diff[np.maximum(pair, 0)] > 0))
        for seed in range(SEEDS):
            if not len(of):
                break
            p, size = pair[of], n[of]
            m = count[p]
            at = np.concatenate([[0], np.cumsum(m)])
            x = mix(h[ranges(bounds[:-1][of], size)] ^ (U(0x5BD1E995) + U(seed)))
            slot = np.repeat(at[:-1], size) + ((x >> U(32)) * np.repeat(m, size).astype(U) >> U(32)).astype(np.int64)
            seg = np.zeros(at[-1], U)
            np.bitwise_xor.at(seg, slot, mix(x))
            owner = np.repeat(np.arange(len(of)), m)
            small = np.bincount(slot, minlength=at[-1]) < least[p][owner]
            hollow = np.bincount(owner[small], minlength=len(of)) > spare[p]
            ok = ~small if seed < SEEDS - 1 else ~small | hollow[owner]
            name = (p[owner].astype(U) << U(40)) + (U(seed) << U(56)) + (np.arange(at[-1]) - at[:-1][owner]).astype(U) + U(1)
            keys.append(mix(seg ^ mix(name))[ok])
            sets.append(of[owner[ok]])
            of = of[hollow]
    return np.concatenate(keys), np.concatenate(sets)


def _signature(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash for each set; 0 for empty ones."""
    n = np.diff(bounds)
    c = np.concatenate([[U(0)], np.cumsum(mix(h + U(77)), dtype=U)])
    x = np.concatenate([[U(0)], np.cumsum(mix(h ^ U(0xABCDEF)), dtype=U)])
    s = mix((c[bounds[1:]] - c[bounds[:-1]]) ^ mix((x[bounds[1:]] - x[bounds[:-1]]) + n.astype(U)))
    return np.where(n > 0, np.where(s == 0, U(1), s), U(0))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(a) + len(b) - inter) > 0


def sketch_words(n: np.ndarray | int) -> np.ndarray:
    """64-bit words of the long sketch of a set of n: SKETCH, doubled until it has a bit for each shingle, as fuller sketches tell nothing apart."""
    return SKETCH << np.ceil(np.log2(np.maximum(np.asarray(n) / (64 * SKETCH), 1))).astype(np.int64)


def sketches(h: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(long parity sketches of all sets one after another, bounds), of these numbers of words; every shingle flips one bit."""
    at = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(at[-1], U)
    m, n = mix(h), np.diff(bounds)
    np.bitwise_xor.at(out, np.repeat(at[:-1], n) + ((m >> U(40)) & (np.repeat(words, n) - 1).astype(U)).astype(np.int64), U(1) << (m & U(63)))
    return out, at


def folded(sk: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows) brought to fewer words: bits that fall on one another are added, so distances only shrink."""
    while sk.shape[1] > words:
        half = sk.shape[1] // 2
        sk = sk[:, :half] ^ sk[:, half:]
    return sk


def _near(size: np.ndarray, sk: np.ndarray, i: int, j: np.ndarray, percent: int) -> np.ndarray:
    """Those of j that may link with i by size and sketch: the sketches differ in no more bits than linked sets do in shingles."""
    j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
    return j[_popcount(sk[j] ^ sk[i]) <= (size[j] + size[i]) * (100 - percent) // (100 + percent)]


def forest(sets: list[np.ndarray] | None, left: int, percent: int, label: np.ndarray | None = None, marks: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links among the sets connect; with left < all, only links across that border are needed.

    label: sets of one label are taken as connected already.  marks: sizes and long sketches; without sets, pairs are taken as linked by these.
    """
    if marks is None:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        words = int(sketch_words(np.diff(bounds).max(initial=1)))
        marks = np.diff(bounds), sketches(np.concatenate(sets) if sets else np.zeros(0, U), bounds, np.full(len(sets), words))[0].reshape(-1, words)
    size, sk = marks
    n = len(size)
    label, out = np.arange(n) if label is None else label.copy(), []
    for i in range(left):
        start = i + 1 if left == n else left
        j = start + np.flatnonzero(label[start:] != label[i])
        for k in _near(size, sk, i, j, percent).tolist() if len(j) else ():
            if label[k] != label[i] and (sets is None or linked(sets[i], sets[k], percent)):
                out.append((i, k))
                label[label == label[k]] = label[i]
    return out


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(U).ravel()


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _bits(raw: list[bytes]) -> np.ndarray:
    """Rows of sketches, all brought to the shortest's words."""
    sizes = np.array([len(x) for x in raw])
    if len(sizes) and (sizes != sizes.min()).any():
        words = int(sizes.min()) // 8
        return np.concatenate([folded(np.frombuffer(x, U)[None], words) for x in raw])
    return np.frombuffer(b"".join(raw), U).reshape(len(raw), -1)


def _may_link(size, bits, percent: int) -> np.ndarray:
    """Which pairs of (sizes, sketches) may link."""
    ok = 100 * np.minimum(*size) >= percent * np.maximum(*size)
    return ok & (_popcount(bits[0] ^ bits[1]) <= (size[0] + size[1]) * (100 - percent) // (100 + percent))


def _tightened(tied: DataFrame, marks: DataFrame, percent: int, block: int) -> DataFrame:
    """Ties (a, b) among those that share a segment, (k, sig, lo), whose components hold all links and little else.

    Every node's tie to the smallest of those it meets is held against the long sketches first.  Segments whose nodes are not all connected
    by that are looked at whole, one of each set of nodes: their nodes of different classes meet, in blocks, and a forest of the pairs that may link
    by their sketches is kept.
    """
    least = tied.withColumn("m", F.min("lo").over(Window.partitionBy("sig")))
    star = least.select(F.col("sig").alias("a"), F.col("m").alias("b")).union(least.select("lo", "m")).where("a <> b").distinct()
    ends = [marks.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sk").alias(f"s{c}")) for c in "ab"]

    def may(batch):
        size, raw = ([batch.column(f"{x}{c}") for c in "ab"] for x in "ns")
        size, ok = [x.to_numpy() for x in size], np.zeros(batch.num_rows, bool)
        words = np.minimum(*(sketch_words(x) for x in size))
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            bits = [folded(np.concatenate([folded(np.frombuffer(col[k].as_py(), U)[None], w) for k in at.tolist()]), w) for col in raw]
            ok[at] = _may_link([x[at] for x in size], bits, percent)
        return batch.select(["a", "b"]).filter(pa.array(ok))

    near = cut(map_arrow(star.join(ends[0], "a").join(ends[1], "b"), may, "a long, b long"))
    classes = components(near)
    named = cut(tied.select("k", F.col("sig").alias("node")).join(classes, "node", "left").select("k", "node", F.coalesce("root", "node").alias("label")).distinct())
    whole = [F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("p"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("q")]
    open_ = named.groupBy("k").agg(*whole, F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").dropDuplicates(["rows", "p", "q"])
    open_ = cut(open_.select("k", "rows", F.ceil(F.col("rows") / F.lit(block)).cast("int").alias("m")))
    groups = (open_.agg(F.sum(F.col("rows") * F.col("m"))).first()[0] or 0) // ROWS + 1  # small segments share a task's call
    rows = named.join(open_, "k").join(marks, "node").withColumn("b", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    met = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("k", "node", "label", "n", "sk", "b", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))

    def look(key, rows):
        k, x, y, b, node, label, n = (rows.column(c).to_numpy() for c in ("k", "x", "y", "b", "node", "label", "n"))
        sk = rows.column("sk").to_pylist()
        o = np.lexsort((node, b, y, x, k))
        new = np.ones(len(o), bool)
        new[1:] = (k[o][1:] != k[o][:-1]) | (x[o][1:] != x[o][:-1]) | (y[o][1:] != y[o][:-1])
        at = np.append(np.flatnonzero(new), len(o))
        size = np.diff(at)
        i, j = o[at[:-1][size == 2]], o[at[:-1][size == 2] + 1]
        apart = (label[i] != label[j]) & ((x[i] == y[i]) | (b[i] != b[j]))
        i, j = i[apart], j[apart]
        ok = np.zeros(len(i), bool)
        words = np.minimum(sketch_words(n[i]), sketch_words(n[j]))
        for w in np.unique(words).tolist():
            of = np.flatnonzero(words == w)
            ok[of] = _may_link((n[i[of]], n[j[of]]), [np.concatenate([folded(np.frombuffer(sk[t], U)[None], w) for t in x[of].tolist()]) for x in (i, j)], percent)
        a, c = [node[i[ok]]], [node[j[ok]]]
        for s in np.flatnonzero(size > 2).tolist():
            of = o[at[s] : at[s + 1]]
            _, own = np.unique(label[of], return_inverse=True)
            found = np.array(forest(None, int((b[of] == x[of[0]]).sum()), percent, own, (n[of], _bits([sk[t] for t in of.tolist()]))), np.int64).reshape(-1, 2)
            a.append(node[of[found[:, 0]]])
            c.append(node[of[found[:, 1]]])
        return _pairs(np.concatenate(a), np.concatenate(c))

    more = met.groupBy(F.pmod(F.xxhash64("k", "x", "y"), F.lit(groups)).alias("g")).applyInArrow(look, "a long, b long")
    return cut(near.unionByName(more).distinct())


def _dealt(of: DataFrame, block: int, most: int) -> DataFrame:
    """Rows (root, node, bytes) with the number m of blocks that their root's rows need and their own block b."""
    m = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("bytes") / F.lit(most))).cast("int")
    parts = cut(of.groupBy("root").agg(m.alias("m")).where("m > 1"))  # a few rows, as each stands for a full block
    return of.join(parts, "root", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))


def _verified(placed: DataFrame, percent: int, block: int, most: int) -> DataFrame:
    """Links (a, b) that connect what all links among the (root, node, bytes, set) of each root connect."""

    def verify(key, rows):
        node, side, label = (rows.column(c).to_numpy() for c in ("node", "side", "label"))
        order = np.lexsort((node, side))
        raw = rows.column("set")
        sets_ = [_unpack(raw[k].as_py()) for k in order.tolist()]
        left = int((side == 0).sum())
        _, label = np.unique(label[order], return_inverse=True)
        found = np.array(forest(sets_, left, percent, label), np.int64).reshape(-1, 2)
        return _pairs(node[order[found[:, 0]]], node[order[found[:, 1]]])

    def meet(rows: DataFrame, *keys: str) -> DataFrame:
        # dealt by all keys: a join by root alone would leave the blocks of a root in one task
        return rows.repartition(*keys).groupBy(*keys).applyInArrow(verify, "a long, b long")

    own = placed.select("root", "node", "bytes")
    sets = placed.select("node", "set")
    dealt = _dealt(placed, block, most)
    links = cut(meet(dealt.withColumns({"side": F.lit(0), "label": F.col("node")}), "root", "b"))
    large = cut(_dealt(own, block, most).where("m > 1").select("root", "node", "bytes"))  # the components of several blocks
    if large.isEmpty():
        return links
    have = None
    while True:
        classes = components(links).withColumnRenamed("root", "class")
        named = large.join(classes, "node", "left").select("root", "node", "bytes", F.coalesce("class", "node").alias("label"))
        heads = cut(named.where("node = label"))
        n = heads.count()
        if have is not None and n * 10 > have * 9:
            break
        have = n
        more = meet(_dealt(heads, block, most).join(sets, "node").withColumn("side", F.lit(0)), "root", "b")
        links = cut(links.unionByName(more))
    sizes = cut(named.groupBy("root", "label").agg(F.count("*").alias("n")).groupBy("root").agg(F.max(F.struct("n", "label")).alias("s"), F.count("*").alias("k")).where("k > 1").select("root", F.col("s.label").alias("main")))
    named = cut(named.join(sizes, "root"))  # of components of several classes
    x = cut(_dealt(named.where("label <> main"), block, most).select("root", "node", "label", F.col("b").alias("x"), F.col("m").alias("mx")))
    y = cut(_dealt(named, block, most).select("root", "node", "label", F.col("b").alias("y"), F.col("m").alias("my")))
    of = cut(x.groupBy("root").agg(F.max("mx").alias("mx")).join(y.groupBy("root").agg(F.max("my").alias("my")), "root"))
    to = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    first = x.join(of.select("root", "my"), "root").select("root", "node", "label", "x", to("my").alias("y"), F.lit(0).alias("side"))
    second = y.join(of.select("root", "mx"), "root").select("root", "node", "label", to("mx").alias("x"), "y", F.lit(1).alias("side"))
    return links.unionByName(meet(first.unionByName(second).join(sets, "node"), "root", "x", "y"))


def link_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK, most: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_shingles, component_id) for each row; component_id: the smallest id reachable by links."""
    spark = docs.sparkSession
    prepare(spark)
    release(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    plan = segments_of(percent)

    def each(batch):
        data, off = text_bytes(batch.column("t"))
        for i, j in slices(off):
            h, bounds = sets_of(Words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True), width)
            yield i, j, h, bounds

    def size(batch):
        out = [(np.diff(bounds), _signature(h, bounds), sketches(h, bounds, sketch_words(np.diff(bounds)))[0]) for _, _, h, bounds in each(batch)]
        n, sig, sk = (np.concatenate(x) for x in zip(*out, strict=True))
        at = np.concatenate([[0], np.cumsum(8 * sketch_words(n))]).astype(np.int32)
        sk = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(sk.tobytes())])
        return pa.record_batch({"i": batch.column("i"), "n": pa.array(n), "sig": i64(sig), "sk": sk})

    def keyed(batch, seen=None):
        """The segments' keys and the sets they are of, once each in a piece, where copies are one node."""
        out = []
        for _, _, h, bounds in each(batch):
            keys, of = _segments(h, bounds, plan)
            sig = _signature(h, bounds)[of]
            if seen is not None:
                ok = seen.value.has(keys)
                keys, sig = keys[ok], sig[ok]
            out.append((keys, sig))
        keys, sig = (np.concatenate(x) for x in zip(*out, strict=True))
        o = np.lexsort((sig, keys))
        new = np.ones(len(o), bool)
        new[1:] = (keys[o][1:] != keys[o][:-1]) | (sig[o][1:] != sig[o][:-1])
        return pa.record_batch({"k": i64(keys[o[new]]), "sig": i64(sig[o[new]])})

    nodes = cut(map_arrow(docs, size, "i long, n long, sig long, sk binary", "t"))
    # segments that two different sets share, with the smallest of the sets; keys are made again for the join, as they are as large as the texts
    shared = map_arrow(docs, keyed, "k long, sig long", "t").groupBy("k").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi").select("k", "lo")
    shared = cut(shared)
    release(spark)  # of the segments' shuffle, the largest
    seen = spark.sparkContext.broadcast(bloom(shared, "k", shared.count()))
    tied = cut(map_arrow(docs, lambda batch: keyed(batch, seen), "k long, sig long", "t").join(shared, "k").select("k", "sig", "lo").distinct())
    drop(shared)
    # copies are brought to one row in their own tasks, before any is shuffled for the join
    one = nodes.groupBy("sig").agg(F.min("n").alias("n"), F.min("sk").alias("sk"))
    marks = cut(one.join(tied.select("sig").distinct(), "sig", "left_semi").withColumnRenamed("sig", "node"))
    maybe = components(_tightened(tied, marks, percent, block))  # node, root: all links lie within a root's nodes
    maybe = cut(maybe)
    drop(tied)
    drop(marks)
    release(spark)
    picked = spark.sparkContext.broadcast(bloom(maybe.select("node"), "node", maybe.count()))

    def whole(batch):
        out = []
        for i, j, h, bounds in each(batch):
            sig = _signature(h, bounds)
            _, one = np.unique(sig, return_index=True)
            one = one[(sig[one] != 0) & picked.value.has(sig[one])]
            for k in one.tolist():
                # 6 bytes of each hash tell the few shingles of two texts apart
                out.append((sig[k], np.ascontiguousarray(h[bounds[k] : bounds[k + 1]].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()))
        return pa.record_batch({"node": i64(np.array([x for x, _ in out], U)), "set": pa.array([x for _, x in out], pa.binary())}) if out else None

    sets = map_arrow(docs, whole, "node long, set binary", "t").groupBy("node").agg(F.first("set").alias("set"))
    placed = cut(maybe.join(sets, "node").select("root", "node", F.octet_length("set").alias("bytes"), "set"))
    release(spark)
    links = _verified(placed, percent, block, most)
    groups = components(links).withColumnRenamed("root", "class")
    out = nodes.select("i", "n", "sig").join(groups, nodes.sig == groups.node, "left").select("i", "n", F.coalesce("class", "sig").alias("class"))
    out = cut(out)
    for table in (nodes, maybe, placed, groups):  # the result needs ``out`` only
        drop(table)
    first = cut(out.where("n > 0").groupBy("class").agg(F.min("i").alias("component_id"), F.count("*").alias("rows")))
    # classes that hold more than one of HOT rows, HOT at most, are told to all tasks; the others are joined by class
    hot = F.broadcast(first.where(F.col("rows") * HOT > first.agg(F.sum("rows")).first()[0]).select("class", "component_id"))
    many = out.where("n > 0").join(hot, "class")
    few = out.join(hot, "class", "left_anti").join(first.select("class", "component_id"), "class", "left")
    return many.unionByName(few).select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("i")).alias("component_id"))
