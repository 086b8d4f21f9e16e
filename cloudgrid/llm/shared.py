"""What the operators share: sessions' folders, tables that cut lineage, bounded Bloom filters, connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .wordcode import Bloom, slices, text_bytes, u64

#: Largest Bloom filter that is broadcast: 32 MB.  Beyond, it lets more candidates through and loses none.
MAX_BLOOM_BITS = 1 << 28
#: Bytes of text of a training sample that reach the driver.
SAMPLE_BYTES = 64 << 20
#: Bytes of text that a step over pieces of batches takes at once.
PIECE_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    # workers give freed arrays back to the system, as several of them share an executor's memory
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_MMAP_THRESHOLD_", "2097152"), ("MALLOC_ARENA_MAX", "2")):
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and all runs on one machine, a folder of our own."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    at = getattr(spark, "_own_checkpoint_dir", None)
    if not at:
        at = spark._own_checkpoint_dir = "file://" + tempfile.mkdtemp(prefix="cloudgrid-")
    return at


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads it again: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    at = f"{folder(spark)}/cloudgrid-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


def drop(df: DataFrame) -> None:
    """Removes a table made by cut() that no result needs any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for f in {os.path.dirname(x) for x in df.inputFiles()[:1]}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def unused(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with so many underscores before them that none is among ``names`` (which Spark compares without case)."""
    taken = {n.lower() for n in names}
    lead = ""
    while any((lead + w).lower() in taken for w in wanted):
        lead += "_"
    return [lead + w for w in wanted]


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> StructType:
    """The schema of df with further (name, type) fields."""
    out = StructType(list(df.schema.fields))
    for name, kind in fields:
        out = out.add(StructField(name, _parse_datatype_string(kind)))
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and broadcasts that nothing refers to any more: it does so only when the driver collects garbage."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.java.lang.System.gc()


def pieces(batch: pa.RecordBatch, text: str):
    """Parts of a batch of at most ``PIECE_BYTES`` of a text column, or of one row."""
    for i, j in slices(text_bytes(batch.column(text))[1], PIECE_BYTES):
        yield batch.slice(i, j - i)


def map_arrow(df: DataFrame, step, schema: str | StructType, text: str | None = None) -> DataFrame:
    """mapInArrow with ``step(batch) -> RecordBatch | Table | None``; with ``text``, for pieces of batches, as a batch is bounded in rows only."""
    prepare(df.sparkSession)

    def run(batches):
        for b in batches if text is None else (x for b in batches for x in pieces(b, text)):
            if b.num_rows and (out := step(b)) is not None and out.num_rows:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        trim()  # the next task may run in another worker of the executor

    return df.mapInArrow(run, schema)


def sample_rows(df: DataFrame, id_col: str, n: int, text_col: str | None = None, most_bytes: int = SAMPLE_BYTES) -> pa.Table:
    """Rows of the first n ids by their hash, in that order: one of each id (the least by a hash of the whole row), and of those the
    first that hold ``most_bytes`` of text together, one at least.

    Ids are picked first, so no text is sorted or gathered to pick them.  Rows are counted by the first 16 bits of the hash before, and
    only the least of those that hold n rows are sorted, so what reaches the driver doesn't grow with the number of partitions.  The
    rows of the picked ids, however many and long, stay a table in the shared folder; the driver gets one of each id within the bound.
    """
    own = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.xxhash64(id_col).alias("h")).withColumn("b", F.shiftright("h", 48))
    have, last = 0, None
    for b, rows in sorted(own.groupBy("b").count().collect()):  # 65,536 at most
        have, last = have + rows, b
        if have >= n:
            break
    if last is None:
        return df.limit(0).toArrow()
    ids = [r.i for r in own.where(F.col("b") <= last).select("h", "i").distinct().orderBy("h", "i").limit(n).collect()]
    size = F.lit(0) if text_col is None else F.coalesce(F.octet_length(text_col), F.lit(0))
    picked = cut(df.where(F.col(id_col).isin(ids)).select("*", F.xxhash64(*df.columns).alias("_row"), size.alias("_size")))
    one = {r[id_col]: r.least for r in picked.groupBy(id_col).agg(F.min(F.struct("_row", "_size")).alias("least")).collect()}
    rows, total = [], 0
    for i in ids:
        total += one[i]["_size"]
        if rows and total > most_bytes:
            break
        rows.append(one[i]["_row"])
    out = picked.where(F.col("_row").isin(rows)).dropDuplicates(["_row"]).toArrow()
    drop(picked)
    at = {r: k for k, r in enumerate(rows)}
    return out.take(pa.array(sorted(range(out.num_rows), key=[at[r] for r in out.column("_row").to_pylist()].__getitem__), pa.int64())).drop_columns(["_row", "_size"])


def trim() -> None:
    """Gives freed memory back to the system after training in the driver; glibc would keep it."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def bloom(keys: DataFrame, column: str, entries: int, *, level: str | None = None, bits_per_entry: int = 16, k: int = 3, most: int = MAX_BLOOM_BITS) -> Bloom:
    """Blocked Bloom filter of a column of hashes (with ``level``: of all levels from 1 to that), built block by block on the executors.

    Only its bits come to the driver: bits_per_entry for each entry, ``most`` bits at most.
    """
    blocks = max(1, min(most, entries * bits_per_entry) // Bloom.BLOCK_BITS + 1) if entries else 0
    if not blocks:
        return Bloom(np.zeros(0, np.uint8), 0, k)
    prepare(keys.sparkSession)
    levels = F.lit(0) if level is None else F.col(level)

    def one(key, table):
        h, lv = u64(table.column("h")), table.column("lv").to_numpy()
        bits = np.zeros(Bloom.BLOCK_BITS // 8, np.uint8)
        if level is not None:
            h, lv = np.repeat(h, lv), np.concatenate([np.arange(1, x + 1) for x in lv]) if len(lv) else lv
        for i in range(k):
            b = Bloom.bit(h, lv, i)
            np.bitwise_or.at(bits, b >> 3, np.left_shift(1, b & 7).astype(np.uint8))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    of = F.shiftrightunsigned(F.shiftrightunsigned(F.col(column), 32) * F.lit(blocks), 32)
    rows = keys.select(of.cast("long").alias("block"), F.col(column).alias("h"), levels.cast("int").alias("lv"))
    data = np.zeros(blocks * Bloom.BLOCK_BITS // 8, np.uint8)
    size = Bloom.BLOCK_BITS // 8
    for r in rows.groupBy("block").applyInArrow(one, "block long, bits binary").collect():
        data[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return Bloom(data, blocks, k)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of the edges reaches.

    Labels move along edges and then jump to their label's label, so the rounds grow with the logarithm of the longest path.
    Each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    one = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    both = one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(near, "u").select("u", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("u").alias("mid"), F.col("root").alias("far"))
        new = cut(step.join(jump, "mid", "left").select("u", "old", F.least("mid", "far").alias("root")))
        changed = new.where("old <> root").limit(1).count()
        drop(labels)
        labels = new.select("u", "root")
        release(spark)  # the rounds' plans and metrics would fill the driver
        if not changed:
            drop(one)
            return labels.withColumnRenamed("u", "node")
