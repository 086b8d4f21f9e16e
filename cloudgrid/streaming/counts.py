"""Voxel counts of points that keep arriving: sums are associative, so the plain aggregation in update mode is all it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lineage import drop, settle
from ..functions.scalar import morton
from ..operators.voxels import CELL, voxelize


def voxel_counts(stream: DataFrame, level: int) -> DataFrame:
    """E1 over a stream of points; write it in update (or complete) mode."""
    return voxelize(stream, level)


def keep_counts(stream: DataFrame, level: int, path: str, checkpoint: str, coarse: int = 3, **trigger) -> StreamingQuery:
    """Keeps a table of counts at ``path`` up to date: a batch brings the totals of the cells it touches, and only the table's parts that
    hold one of them are written again.

    Parts are the cells of the octree ``coarse`` levels deep.  A batch that runs again brings the same totals, so it changes nothing.
    """
    part = F.shiftright(morton(*CELL), 3 * max(level - coarse, 0)).alias("part")

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        made = [settle(batch.select(part, *CELL, "n", "val"))]
        now = made[0]
        if not now.isEmpty():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                old = spark.read.schema(now.schema).parquet(path)
                near = old.join(F.broadcast(now.select("part").distinct()), "part", "left_semi")  # 8^coarse parts at most
                made.append(settle(near.join(now.select(*CELL), CELL, "left_anti").unionByName(now)))
            made[-1].repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        drop(*made)

    return voxel_counts(stream, level).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(merge).start()
