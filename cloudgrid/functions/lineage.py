"""Tables in the shared folder that end a plan's lineage, for loops whose steps build on each other."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and all runs on one machine."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    at = getattr(spark, "_cloudgrid_folder", None)
    if not at:
        at = spark._cloudgrid_folder = "file://" + tempfile.mkdtemp(prefix="cloudgrid-")
    return at


def fresh(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared one."""
    return f"{folder(spark)}/{kind}-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows and reads them again; lost executors lose nothing, and later steps plan from a table."""
    spark = df.sparkSession
    at = fresh(spark, "settled")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def settle_by(df: DataFrame, by: str) -> DataFrame:
    """As settle(), in buckets by a column: joins on it don't shuffle this table any more."""
    spark = df.sparkSession
    at, name, n = fresh(spark, "settled"), f"settled_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, by).write.format("parquet").option("path", at).bucketBy(n, by).saveAsTable(name)
    out = spark.table(name)
    out._settled_as = name
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables made by settle() and settle_by() that no plan reads any more."""
    for df in tables:
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for at in {os.path.dirname(f) for f in df.inputFiles()[:1]}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
        if name := getattr(df, "_settled_as", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
