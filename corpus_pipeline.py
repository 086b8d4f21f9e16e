"""A training corpus from documents: language ID, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudgrid.llm import decontaminate, jaccard, langid, packing, registry, shared, substring


#: The stage's own shingles and threshold; the thin op7 query has jaccard's defaults.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those without a letter (null and empty ones too), and those that the calibrated classifier takes for noise.

    Repeated rows, and rows without an id, are judged each by their text.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    rejected = langid.outputs(docs)[2]
    return langid.predict(docs, model).where(~F.col(rejected)).select(*_columns(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard of 0.8 or more) stays, that of the smallest id.

    Documents without a word link with nothing and stay, each id once.  Of several rows of an id that stays, the first in the order of all columns does.
    Rows without an id stay: none of them could be the one of the smallest id.
    """
    groups = jaccard.link_groups(docs.select("doc_id", "text"), width=NEAR_WIDTH, percent=NEAR_PERCENT)
    own, times = shared.unused(docs.columns, "_own", "_times")
    keep = groups.where("doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(times), F.min("component_id").alias("c")).where(F.col("c") == F.col(own)).drop("c")
    kept = docs.join(keep, F.col("doc_id") == F.col(own))
    first = Window.partitionBy("doc_id").orderBy(*_columns(docs))
    several = kept.where(F.col(times) > 1).withColumn(times, F.row_number().over(first)).where(F.col(times) == 1)
    parts = [kept.where(F.col(times) == 1), several, docs.where("doc_id is null")]
    return reduce(DataFrame.unionAll, [p.select(*_columns(docs)) for p in parts])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a document that loses none keeps its text as it is, and one that loses all goes.

    Rows without an id, with null text or with too few words lose nothing and stay.  Ids are unique here, but for rows without one.
    """
    own, text = shared.unused(docs.columns, "_own", "_text")
    found = substring.remove_repeats(docs.select("doc_id", "text"), keep_text=True).where("n_removed > 0").select(F.col("doc_id").alias(own), F.col("kept_text").alias(text))
    changed = F.col(own).isNotNull()
    new = {"text": F.when(changed, F.col(text)).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))}
    both = docs.join(found, F.col("doc_id") == F.col(own), "left").where(~changed | (F.col(text) != ""))
    return both.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; rows without an id or text are judged by their words, and an empty benchmark keeps all."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; null text is the end id alone, and rows without an id are packed too."""
    return packing.pack(docs.select("doc_id", "text"), registry.tokenizer_path())


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", pack)]

#: The tokenizer and the trained classifier can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.cut(docs)
    return docs
