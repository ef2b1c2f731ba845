"""The corpus pipeline: quality, line and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir); run() writes its result as Parquet in the shared folder and
reads it again as the next one's docs, and deletes the one before.  All stages but the last return the columns of
documents, whatever other columns these have.

Rows with one doc_id are one document: they stay or go together, but for lines, which each text loses by itself, and
benchmark items, which each text is judged by.  A null doc_id is replaced, for a stage's decisions alone, by a number
beyond all others made of the text, so rows without an id are decided by their text, and give way to equals with an id.
Null and empty texts are kept or rejected by their score, have no lines and no near duplicates, hold no item, and pack as
one end token.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwatch.llm.common import dropped, free_name, joined, stored, table, text_of
from brookwatch.llm.decontaminate import decontaminate
from brookwatch.llm.line_dedup import line_dedup
from brookwatch.llm.near_dedup import near_duplicates
from brookwatch.llm.packing import pack
from brookwatch.llm.quality import quality_scores


def _id() -> Column:
    high = 1 << 62
    made = F.xxhash64(text_of("text")).bitwiseAND(F.lit(high - 1).cast("long")).bitwiseOR(F.lit(high).cast("long"))
    return F.coalesce(F.col("doc_id").cast("long"), made)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id is in gone (doc_id)."""
    key = free_name(docs, "key")
    ids = stored(gone.select(F.col("doc_id").alias(key)).distinct())
    return joined(docs.withColumn(key, _id()), ids, key, "left_anti").select(*docs.columns)


def _ided(docs: DataFrame) -> DataFrame:
    return docs.select(_id().alias("doc_id"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; an id with several rows stays if one row is accepted."""
    scores = quality_scores(_ided(docs), table(spark, sf_dir, "labels"), threshold=0.5).groupBy("doc_id").agg(F.max("predicted").alias("good"))
    return _without(docs, scores.filter("good = 0"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and n_chars is counted again where some went."""
    out = line_dedup(docs)
    n = F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[n.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return _without(docs, near_duplicates(_ided(docs)).filter("NOT kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontaminated), ("packing", packed)]
#: Learned models and alignment have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return docs
