"""The registered opN_ queries: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import sql
from .common import checkpoint, table, text_key
from .context_tree import context_tree_scores
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .near_dedup import near_duplicates
from .packing import pack
from .quality import quality_scores
from .sharding import balanced_shards
from .span_dedup import span_dedup
from .toxicity import toxicity_scores


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup(table(spark, sf_dir, "documents"), within=True)  # repeats within a document go too


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree_scores(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("lines_removed").cast("long").alias("lines_removed"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = checkpoint(contaminated(docs, table(spark, sf_dir, "benchmark")))
    return docs.select("doc_id", text_key().alias("key")).join(found, "key").select("doc_id", "item_id", "score", "start", "end")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_span_dedup, op3_context_tree, op4_packing, op5_sharding, op6_line_dedup, op7_decontamination, op8_toxicity, op9_near_dedup, op10_quality)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {k: v for k, v in sql.ORACLES.items() if k in QUERIES}
