"""From documents to tokens: five stages, each of which works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm import bpe, line_dedup, mixing, ngram_join, quality
from joblattice.llm.common import scratch, table

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar ones: that of the smallest id, then of the smallest hash of id and text.

    Rows are told apart by id and text, so two texts under one id are two rows,
    equal rows are copies of which one stays, and rows without an id come last.
    Rows without words are linked with nothing and all stay.
    """
    docs = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("doc_id", "text"))
    found = ngram_join.join(docs.select("_row", "text"), key="_row").select(
        F.col("id").alias("_row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("_component")).distinct()
    named = docs.groupBy("_row").agg(F.min("doc_id").alias("_id"), F.count("*").alias("_copies")).join(found, "_row")
    first = named.where("_component IS NOT NULL").groupBy("_component").agg(
        F.min_by("_row", F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_row"))
    single = named.where("_component IS NULL").select("_row", F.lit(1).alias("_copies")).unionByName(
        first.join(named.select("_row", "_copies"), "_row").select("_row", F.col("_copies").cast("int")))
    kept = docs.join(single, "_row")
    # only rows that occur more than once are dealt by their hash
    return kept.where("_copies = 1").unionByName(kept.where("_copies > 1").dropDuplicates(["_row"])).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    out = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, packed as little-endian 32-bit integers, their number, and whether decoding gives the text back."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "source"], round_trip="round_trip")
    return ids.select("doc_id", "source", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_lines),
    ("ngram_join", near_duplicates),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Rules are learned and documents drawn at random: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
