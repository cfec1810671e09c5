"""From raw documents to packed training sequences: each stage reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsight.llm.common import documents, stored
from flowsight.llm.language import identify, labelled_samples
from flowsight.llm.leaks import find_leaks
from flowsight.llm.packing import pack
from flowsight.llm.secrets import redact
from flowsight.llm.simhash import near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a text or letter go; a missing lang is filled in from the text.

    Without any labelled document no language can be told, and documents with a letter stay as they are.
    """
    samples = labelled_samples(docs)
    if not samples:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = identify(docs, samples).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


#: A number per row of a stage's input, which stands for doc_id where that is null or occurs more than once.
ROW = "_pipeline_row"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number per row, stored, so that every later reading sees the same numbers."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of each group of documents whose fingerprints link by at most four bits one row stays.

    It is the one with the smallest doc_id, rows with a null doc_id coming last. Rows that share a doc_id but not a group all stay.
    """
    rows = numbered(docs)
    found = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), most=4, width=4)
    groups = rows.select(ROW, "doc_id").join(found.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("_group")), ROW)
    groups = stored(groups)
    first = F.min_by(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", ROW))
    kept = groups.groupBy("_group").agg(first.alias("_kept"))
    # Those that go are fewer than those that stay. They are dealt out by hash at every size, so the texts are moved once.
    gone = groups.join(kept, "_group").where(F.col(ROW) != F.col("_kept")).select(ROW)
    return rows.join(gone.hint("shuffle_hash"), ROW, "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: rows that hold a benchmark item go, and no others, whatever their doc_id."""
    rows = numbered(docs)
    leaks = find_leaks(rows.select(F.col(ROW).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    # Stored, so that Spark knows their size before it decides whether to move the texts.
    found = stored(leaks.select(F.col("doc_id").alias(ROW)).distinct())
    return rows.join(found, ROW, "left_anti").select(*docs.columns)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: documents stay, each secret in them is replaced by a mark."""
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the place of each document, or of each piece of a long one, in sequences of 4,096 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", blot_secrets),
    ("packing", pack_sequences),
]

#: Automata, fingerprints, latent search, lexing and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is stored and read again by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
