"""The operators on their whole tables, with production parameters: one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsight.llm import superminhash
from flowsight.llm.chat import rotate
from flowsight.llm.common import documents
from flowsight.llm.importance import resample
from flowsight.llm.language import identify, is_held_out, labelled_samples
from flowsight.llm.leaks import find_leaks
from flowsight.llm.packing import pack
from flowsight.llm.periods import periodic_runs
from flowsight.llm.secrets import scan
from flowsight.llm.sharding import shard_documents
from flowsight.llm.simhash import near_duplicates
from flowsight.llm.sketches import fingerprints
from flowsight.llm.substrings import remove_repeats
from flowsight.llm.tokens import vocabulary
from flowsight.llm.wavelet import read_shards, write_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir), digest_only=True)
    return found.withColumnRenamed("kept", "kept_sha256")


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), path=vocabulary("word_bpe_49k.json"))


@query
def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    read = docs.select("doc_id", is_held_out(docs["doc_id"]).alias("held_out"), "text")
    return identify(read, labelled_samples(docs), keep=["doc_id", "held_out"])


@query
def op10_bloom_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


@query
def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL["op2_perspective_rotation"] = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body, turn // 256 AS block FROM conversations
), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns),
seen AS (
  SELECT t.*, perspective, speaker = perspective AS own,
    CASE WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || speaker || '|>' END AS head
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id, perspective ORDER BY block) - 1 AS part,
    coalesce(sum(length(head) + length(body) + 8) OVER (
      PARTITION BY conv_id, perspective ORDER BY turn, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM seen
)
SELECT conv_id, perspective, CAST(part AS INTEGER) AS part, CAST(min(place) AS BIGINT) AS start,
  string_agg(head || body || '<|end|>' || chr(10), '' ORDER BY turn, speaker, body) AS text,
  count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
  coalesce(string_agg(CAST(place + length(head) AS VARCHAR) || ':' || CAST(place + length(head) + length(body) + 7 AS VARCHAR),
    ',' ORDER BY place) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), keep=["doc_id"])


@query
def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=24)


@query
def op8_semantic_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """docs with every tenth text (by CRC-32 of doc_id) repeating words of its own from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    split = docs.withColumns({"_h": h, "_g": g}).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    n = F.nullif(F.size("_words"), F.lit(0)).cast("bigint")
    placed = split.withColumn("_n", n).withColumn("_a", F.col("_g") % F.col("_n"))
    placed = placed.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    tail = F.transform(
        F.sequence(F.col("_a"), F.col("_n") - 1),
        lambda i: F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")),
    )
    repeated = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), tail), " ")
    text = F.when(F.col("_n") > 0, repeated).otherwise(F.col("text"))
    return placed.withColumn("text", text).select(*docs.columns)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_periods(documents(spark, sf_dir).select("doc_id", "text"))
    found = periodic_runs(docs, keep=["doc_id"])
    order = lambda r: F.struct(r["length"], -r["start"], -r["period"])
    best = F.array_max(F.transform("runs", order))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    longest = found.withColumn("_best", F.struct(best["length"].alias("length"), (-best["col2"]).alias("start"), (-best["col3"]).alias("period")))
    return longest.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(documents(spark, sf_dir))
