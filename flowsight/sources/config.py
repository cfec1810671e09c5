"""Thresholds, rule models and scenarios from JSON."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsight.functions.numeric import is_true
from flowsight.operators.rules import RuleModel
from flowsight.schema import SCENARIO_DDL, SCENARIO_FIELDS

log = logging.getLogger(__name__)

# The threshold of an entry that names none, what a scenario must name, and allowed settings.
DEFAULT_THRESHOLD = 0.5
REQUIRED_FIELDS = ("doh_server", "target_domain", "chunk_size")
ENCODINGS = ("base64", "hex", "base32", "custom")
TIMING_PATTERNS = ("regular", "random", "burst", "stealth")


def whole_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, value): one row per file, for configuration files."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def parse_thresholds(files: DataFrame) -> DataFrame:
    """(model, threshold, picked_on, target_fpr) per entry; text that is no JSON object gives no rows."""
    entries = F.from_json(
        "value", "map<string,struct<threshold:double,picked_on:string,target_fpr:double>>"
    )
    return files.select(F.explode(entries).alias("model", "entry")).select(
        "model", F.coalesce("entry.threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        "entry.picked_on", "entry.target_fpr",
    )


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return parse_thresholds(whole_files(spark, path))


def read_rule_model(spark: SparkSession, path: str, pattern: str = "*.json") -> RuleModel:
    """A rule model is a short configuration text, read on the driver."""
    return RuleModel.from_json(whole_files(spark, path, pattern).first()["value"])


def parse_scenarios(files: DataFrame) -> DataFrame:
    """Scenario files with every setting, defaults filled in, under config; scenario is the file's name."""
    parsed = files.withColumn("_s", F.from_json("value", SCENARIO_DDL))
    def setting(name: str, kind: str, default) -> Column:
        value = F.col(f"_s.exfiltration_config.{name}")
        fallback = F.array().cast(kind) if isinstance(default, list) else F.lit(default).cast(kind)
        return F.coalesce(value, fallback).alias(name)
    base = F.substring_index("path", "/", -1)
    return parsed.select(
        "path", F.regexp_replace(base, "[.]json$", "").alias("scenario"), "_s.name", "_s.description", "_s.notes",
        "_s.test_files", F.struct(*[setting(*field) for field in SCENARIO_FIELDS]).alias("config"),
    )


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return parse_scenarios(whole_files(spark, path))


def validate_scenarios(files: DataFrame) -> DataFrame:
    """(path, scenario, violations): missing required settings and values outside the allowed ones."""
    given = lambda name: F.get_json_object("value", f"$.exfiltration_config.{name}")
    checks = [F.when(given(name).isNull(), F.lit(f"missing {name}")) for name in REQUIRED_FIELDS]
    for name, allowed in (("encoding", ENCODINGS), ("timing_pattern", TIMING_PATTERNS)):
        checks.append(F.when(is_true(~given(name).isin(*allowed)), F.lit(f"invalid {name}")))
    base = F.substring_index("path", "/", -1)
    return files.select(
        "path", F.regexp_replace(base, "[.]json$", "").alias("scenario"), F.array_compact(F.array(*checks)).alias("violations")
    )
