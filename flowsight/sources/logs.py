"""Run logs as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsight.sources.numbered import numbered_records

# Fixed value: where a log lies, .../<run>/<scenario>/logs/<file>.
PATH_PATTERN = "([^/]+)/([^/]+)/logs/[^/]+$"


def log_files(spark: SparkSession, path: str, pattern: str = "predictor_*.log") -> DataFrame:
    """(path, modified, run, scenario) of the log files under a folder."""
    place = lambda group: F.regexp_extract("path", PATH_PATTERN, group)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    return files.select("path", F.col("modificationTime").alias("modified")).withColumns(
        {"run": place(1), "scenario": place(2)}
    )


def read_run_logs(spark: SparkSession, path: str, pattern: str = "predictor_*.log", place: str = PATH_PATTERN) -> DataFrame:
    """(path, run, scenario, line_no, line) of the logs under a folder; place finds run and scenario in a path.

    A long log is read in splits by several tasks; lines end at line feeds alone.
    """
    part = lambda group: F.regexp_extract("path", place, group)
    return numbered_records(spark, path, pattern=pattern).select(
        "path", part(1).alias("run"), part(2).alias("scenario"), F.col("no").alias("line_no"), F.col("value").alias("line")
    )
