"""Records of text files with their place in the file, also where a file is split between tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowsight.runtime import cut_lineage


def text_records(spark: SparkSession, path: str, separator: str = "\n", pattern: str | None = None) -> DataFrame:
    """The records of each file below path; the folder is listed once for this table and all that is made from it."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", separator)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path)


def numbered_records(spark: SparkSession, path: str, separator: str = "\n", pattern: str | None = None) -> DataFrame:
    """number_records of all files below path whose name fits pattern."""
    return number_records(text_records(spark, path, separator, pattern))


def number_records(records: DataFrame) -> DataFrame:
    """(path, no, value): the records of each file of text_records, numbered from 0 in the file's order.

    A file is read in splits. Within a split the number follows the order of reading; the records of the splits before it are
    counted, one row per split, and added. Records are stored once, so that numbers do not change when a task runs again. An
    empty file has no records.
    """
    read = records.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("at"),
    )
    read = cut_lineage(read)
    along = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = read.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    splits = splits.select("path", "block", (F.coalesce(F.sum("n").over(along), F.lit(0)) - F.col("first")).alias("shift"))
    return read.join(splits, ["path", "block"]).select("path", (F.col("at") + F.col("shift")).alias("no"), "value")
