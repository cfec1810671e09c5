"""Selecting and splitting flows by endpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsight.functions.names import any_of
from flowsight.schema import ENDPOINT_COLUMNS


def involves(df: DataFrame, ip: str) -> Column:
    """True where either side is the address; a side the table lacks never matches."""
    sides = [c for c in ENDPOINT_COLUMNS if c in df.columns]
    if not sides:
        raise ValueError("neither SourceIP nor DestinationIP is in the table")
    bare = lambda c: F.regexp_replace(c, '^"|"$', "")
    return any_of([F.coalesce(bare(c) == ip, F.lit(False)) for c in sides])


def split_by_endpoint(df: DataFrame, ip: str, name: str = "is_match") -> DataFrame:
    return df.withColumn(name, involves(df, ip))
