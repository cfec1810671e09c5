"""Numbers with the missing-value rules the detectors rely on.

Missing is NULL everywhere. Spark orders NaN above every number, so a NaN that slipped into a rule would
fire it; readers turn NaN into NULL before anything compares.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def inf_to_null(value: Column) -> Column:
    return F.when(F.abs(value) != F.lit(float("inf")), value)


def to_number(value: Column) -> Column:
    """Text or number to DOUBLE, NULL for anything else.

    The JVM parser also takes type suffixes ("1d", "2f") and hexadecimal floats, which are not numbers in
    a CSV, so those are refused first.
    """
    text = F.trim(value.cast("string"))
    last = F.lower(F.right(text, F.lit(1)))
    suffixed = (last == "d") | ((last == "f") & ~F.lower(text).endswith("inf"))
    hexadecimal = F.lower(text).contains("x")
    return nan_to_null(F.when(~(suffixed | hexadecimal), text.try_cast("double")))


def numbers(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """The columns as DOUBLE with missing values NULL; only text is parsed."""
    text = {f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "varchar", "char")}
    plain = lambda c: nan_to_null(F.col(c).cast("double"))
    return {c: to_number(F.col(c)) if c in text else plain(c) for c in columns}


def is_true(condition: Column) -> Column:
    """A comparison with a missing value does not hold."""
    return F.coalesce(condition, F.lit(False))


def ratio_or(numerator: Column, denominator: Column, default: float) -> Column:
    """numerator / denominator where the denominator is positive, else the default."""
    return F.when(denominator > 0, F.try_divide(numerator, denominator)).otherwise(F.lit(default))


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def us_to_timestamp(us: Column) -> Column:
    return F.timestamp_micros(us)
