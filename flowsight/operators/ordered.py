"""Order-dependent work that does not put a whole group into one task.

A plain window over a group sorts that group in a single task, which fails when one key holds a large share
of the rows. Here each group is cut into slices that follow its order: windows run inside a slice, and what
crosses a slice border comes from one summary row per slice. Slices depend on the row alone, so a
task that is run again after a lost executor produces the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsight.runtime import stored

SLICE = "_slice"


def shared(df: DataFrame, *columns: str) -> DataFrame:
    """Keep nullable columns that are never NULL in use in every branch of a plan.

    Column pruning would otherwise give each branch a shuffle of its own; with equal columns they share one.
    """
    condition = F.lit(True)
    for column in columns:
        condition = condition & F.col(column).isNotNull()
    return df.where(condition)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    slice_of: Column,
    order: Sequence[str],
    values: dict[str, Column],
) -> DataFrame:
    """Add, per name, the last non-null value of its expression strictly before the row in its group.

    slice_of must be non-decreasing in order within a group; the keys must not be NULL.
    """
    sliced = df.withColumn(SLICE, slice_of)
    for name, value in values.items():
        sliced = sliced.withColumn(f"_in_{name}", value)
    inside = (
        Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct(*order)
    tails = sliced.groupBy(*keys, SLICE).agg(*[
        F.max_by(f"_in_{name}", F.when(F.col(f"_in_{name}").isNotNull(), rank)).alias(f"_tail_{name}")
        for name in values
    ])
    carried = tails.select(*keys, SLICE, *[
        F.last(f"_tail_{name}", ignorenulls=True).over(before).alias(f"_carry_{name}") for name in values
    ])
    joined = sliced.join(carried, [*keys, SLICE])
    for name in values:
        local = F.last(f"_in_{name}", ignorenulls=True).over(inside)
        joined = joined.withColumn(name, F.coalesce(local, F.col(f"_carry_{name}")))
    return joined.select(*df.columns, *values)


def _cut_points(df: DataFrame, order: str, slices: int) -> list[float]:
    shares = [i / slices for i in range(1, slices)]
    found = df.agg(F.percentile_approx(F.col(order).cast("double"), shares, 1000).alias("cuts")).first()
    return sorted(set(found["cuts"] or []))


def running_totals(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    keys: Sequence[str] = (),
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Add cum_<value> (this row included) and all_<value> (the group's total) along a numeric order.

    Each (keys, order) must occur once, as after a groupBy on them. The order column is cut at its own
    approximate quantiles; these only balance the slices, the totals are exact.
    """
    keys = list(keys)
    if slices is None:
        slices = min(4096, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cut_points(df, order, slices)
    sliced = df.withColumn("_order", F.col(order).cast("double"))
    if cuts:
        edges = [float("-inf"), *cuts, float("inf")]
        sliced = Bucketizer(splits=edges, inputCol="_order", outputCol=SLICE).transform(sliced)
    else:
        sliced = sliced.withColumn(SLICE, F.lit(0.0))
    if descending:
        sliced = sliced.withColumn(SLICE, -F.col(SLICE))
    direction = F.desc(order) if descending else F.asc(order)
    inside = (
        Window.partitionBy(*keys, SLICE).orderBy(direction)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # One row per slice: at most 4096 rows of a group meet here.
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*keys, SLICE).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    offsets = offsets.select(
        *keys, SLICE,
        *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(group).alias(f"all_{v}") for v in values],
    )
    joined = sliced.join(offsets, [*keys, SLICE])
    return joined.select(
        *df.columns,
        *[(F.sum(v).over(inside) + F.col(f"_before_{v}")).alias(f"cum_{v}") for v in values],
        *[f"all_{v}" for v in values],
        SLICE,
    )


def next_values(
    df: DataFrame, order: str, values: Sequence[str], keys: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Add next_<value> from the following row of the group; takes the output of running_totals."""
    keys = list(keys)
    direction = F.desc(order) if descending else F.asc(order)
    inside = Window.partitionBy(*keys, SLICE).orderBy(direction)
    after = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE)
    first = F.max_by if descending else F.min_by
    heads = df.groupBy(*keys, SLICE).agg(*[first(v, order).alias(f"_head_{v}") for v in values])
    heads = heads.select(
        *keys, SLICE, *[F.lead(f"_head_{v}").over(after).alias(f"_next_{v}") for v in values]
    )
    joined = df.join(heads, [*keys, SLICE])
    for v in values:
        joined = joined.withColumn(
            f"next_{v}", F.coalesce(F.lead(v).over(inside), F.col(f"_next_{v}"))
        )
    return joined.select(*df.columns, *[f"next_{v}" for v in values])


def _digest_sliced(df: DataFrame, identity: Sequence[str], seed: int) -> DataFrame:
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity])
    return df.withColumn("_digest", F.md5(text)).withColumn(SLICE, F.substring("_digest", 1, 3))


def shuffled_head(df: DataFrame, keys: Sequence[str], identity: Sequence[str], most: int, seed: int = 42) -> DataFrame:
    """The rows of those slices of shuffled_rank that hold a group's first ranks up to most; these ranks stay as they are.

    The slices are found by counting; their list is stored, so that its size is known and only these rows are shuffled later.
    """
    keys = list(keys)
    sliced = _digest_sliced(df, identity, seed)
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    needed = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).where(F.col("_before") < most)
    return sliced.join(stored(needed.select(*keys, SLICE)), [*keys, SLICE]).select(*df.columns)


def shuffled_rank(
    df: DataFrame, keys: Sequence[str], identity: Sequence[str], seed: int = 42
) -> DataFrame:
    """Add shuffled_rank (from 1) and group_rows: the place of a row in a repeatable random order.

    The order is that of md5(seed|identity). Digests spread evenly, so their first three digits cut every
    group, however large, into even slices.
    """
    keys = list(keys)
    sliced = _digest_sliced(df, identity, seed)
    inside = Window.partitionBy(*keys, SLICE).orderBy("_digest", *identity)
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.select(
        *keys, SLICE,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(group).alias("group_rows"),
    )
    joined = sliced.join(counts, [*keys, SLICE])
    return joined.select(
        *df.columns,
        (F.row_number().over(inside) + F.col("_before")).alias("shuffled_rank"),
        "group_rows",
    )


def whole_number_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str, low_bits: int = 20
) -> DataFrame:
    """Exact median of a BIGINT per group of any size, as DOUBLE; keys must not be NULL.

    Two counting passes: first by the high bits of the value, then by the low bits inside the one or two
    high parts that hold the middle ranks. No task sees more than the distinct parts of a value.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(
        *keys,
        F.shiftright(F.col(value), low_bits).alias("_high"),
        F.col(value).bitwiseAND(F.lit((1 << low_bits) - 1)).alias("_low"),
    )
    group = Window.partitionBy(*keys)
    high = rows.groupBy(*keys, "_high").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(group)
    high = high.withColumn("_r1", F.floor((total + 1) / 2)).withColumn("_r2", F.floor((total + 2) / 2))
    through = group.orderBy("_high").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = high.withColumn("_through", F.sum("_n").over(through))
    parts = []
    for rank in ("_r1", "_r2"):
        holds = (F.col("_through") - F.col("_n") < F.col(rank)) & (F.col(rank) <= F.col("_through"))
        parts.append(high.where(holds).select(
            *keys, "_high", F.lit(rank).alias("_which"),
            (F.col(rank) - (F.col("_through") - F.col("_n"))).alias("_rank"),
        ))
    wanted = parts[0].unionByName(parts[1])
    low = rows.groupBy(*keys, "_high", "_low").agg(F.count(F.lit(1)).alias("_n"))
    low = low.join(wanted, [*keys, "_high"])
    inside = (
        Window.partitionBy(*keys, "_high", "_which").orderBy("_low")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    low = low.withColumn("_through", F.sum("_n").over(inside))
    found = low.where(
        (F.col("_through") - F.col("_n") < F.col("_rank")) & (F.col("_rank") <= F.col("_through"))
    )
    exact = F.shiftleft(F.col("_high"), low_bits) + F.col("_low")
    return found.groupBy(*keys).agg(F.avg(exact.cast("double")).alias(name))


def whole_number_mode(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties, from pre-aggregated counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("_n"), F.col(value))).cast("double").alias(name)
    )
