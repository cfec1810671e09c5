"""Cleaning, imputing and label handling of flow tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, functions as F

from flowsight.functions.numeric import inf_to_null, nan_to_null, numbers
from flowsight.runtime import cut_lineage
from flowsight.schema import FEATURES, LABEL

# The two labels and their codes.
LABEL_CODES = {"Benign": 0, "Malicious": 1}

# A feature's exact median is read off in one aggregate once this many candidate values are left.
MEDIAN_CANDIDATES = 10_000
SKETCH_ACCURACY = 10_000
SKETCH_SLACK = 2.0 / SKETCH_ACCURACY


def clean(df: DataFrame, features: Sequence[str] = FEATURES, inf_as_missing: bool = True) -> DataFrame:
    """Features as DOUBLE; text that is no number, NaN and, if asked, infinities become NULL."""
    typed = df.withColumns(numbers(df, [c for c in features if c in df.columns]))
    if not inf_as_missing:
        return typed
    return typed.withColumns({c: inf_to_null(F.col(c)) for c in features if c in df.columns})


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a missing, NaN or infinite value in any column."""
    for field in df.schema.fields:
        value = F.col(field.name)
        if field.dataType.typeName() in ("double", "float"):
            value = inf_to_null(nan_to_null(value))
        # One condition per column: a single condition over all of them makes the optimizer derive every
        # combination of their equals.
        df = df.where(value.isNotNull())
    return df


def known_labels(df: DataFrame, label: str = LABEL, name: str = "label") -> DataFrame:
    """Keep rows labelled Benign or Malicious and add the code 0 or 1.

    Column names ignore case, so by default the code takes the place of Label.
    """
    code = F.lit(None).cast("int")
    for value, number in LABEL_CODES.items():
        code = F.when(F.col(label) == value, F.lit(number)).otherwise(code)
    return df.where(F.col(label).isin(*LABEL_CODES)).withColumn(name, code)


def encode_labels(df: DataFrame, label: str = LABEL, name: str = "label_idx") -> DataFrame:
    """Code any set of labels by alphabetical order, from 0."""
    indexer = StringIndexer(inputCol=label, outputCol="_code", stringOrderType="alphabetAsc")
    return indexer.fit(df).transform(df).withColumn(name, F.col("_code").cast("int")).drop("_code")


def label_counts(df: DataFrame, label: str = LABEL, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def fit_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """Exact median per feature over the whole table, None where all values are missing.

    Each of the two middle ranks of a feature is enclosed in an open interval that shrinks by a factor of
    thousands per round: mergeable sketches propose two values around the rank, counts tell whether the rank is
    at one of them or between. All features share the aggregates of a round, and the last aggregate
    sorts only the few values left, so the driver sees a handful of numbers per feature.
    """
    value = {c: F.col(c).cast("double") for c in features}
    sizes = df.agg(*[F.count(value[c]).alias(c) for c in features]).first()
    found: dict[tuple[str, int], float] = {}
    # (feature, rank) -> (open interval or None for everything, rows below it, rows inside it)
    open_ranks = {
        (c, rank): (None, 0, sizes[c]) for c in features if sizes[c] for rank in {(sizes[c] - 1) // 2, sizes[c] // 2}
    }
    inside = lambda c, band: value[c] if band is None else F.when(
        (value[c] > band[0]) & (value[c] < band[1]), value[c]
    )
    while wide := {t: state for t, state in open_ranks.items() if state[2] > MEDIAN_CANDIDATES}:
        sketches = []
        for i, ((c, rank), (band, below, within)) in enumerate(wide.items()):
            share = (rank - below + 0.5) / within
            around = [max(0.0, share - SKETCH_SLACK), min(1.0, share + SKETCH_SLACK)]
            sketches.append(F.percentile_approx(inside(c, band), around, SKETCH_ACCURACY).alias(f"s{i}"))
        proposed = df.agg(*sketches).first()
        counts = []
        for i, (c, _) in enumerate(wide):
            low, high = proposed[f"s{i}"]
            counts += [
                F.count_if(value[c] < low).alias(f"lt_low{i}"), F.count_if(value[c] <= low).alias(f"le_low{i}"),
                F.count_if(value[c] < high).alias(f"lt_high{i}"), F.count_if(value[c] <= high).alias(f"le_high{i}"),
            ]
        seen = df.agg(*counts).first()
        for i, (target, (band, below, within)) in enumerate(wide.items()):
            rank = target[1]
            low, high = proposed[f"s{i}"]
            floor, ceiling = band or (float("-inf"), float("inf"))
            if seen[f"lt_low{i}"] <= rank < seen[f"le_low{i}"]:
                found[target] = low
                del open_ranks[target]
            elif seen[f"lt_high{i}"] <= rank < seen[f"le_high{i}"]:
                found[target] = high
                del open_ranks[target]
            elif rank < seen[f"lt_low{i}"]:
                open_ranks[target] = ((floor, low), below, seen[f"lt_low{i}"] - below)
            elif rank >= seen[f"le_high{i}"]:
                done = seen[f"le_high{i}"]
                open_ranks[target] = ((high, ceiling), done, below + within - done)
            else:
                done = seen[f"le_low{i}"]
                open_ranks[target] = ((low, high), done, seen[f"lt_high{i}"] - done)
    if open_ranks:
        picks = [
            F.get(F.sort_array(F.collect_list(inside(c, band))), F.lit(rank - below)).alias(f"p{i}")
            for i, ((c, rank), (band, below, _)) in enumerate(open_ranks.items())
        ]
        row = df.agg(*picks).first()
        found.update({target: row[f"p{i}"] for i, target in enumerate(open_ranks)})
    middle = lambda c: [found[(c, rank)] for rank in ((sizes[c] - 1) // 2, sizes[c] // 2)]
    return {c: sum(middle(c)) / 2 if sizes[c] else None for c in features}


def fill(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Replace missing features by given medians; a feature without a median stays missing."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(value)) for c, value in medians.items() if value is not None
    })


def impute(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fill missing features with the medians of the table itself.

    Medians take several passes, so the rows are written to the checkpoint folder first.
    """
    stored = cut_lineage(df)
    return fill(stored, fit_medians(stored, features))
