"""Verdicts read back from run logs, detection rates and the ranking of scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowsight.operators.ordered import carry_last, running_totals

# The line shapes of a predictor log, and the models to report on, best first.
HEADER_PATTERN = "\U0001F916[ \t]+([A-Za-z0-9_]+):"
BENIGN_PATTERN = "-[ \t]+Benign:[ \t]+([0-9]+)"
MALICIOUS_PATTERN = "-[ \t]+Malicious:[ \t]+([0-9]+)"
PREFERRED_MODELS = (
    "consensus", "random_forest", "logistic_regression", "gradient_boosting", "svm", "naive_bayes",
)

# Log lines of one file that are handled together.
SLICE_LINES = 4096


def _found(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))


def latest_files(files: DataFrame, keys: Sequence[str] = ("run", "scenario")) -> DataFrame:
    """The most recently modified file per scenario; files has path and modified."""
    return files.groupBy(*keys).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def parse_verdicts(logs: DataFrame) -> DataFrame:
    """(path, run, scenario, model, benign, malicious) from log lines.

    A model's header holds until the next one. A malicious count closes the pair if the last header or count
    before it is a benign count; anything else is ignored.
    """
    header, benign, malicious = _found(HEADER_PATTERN), _found(BENIGN_PATTERN), _found(MALICIOUS_PATTERN)
    kind = F.when(header.isNotNull(), "header").when(benign.isNotNull(), "benign").when(
        malicious.isNotNull(), "malicious"
    )
    events = logs.withColumns({
        "kind": kind, "model": F.lower(header), "count": F.coalesce(benign, malicious).cast("bigint"),
    }).where(F.col("kind").isNotNull())
    carried = carry_last(
        events, ["path"], F.floor(F.col("line_no") / SLICE_LINES), ["line_no"],
        {"current": F.when(F.col("kind") == "header", F.col("model")), "before": F.struct("kind", "count")},
    )
    pairs = carried.where(
        (F.col("kind") == "malicious") & F.col("current").isNotNull() & (F.col("before.kind") == "benign")
    )
    return pairs.select(
        "path", "run", "scenario", F.col("current").alias("model"), F.col("before.count").alias("benign"),
        F.col("count").alias("malicious"),
    )


def detection_rate(digits: int = 2) -> Column:
    """Percentage of malicious verdicts, NULL without any verdict."""
    total = F.col("benign") + F.col("malicious")
    return F.round(F.try_divide(F.col("malicious") * F.lit(100.0), total), digits)


def model_totals(verdicts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and detection rate per model over a run."""
    return verdicts.groupBy(*keys, "model").agg(
        F.sum("benign").alias("benign"), F.sum("malicious").alias("malicious")
    ).withColumns({"total": F.col("benign") + F.col("malicious"), "detection_rate": detection_rate()})


def scenario_rates(verdicts: DataFrame, preferred: Sequence[str] = PREFERRED_MODELS) -> DataFrame:
    """Detection rate of each scenario by the first of the preferred models that reports on it.

    Other models come last, by name. Scenarios without a verdict of that model are left out.
    """
    priority = F.lit(len(preferred))
    for place, model in enumerate(preferred):
        priority = F.when(F.col("model") == model, F.lit(place)).otherwise(priority)
    sums = model_totals(verdicts, ["scenario"]).withColumn("priority", priority)
    chosen = sums.groupBy("scenario").agg(
        F.min(F.struct("priority", "model", "benign", "malicious", "total")).alias("c")
    )
    rate = F.col("c.malicious") / F.col("c.total")
    return chosen.where(F.col("c.total") > 0).select(
        "scenario", "c.model", "c.benign", "c.malicious", "c.total", rate.alias("rate")
    )


def coverage_ranking(rates: DataFrame) -> DataFrame:
    """Scenarios with rank 1 for the lowest detection rate, the weakest coverage first; ties share a rank."""
    counts = rates.groupBy("rate").agg(F.count(F.lit(1)).alias("n"))
    ranks = running_totals(counts, "rate", ["n"]).select(
        "rate", (F.col("cum_n") - F.col("n") + 1).alias("rank")
    )
    return rates.join(ranks, "rate")


def weakest_scenario(rates: DataFrame) -> DataFrame:
    """The scenario with the lowest detection rate, by name on ties."""
    best = F.min(F.struct("rate", "scenario", "model")).alias("w")
    return rates.agg(best).select("w.scenario", "w.model", "w.rate")


def with_scenarios(rates: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Rates joined to the scenario's settings; scenario files are few, so Spark broadcasts them by size."""
    settings = scenarios.select(F.col("scenario"), "name", "description", "config.*")
    return rates.join(settings, "scenario", "left")
