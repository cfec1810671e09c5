"""Evaluation of verdicts and scores. Each function is one or two aggregates; scores are pre-aggregated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowsight.operators.ordered import next_values, running_totals
from flowsight.runtime import cut_lineage

CLASS_NAMES = ("Benign", "Malicious")


def _hits(truth: str, pred: str) -> dict[tuple[int, int], Column]:
    cell = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(pred) == p))
    return {(t, p): cell(t, p) for t in (0, 1) for p in (0, 1)}


def confusion(
    df: DataFrame, truth: str = "label", pred: str = "pred", classes: Sequence[int] = (0, 1)
) -> DataFrame:
    """(truth, pred, n) for every pair of classes, zero counts included."""
    pairs = [(t, p) for t in classes for p in classes]
    counts = df.agg(*[
        F.count_if((F.col(truth) == t) & (F.col(pred) == p)).alias(f"c{i}") for i, (t, p) in enumerate(pairs)
    ])
    cells = F.array(*[
        F.struct(F.lit(t).alias("truth"), F.lit(p).alias("pred"), F.col(f"c{i}").alias("n"))
        for i, (t, p) in enumerate(pairs)
    ])
    return counts.select(F.inline(cells))


def _or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def classification_report(
    df: DataFrame, truth: str = "label", pred: str = "pred", names: Sequence[str] = CLASS_NAMES
) -> DataFrame:
    """Rows per class, accuracy, macro and weighted averages: (name, precision, recall, f1, support)."""
    counts = df.agg(*[c.alias(f"t{t}p{p}") for (t, p), c in _hits(truth, pred).items()])
    per_class = {}
    for k, name in enumerate(names):
        right, predicted = F.col(f"t{k}p{k}"), F.col(f"t0p{k}") + F.col(f"t1p{k}")
        support = F.col(f"t{k}p0") + F.col(f"t{k}p1")
        precision, recall = _or_zero(right, predicted), _or_zero(right, support)
        per_class[name] = (
            precision, recall, _or_zero(2 * precision * recall, precision + recall), support,
        )
    total = F.col("t0p0") + F.col("t0p1") + F.col("t1p0") + F.col("t1p1")
    accuracy = _or_zero(F.col("t0p0") + F.col("t1p1"), total)
    average = lambda i: sum((v[i] for v in per_class.values()), F.lit(0.0)) / F.lit(float(len(per_class)))
    weighted = lambda i: _or_zero(sum((v[i] * v[3] for v in per_class.values()), F.lit(0.0)), total)
    row = lambda name, p, r, f, n: F.struct(
        F.lit(name).alias("name"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
        f.cast("double").alias("f1"), n.alias("support"),
    )
    rows = [row(name, *values) for name, values in per_class.items()]
    rows.append(row("accuracy", F.lit(None), F.lit(None), accuracy, total))
    rows.append(row("macro avg", *[average(i) for i in range(3)], total))
    rows.append(row("weighted avg", *[weighted(i) for i in range(3)], total))
    return counts.select(F.inline(F.array(*rows)))


def errors(df: DataFrame, kind: str, truth: str = "label", pred: str = "pred") -> DataFrame:
    """Rows of one kind of error: "fp" (benign called malicious) or "fn" (malicious called benign)."""
    want = {"fp": (0, 1), "fn": (1, 0)}[kind]
    return df.where((F.col(truth) == want[0]) & (F.col(pred) == want[1]))


def error_counts(df: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    hits = _hits(truth, pred)
    return df.agg(hits[(0, 1)].alias("false_positives"), hits[(1, 0)].alias("false_negatives"))


def sample_errors(df: DataFrame, kind: str, key: str, n: int = 5, **columns: str) -> DataFrame:
    """The first n errors by key, the same ones every time."""
    return errors(df, kind, **columns).orderBy(key).limit(n)


def accuracy_at(
    df: DataFrame, thresholds: Sequence[float], score: str = "p", truth: str = "label"
) -> DataFrame:
    """(threshold, accuracy) of the inclusive decision at each threshold."""
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.avg(((F.col(score) >= t).cast("int") == F.col(truth)).cast("double")).alias("accuracy"),
        )
        for t in thresholds
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def score_counts(
    df: DataFrame, score: str = "p", truth: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.where(F.col(score).isNotNull() & F.col(truth).isin(0, 1)).groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg")
    )


def _running_counts(df: DataFrame, score: str, truth: str, keys: list[str]) -> DataFrame:
    """Counts per score with their running totals. The counts are stored, since cut points, slices and totals read them."""
    counts = cut_lineage(score_counts(df, score, truth, keys))
    return running_totals(counts, "score", ["pos", "neg"], keys, descending=True)


def roc_curve(
    df: DataFrame, score: str = "p", truth: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """ROC points (keys, threshold, fpr, tpr, fp, tp) at distinct scores, without points on a straight line.

    The first point is (0, 0) at an infinite threshold. A rate without any row behind it is NULL.
    """
    keys = list(keys)
    points = _running_counts(df, score, truth, keys)
    points = next_values(points, "score", ["pos", "neg"], keys, descending=True)
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    straight = (F.col("pos") == F.col("next_pos")) & (F.col("neg") == F.col("next_neg"))
    kept = points.where(first | F.coalesce(~straight, F.lit(True)))
    rate = lambda part, whole: F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))
    shown = lambda threshold, fp, tp: F.struct(
        threshold.alias("threshold"), F.try_divide(fp.cast("double"), F.col("all_neg")).alias("fpr"),
        F.try_divide(tp.cast("double"), F.col("all_pos")).alias("tpr"), fp.alias("fp"), tp.alias("tp"),
    )
    zero = F.lit(0).cast("bigint")
    point = shown(F.col("score").cast("double"), F.col("cum_neg"), F.col("cum_pos"))
    start = shown(F.lit(float("inf")), zero, zero)
    return kept.select(*keys, F.inline(F.when(first, F.array(start, point)).otherwise(F.array(point))))


def auc(df: DataFrame, score: str = "p", truth: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve; ties count half. NULL with one class only."""
    keys = list(keys)
    points = _running_counts(df, score, truth, keys)
    above = F.col("cum_pos") - F.col("pos") / F.lit(2.0)
    return points.groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.col("neg") * above), F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
        ).alias("auc")
    )


def threshold_at_fpr(
    df: DataFrame, fpr: float | Sequence[float] = 0.01, score: str = "p", truth: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """The threshold whose false-positive rate is nearest the target, the highest on ties.

    Infinite when (0, 0) is nearest: such a model never fires. 0.5 when there are no scores. Several targets give a row
    each, with a column target, from one curve.
    """
    curve = roc_curve(df, score, truth, keys)

    def nearest(target: float) -> Column:
        distance = F.struct(F.abs(F.col("fpr") - F.lit(target)), -F.col("threshold"))
        return F.coalesce(F.min_by("threshold", distance), F.lit(0.5))

    if not isinstance(fpr, Sequence):
        return curve.groupBy(*keys).agg(nearest(fpr).alias("threshold"))
    each = F.array(*[F.struct(F.lit(float(t)).alias("target"), nearest(t).alias("threshold")) for t in fpr])
    return curve.groupBy(*keys).agg(each.alias("_each")).select(*keys, F.inline("_each"))
