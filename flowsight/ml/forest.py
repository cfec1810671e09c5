"""A random forest on a few features, grown from counts.

A tree sees a value only through its bin, so all that trees can learn of any number of rows is how many of each label lie in each
cell, a cell being one bin per feature. Rows are counted per cell once; the trees then grow side by side, each from the counts of its own
bootstrap. What a tree costs is bounded by the cells (bins to the power of the features), not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsight.operators.ordered import running_totals
from flowsight.runtime import cut_lineage, stored

#: Bins per feature, as many as the library's trees use by default.
BINS = 32
# Shares are rounded to this many digits before votes are compared, so that the order of their sum does not decide.
SHARE_DIGITS = 9


def bin_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Per feature the values at which a bin begins, at most bins - 1.

    The rule is the library's, on all rows in place of a sample: up to bins distinct values are all kept apart; otherwise a
    cut is made before the first value whose rows reach past the next equal share by more than they fall short of it.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    counts = cut_lineage(numbers.unpivot([], list(features), "feature", "value").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    distinct = {r["feature"]: r["n"] for r in counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = running_totals(counts, "value", ["n"], keys=["feature"])
    # Shares passed at the middle of a value's rows. The cuts of a share are among the first values past it, one value per cut.
    middle = F.col("cum_n") - F.col("n") / 2
    passed = F.ceil(middle * bins / F.col("all_n")) - 1
    first = Window.partitionBy("feature", "passed").orderBy("value")
    near = placed.withColumn("passed", passed).withColumn("at", F.row_number().over(first)).where(F.col("at") <= bins)
    values: dict[str, list[tuple[float, int, int]]] = {c: [] for c in features}
    for r in near.select("feature", "value", "passed", (F.col("cum_n") == F.col("n")).alias("lowest")).orderBy("feature", "value").collect():
        if not r["lowest"]:
            values[r["feature"]].append((r["value"], r["passed"]))
    cuts = []
    for c in features:
        found: list[float] = []
        for value, shares in values[c]:
            if distinct.get(c, 0) <= bins or (shares > len(found) and len(found) < bins - 1):
                found.append(value)
        cuts.append(found)
    return cuts


def _gini(benign: np.ndarray, malicious: np.ndarray) -> np.ndarray:
    total = np.maximum(benign + malicious, 1e-300)
    return 1.0 - (benign / total) ** 2 - (malicious / total) ** 2


def grow_tree(
    cells: np.ndarray, counts: np.ndarray, depth: int, tried: int, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """The share of label 1 in each cell's leaf, and the features' importances in this tree.

    cells holds a bin per feature, counts the rows of label 0 and 1. The tree grows level by level by Gini gain over tried features,
    drawn anew for each node; leaves that agree are merged into their parent. Cells without rows follow the splits.
    """
    width, features = int(cells.max()) + 1, cells.shape[1]
    node = np.zeros(len(cells), dtype=np.int64)
    totals, levels = [counts.sum(axis=0, keepdims=True)], []
    first, size = 0, 1
    for _ in range(depth):
        inside = np.flatnonzero(node >= first)
        at = node[inside] - first
        histogram = np.zeros((2, size, features, width))
        for f in range(features):
            slot = at * width + cells[inside, f]
            for label in range(2):
                histogram[label, :, f] = np.bincount(slot, counts[inside, label], size * width).reshape(size, width)
        left = np.cumsum(histogram, axis=3)[..., :-1]
        here = totals[-1].T[:, :, None, None]
        right = here - left
        n, n_left, n_right = here.sum(axis=0), left.sum(axis=0), right.sum(axis=0)
        gain = _gini(*here) - n_left / np.maximum(n, 1) * _gini(*left) - n_right / np.maximum(n, 1) * _gini(*right)
        drawn = np.argsort(np.argsort(rng.random((size, features)), axis=1), axis=1) < tried
        gain = np.where((n_left > 0) & (n_right > 0) & drawn[:, :, None], gain, -np.inf).reshape(size, -1)
        if gain.shape[1] == 0:
            break
        best = gain.argmax(axis=1)
        value = gain[np.arange(size), best]
        split = np.flatnonzero(value > 0)
        if not len(split):
            break
        feature, place = best // (width - 1), best % (width - 1)
        child = np.full(size, -1)
        child[split] = first + size + 2 * np.arange(len(split))
        levels.append((first, split, child[split], feature[split], value[split] * totals[-1][split].sum(axis=1)))
        moved = child[at] >= 0
        rows, at = inside[moved], at[moved]
        node[rows] = child[at] + (cells[rows, feature[at]] > place[at])
        lower = left.reshape(2, size, -1)[:, split, best[split]].T
        totals.append(np.stack([lower, totals[-1][split] - lower], axis=1).reshape(-1, 2))
        first, size = first + size, 2 * len(split)
    total = np.concatenate(totals)
    verdict, leaf = total[:, 1] > total[:, 0], np.ones(len(total), dtype=bool)
    importances = np.zeros(features)
    for start, split, child, feature, gained in reversed(levels):
        agree = leaf[child] & leaf[child + 1] & (verdict[child] == verdict[child + 1])
        leaf[start + split] = agree
        np.add.at(importances, feature[~agree], gained[~agree])
    owner = np.arange(len(total))
    for start, split, child, _, _ in levels:
        merged = leaf[start + split]
        owner[child[merged]] = owner[child[merged] + 1] = owner[start + split[merged]]
    kept = total[owner[node]]
    sums = kept.sum(axis=1)
    share = np.divide(kept[:, 1], sums, out=np.zeros(len(kept)), where=sums > 0)
    return share, importances / importances.sum() if importances.sum() > 0 else importances


@dataclass
class CellForest:
    """Trees by their verdict on each cell: votes (cell, p), p being the mean over the trees of the leaves' share of label 1."""

    features: list[str]
    cuts: list[list[float]]
    votes: DataFrame
    importances: list[float]

    def transform(self, df: DataFrame, pred: str = "pred") -> DataFrame:
        """Add the forest's verdict to rows of the table the forest was grown with."""
        voted = self.votes.select("cell", (F.col("p") > 0.5).cast("int").alias(pred))
        return with_cell(df, self.features, self.cuts).join(voted, "cell").select(*df.columns, pred)


def with_cell(df: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]]) -> DataFrame:
    """Add cell, the number of the combination of bins; rows must be complete."""
    bins = [f"_bin{i}" for i in range(len(features))]
    edges = [[float("-inf"), *found, float("inf")] for found in cuts]
    cut = [(c, b, e) for c, b, e in zip(features, bins, edges) if len(e) > 2]
    if cut:
        names, outputs, splits = map(list, zip(*cut))
        binned = Bucketizer(inputCols=names, outputCols=outputs, splitsArray=splits).transform(df)
    else:
        binned = df
    place: Column = F.lit(0).cast("bigint")
    for b, e in zip(bins, edges):
        place = place * (BINS + 1) + (F.col(b).cast("bigint") if len(e) > 2 else F.lit(0))
    return binned.withColumn("cell", place).drop(*bins)


def fit_forest(
    df: DataFrame, train: Column, features: Sequence[str], label: str = "label", trees: int = 100, depth: int = 30, seed: int = 42
) -> CellForest:
    """Grow a forest on the rows where train holds; every cell of the table gets its votes.

    A bootstrap draws each row a Poisson number of times; for the n equal rows of a cell and label that is one Poisson draw of
    mean n. Draws depend on the tree and the cells, not on how rows lie in partitions. Square root of the features, rounded up, are tried per split.
    """
    features = list(features)
    spark, tried = df.sparkSession, int(np.ceil(np.sqrt(len(features))))
    cuts = bin_cuts(df.where(train), features)
    of = lambda code: F.count_if(train & (F.col(label) == code))
    cells = with_cell(df, features, cuts).groupBy("cell").agg(of(0).alias("benign"), of(1).alias("malicious"))
    # A row of at most as many entries as there are cells, sent to every tree.
    table = cut_lineage(cells.agg(F.sort_array(F.collect_list(F.struct("cell", "benign", "malicious"))).alias("cells")).select(
        F.col("cells.cell").alias("cell"), F.col("cells.benign").alias("benign"), F.col("cells.malicious").alias("malicious")
    ))
    learned = table.select(F.aggregate("benign", F.lit(0).cast("bigint"), lambda a, n: a + n) + F.aggregate("malicious", F.lit(0).cast("bigint"), lambda a, n: a + n))
    if not learned.first()[0]:
        raise ValueError("no rows to train on")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rng = np.random.default_rng([seed, row.tree])
                rest, bins = np.asarray(row.cell, dtype=np.int64), []
                for _ in features:
                    rest, digit = np.divmod(rest, BINS + 1)
                    bins.insert(0, digit)
                drawn = rng.poisson(np.stack([row.benign, row.malicious], axis=1)).astype(float)
                share, importances = grow_tree(np.stack(bins, axis=1), drawn, depth, tried, rng)
                yield pd.DataFrame({"cell": [row.cell], "share": [share], "importances": [importances]})

    each = spark.range(0, trees, 1, trees).withColumnRenamed("id", "tree").crossJoin(F.broadcast(table))
    grown = stored(each.mapInPandas(grow, "cell array<bigint>, share array<double>, importances array<double>"))
    votes = grown.select(F.explode(F.arrays_zip("cell", "share")).alias("v")).groupBy("v.cell").agg(
        F.round(F.avg("v.share"), SHARE_DIGITS).alias("p")
    )
    sums = grown.agg(*[F.sum(F.get("importances", F.lit(i))).alias(f"i{i}") for i in range(len(features))]).first()
    whole = sum(sums)
    return CellForest(features, cuts, stored(votes.coalesce(1)), [s / whole if whole else 0.0 for s in sums])
