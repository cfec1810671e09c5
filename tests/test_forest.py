import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowsight.ml.forest import BINS, bin_cuts, fit_forest, grow_tree


def plain_cuts(values):
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) <= BINS:
        return list(distinct[1:])
    cuts, stride = [], len(values) / BINS
    target, so_far = stride, counts[0]
    for value, n in zip(distinct[1:], counts[1:]):
        before, so_far = so_far, so_far + n
        if abs(before - target) < abs(so_far - target):
            cuts.append(value)
            target += stride
    return cuts


def test_cuts_follow_the_rule_on_all_rows(spark):
    rng = np.random.default_rng(4)
    columns = {"even": rng.random(700), "heavy": np.where(rng.random(700) < 0.5, 0.0, rng.gamma(2, size=700)), "few": rng.integers(0, 32, 700) * 1.0, "one": np.full(700, 3.0)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], list(columns)).repartition(5)
    assert bin_cuts(df, list(columns)) == [plain_cuts(v) for v in columns.values()]


def test_tree_is_the_librarys(spark):
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 8, (900, 3))
    label = (rows[:, 0] * rows[:, 1] + rng.integers(0, 20, 900) > 22).astype(int)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame([(*map(float, r), int(y)) for r, y in zip(rows, label)], "a double, b double, c double, label int")
    )
    tree = DecisionTreeClassifier(maxDepth=30).fit(df)
    theirs = {(r.a, r.b, r.c): r.p for r in tree.transform(df).select("a", "b", "c", vector_to_array("probability")[1].alias("p")).collect()}
    cells, at = np.unique(rows, axis=0, return_inverse=True)
    counts = np.stack([np.bincount(at.ravel(), label == y, len(cells)) for y in (0, 1)], axis=1)
    share, importances = grow_tree(cells, counts, 30, 3, np.random.default_rng(0))
    assert share == pytest.approx([theirs[tuple(map(float, c))] for c in cells])
    assert importances == pytest.approx(tree.featureImportances.toArray())


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):
        a, b, c = (float(v) for v in rng.normal(size=3))
        rows.append((i, a, b, c, int(a + 0.5 * b + 0.4 * rng.normal() > 0)))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int")


def test_forest_agrees_with_the_librarys(table):
    train = F.col("id") % 3 > 0
    forest = fit_forest(table, train, ["a", "b", "c"], trees=40)
    held = forest.transform(table.where(~train))
    assert held.count() == 500 and held.columns == [*table.columns, "pred"]
    accuracy = held.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(table)
    library = RandomForestClassifier(numTrees=40, maxDepth=30, featureSubsetStrategy="sqrt", seed=42).fit(vectors.where(train))
    theirs = library.transform(vectors.where(~train)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert abs(accuracy - theirs) < 0.03
    assert forest.importances == pytest.approx(library.featureImportances.toArray(), abs=0.03)


def test_draws_do_not_depend_on_where_rows_lie(table):
    """Trees come from counts per cell; the library's bootstrap takes rows by partition and gave another forest for each layout."""
    votes = [
        {r.cell: r.p for r in fit_forest(rows, F.col("id") % 3 > 0, ["a", "b", "c"], trees=10).votes.collect()}
        for rows in (table.coalesce(1), table.repartition(7, "label"))
    ]
    assert votes[0] == votes[1]


def test_nothing_to_train_on(table):
    with pytest.raises(ValueError):
        fit_forest(table, F.lit(False), ["a", "b", "c"], trees=2)
