import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsight.operators.clean import MEDIAN_CANDIDATES, fit_medians
from flowsight.operators import clean as clean_module
from flowsight.operators.ordered import (
    carry_last, running_totals, shuffled_rank, whole_number_median, whole_number_mode,
)


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(5)
    key = np.where(rng.random(900) < 0.4, 0, rng.integers(1, 30, 900))
    return pd.DataFrame({"k": key.astype("int64"), "n": np.arange(900), "v": rng.integers(0, 5_000_000, 900), "flag": rng.random(900) < 0.3})


def test_carry_last(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = carry_last(df, ["k"], F.floor(F.col("n") / 37), ["n"], {"prev": F.col("n"), "marked": F.when(F.col("flag"), F.col("n"))})
    got = got.toPandas().sort_values("n").reset_index(drop=True)
    want = skewed.sort_values("n")
    prev = want.groupby("k")["n"].shift()
    marked = want.assign(m=want["n"].where(want["flag"])).groupby("k")["m"].apply(lambda s: s.ffill().shift()).reset_index(level=0, drop=True).sort_index()
    pd.testing.assert_series_equal(got["prev"].astype(float), prev.astype(float), check_names=False)
    pd.testing.assert_series_equal(got["marked"].astype(float), marked.astype(float), check_names=False)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, skewed, descending):
    counts = skewed.groupby(["k", "v"]).size().reset_index(name="c")
    got = running_totals(spark.createDataFrame(counts), "v", ["c"], ["k"], descending, slices=7).toPandas()
    want = counts.sort_values("v", ascending=not descending)
    want["cum_c"] = want.groupby("k")["c"].cumsum()
    both = got.merge(want, on=["k", "v"])
    assert len(both) == len(counts) and (both["cum_c_x"] == both["cum_c_y"]).all()
    assert got["all_c"].sum() == (counts.groupby("k")["c"].transform("sum")).sum()


def test_shuffled_rank_is_a_permutation(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = shuffled_rank(df, ["k"], ["n"]).toPandas()
    for _, group in got.groupby("k"):
        assert sorted(group["shuffled_rank"]) == list(range(1, len(group) + 1))
        assert set(group["group_rows"]) == {len(group)}
    again = shuffled_rank(df.repartition(3), ["k"], ["n"]).toPandas()
    assert dict(zip(got["n"], got["shuffled_rank"])) == dict(zip(again["n"], again["shuffled_rank"]))


def test_median_and_mode_of_large_groups(spark, skewed):
    df = spark.createDataFrame(skewed.assign(v=np.where(skewed["v"] % 3 == 0, 77, skewed["v"])))
    frame = df.toPandas()
    medians = {r.k: r.m for r in whole_number_median(df, ["k"], "v", "m", low_bits=12).collect()}
    assert medians == frame.groupby("k")["v"].median().to_dict()
    modes = {r.k: r.m for r in whole_number_mode(df, ["k"], "v", "m").collect()}
    assert modes == frame.groupby("k")["v"].agg(lambda s: s.mode().min()).astype(float).to_dict()


def test_exact_medians_by_narrowing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n = 4000
    frame = pd.DataFrame({
        "a": rng.lognormal(size=n), "b": rng.integers(0, 3, n).astype(float), "c": np.full(n, 5.0), "d": np.full(n, np.nan),
        "e": np.where(rng.random(n) < 0.5, 1.0, rng.random(n)),
    })
    df = spark.createDataFrame(frame).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in frame])
    want = {c: (None if c == "d" else frame[c].median()) for c in frame}
    assert MEDIAN_CANDIDATES > n and fit_medians(df, list(frame)) == pytest.approx(want)
    monkeypatch.setattr(clean_module, "MEDIAN_CANDIDATES", 10)
    assert fit_medians(df, list(frame)) == pytest.approx(want)
