"""Joins, aggregates and windows against pandas on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from choicelab.operators import aggregates as ag
from choicelab.operators import joins, windows


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 600
    who = np.where(rng.random(n) < 0.4, 1, rng.integers(2, 9, n))
    return pd.DataFrame({"participant": who, "k": rng.permutation(n), "x": np.round(rng.normal(size=n), 2),
                         "y": rng.normal(size=n), "accepted": rng.integers(0, 2, n)})


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(5)


@pytest.mark.parametrize("ranges", [17, None])
def test_describe(df, frame, ranges):
    got = ag.describe(df, "x", ["participant"], ranges).toPandas().set_index("participant").sort_index()
    want = frame.groupby("participant")["x"].describe()
    np.testing.assert_allclose(got[["count", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float), want)


@pytest.mark.parametrize("ranges", [17, None])
@pytest.mark.parametrize("by", [[], ["participant"]])
def test_quantile_bins_equal_qcut(df, frame, ranges, by):
    got = windows.quantile_bins(df, "y", 4, by, ranges=ranges).toPandas().set_index("k")["bin"].sort_index()
    cut = lambda s: pd.qcut(s, 4, labels=False)
    want = frame.set_index("k").groupby("participant")["y"].transform(cut) if by else cut(frame.set_index("k")["y"])
    assert (got == want.sort_index()).all()


def test_bin_table(df, frame):
    got = windows.bin_table(df, "y", 2).toPandas().sort_values("bin")
    bins, edges = pd.qcut(frame["y"], 2, labels=False, retbins=True)
    assert got["n"].tolist() == bins.value_counts().sort_index().tolist()
    np.testing.assert_allclose(got["lower"], edges[:-1])
    np.testing.assert_allclose(got["upper"], edges[1:])


def test_zscore(df, frame):
    z = windows.zscore(df, ["x"], ["participant"]).toPandas()
    moments = z.groupby("participant")["x_z"]
    np.testing.assert_allclose(moments.mean(), 0, atol=1e-12)
    np.testing.assert_allclose(moments.std(ddof=0), 1)
    whole = windows.zscore(df, ["x"], []).toPandas()["x_z"]
    assert whole.mean() == pytest.approx(0, abs=1e-12) and whole.std(ddof=0) == pytest.approx(1)


def test_zscore_without_variance(spark):
    flat = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 5.0)], "g int, x double")
    assert windows.zscore(flat, ["x"], ["g"]).filter("x_z is not null").count() == 0


def test_histogram_counts_and_closed_end(df, frame, spark):
    got = ag.histogram_by(df, "participant", "y", 7).toPandas()
    for who, rows in got.groupby("participant"):
        want = np.histogram(frame[frame.participant == who]["y"], bins=7)[0]
        dense = np.zeros(7, int)
        dense[rows["bin"]] = rows["n"]
        assert dense.tolist() == want.tolist()
    flat = spark.createDataFrame([(1, 3.0), (1, 3.0)], "participant int, y double")
    assert [tuple(r) for r in ag.histogram_by(flat, "participant", "y", 20).collect()] == [(1, 10, 2)]


def test_exclusion(spark):
    rows = [("a", 1)] * 124 + [("a", 0)] + [("b", 1)] * 100 + [("c", None)] * 3
    df = spark.createDataFrame(rows, "participant string, accepted int")
    kept = ag.exclude_subjects(df)
    assert sorted(r[0] for r in kept.select("participant").distinct().collect()) == ["b", "c"]
    assert ag.exclude_subjects(df, n_trials=None, share=0.999).select("participant").distinct().count() == 2
    assert ag.exclude_subjects(df, among=["b"]).count() == 100
    assert ag.keep_subjects(df, 0.995).select("participant").distinct().count() == 1


def test_correlation_matrix_is_pairwise_complete(spark, frame):
    broken = frame[["x", "y"]].copy()
    broken["flat"] = 1.0
    broken.loc[:50, "y"] = np.nan
    df = spark.createDataFrame(broken).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = {(r["a"], r["b"]): r["r"] for r in ag.correlation_matrix(df, ["x", "y", "flat"]).collect()}
    want = broken[["x", "y"]].corr()
    assert got["x", "y"] == pytest.approx(want.loc["x", "y"])
    assert got["x", "x"] == pytest.approx(1) and got["x", "flat"] is None and got["flat", "flat"] is None


def test_label_encode(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "x"), ("c", "x"), ("a", "x")], "s string, t string")
    got = sorted(map(tuple, ag.label_encode(df, ["s", "t"]).collect()), key=str)
    assert got == sorted([(1, 0), (0, 1), (None, 0), (2, 0), (0, 0)], key=str)


def test_rating_accuracy_and_pearson(spark):
    df = spark.createDataFrame([(1, 2.9, 40, 1.0), (1, 1.0, 40, 2.0), (1, None, 20, 3.0), (2, 5.0, 100, 1.0)],
                               "g int, rating double, level int, z double")
    got = {r["g"]: (r["accuracy"], r["n"]) for r in ag.rating_accuracy(df, "rating", "level", 20, ["g"]).collect()}
    assert got == {1: (0.5, 2), 2: (1.0, 1)}
    r = {x["g"]: x["r"] for x in ag.pearson(df, "rating", "z", ["g"]).collect()}
    assert r[1] == pytest.approx(-1) and r[2] is None


def test_zip_columns_pads(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a")], "k int, v string")
    b = spark.createDataFrame([(9, "z"), (7, "x"), (8, "y")], "q int, v string")
    got = joins.zip_columns(a, b, ["k"], ["q"])
    assert got.columns == ["k", "v", "q", "v_2"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "a", 7, "x"), (3, "c", 8, "y"), (None, None, 9, "z")], key=str)


@pytest.mark.parametrize("bucket", [None, 3.0, 100.0])
def test_epoch_join(spark, bucket):
    rng = np.random.default_rng(1)
    samples = pd.DataFrame({"rec": rng.integers(0, 3, 300), "t": rng.uniform(-50, 50, 300)})
    events = pd.DataFrame({"rec": rng.integers(0, 3, 20), "e": rng.uniform(-50, 50, 20), "id": range(20)})
    got = joins.epoch_join(spark.createDataFrame(samples), spark.createDataFrame(events), ["rec"], "t", "e", -2.0, 5.5, bucket)
    pairs = samples.merge(events, on="rec")
    want = pairs[(pairs.t >= pairs.e - 2) & (pairs.t <= pairs.e + 5.5)]
    assert sorted((r["id"], r["t"]) for r in got.collect()) == sorted(zip(want["id"], want["t"]))


def test_nearest_time_ties(spark):
    times = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "t double")
    got = {r["target"]: r["nearest"] for r in joins.nearest_time(times, [0.25, 0.9, 7.0], "t").collect()}
    assert got == {0.25: 0.0, 0.9: 1.0, 7.0: 1.0}


def test_contribution(spark):
    trials = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 3.0), (9, 1.0)], "s int, x double")
    draws = spark.createDataFrame([("v", 1, 0.1), ("v", 1, 0.3), ("v", 2, 1.0), ("a", 1, 5.0)], "param string, s int, value double")
    got = joins.contribution(trials, draws, {"c": ("v", "x"), "m": ("a", "x")}, "s", mask={"m": F.col("x") > 3})
    rows = {(r["s"], r["x"]): (r["c"], r["m"]) for r in got.collect()}
    assert rows[1, 2.0] == (pytest.approx(0.4), None) and rows[1, 4.0] == (pytest.approx(0.8), 20.0)
    assert rows[2, 3.0] == (3.0, None) and rows[9, 1.0] == (None, None)


@pytest.mark.parametrize("ranges", [17, None])
def test_event_gaps_and_cooldown(spark, df, frame, ranges):
    got = windows.event_gaps(df, ["participant"], "k", ranges=ranges).toPandas().set_index("k")["diff"].sort_index()
    want = frame.sort_values("k").groupby("participant")["k"].diff().fillna(0)
    want.index = frame.sort_values("k")["k"]
    assert (got == want).all()
    rows = spark.createDataFrame([(1, 1, 5.0, 2.0), (1, 2, 7.0, None), (1, 3, 9.0, 4.0)], "g int, o int, on double, b double")
    cool = windows.cooldown_gap(rows, ["g"], ["o"], "on", "b").toPandas().sort_values("o", na_position="last")["cooldown"]
    np.testing.assert_allclose(cool, [5.0, 5.0, np.nan, -4.0])


def test_timing_error_pads(spark):
    gaps = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0)], "g int, o int, d double")
    logged = spark.createDataFrame([(1, 5, 9.0)], "g int, o int, l double")
    got = windows.timing_error(gaps, logged, ["g"], "d", ["o"], "l", ["o"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 1.0), (1, 2, None)], key=str)


def test_small_aggregates(spark):
    df = spark.createDataFrame([("s1", 1, 1, 4.0, 0), ("s1", 2, 1, 6.0, 1), ("s2", 1, 2, 1.0, 0)],
                               "participant string, o int, lvl int, v double, badtrial int")
    assert {r["participant"]: r["perc_removed"] for r in ag.rejection_stats(df, n_trials=4).collect()} == {"s1": 75.0, "s2": 75.0}
    first = ag.first_value_by(df, ["participant"], ["o"], ["lvl", "v"])
    assert {r["participant"]: r["v"] for r in first.collect()} == {"s1": 4.0, "s2": 1.0}
    grand = ag.grand_average(df, "participant", ["o"], "v").filter("o = 1").first()
    assert (grand["v"], grand["n_subjects"]) == (2.5, 2)
    wide = ag.heatmap(df, "o", "lvl", "v", [1, 2, 3], "l")
    assert [tuple(r) for r in wide.collect()] == [(1, 4.0, 1.0, None), (2, 6.0, None, None)]
    ranked = ag.rank_models(spark.createDataFrame([("a", 100.0), ("b", 9.0)], "m string, dic double"), "dic")
    assert {r["m"]: r["rank"] for r in ranked.collect()} == {"b": 0, "a": 1}


@pytest.mark.parametrize("ranges", [17, None])
def test_block_trial_index(df, frame, ranges):
    got = windows.block_trial_index(df, ["participant"], ["k"], 25, ranges).toPandas().set_index("k").sort_index()
    place = frame.sort_values("k").groupby("participant").cumcount().to_numpy()
    assert (got["blocks_idx"].to_numpy() == place // 25).all() and (got["trialblocks"].to_numpy() == place % 25).all()


def test_null_groups_and_missing_numbers(spark):
    rows = [(g, float(x)) for g in ("a", None) for x in (1, 2, 3, 4, 5, 5)] + [("n", x) for x in (1.0, 2.0, 3.0, float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: tuple(r)[1:] for r in ag.describe(df, "x", ["g"]).collect()}
    assert got[None] == got["a"] and got["n"] == (3, 2.0, 1.0, 1.0, 1.5, 2.0, 2.5, 3.0)
    bins = {g: sorted((r.bin, r.n) for r in ag.histogram_by(df.filter("x = x"), "g", "x", 4).collect() if r.g == g) for g in ("a", None)}
    assert bins[None] == bins["a"] and len(bins["a"]) == 4
    z = windows.zscore(df.filter("g is null or g = 'a'"), ["x"], ["g"]).collect()
    assert sorted(r.x_z for r in z if r.g is None) == pytest.approx(sorted(r.x_z for r in z if r.g == "a"))
