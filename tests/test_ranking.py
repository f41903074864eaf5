import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from choicelab.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({
        "g": np.where(rng.random(4000) < 0.4, "big", rng.integers(0, 40, 4000).astype(str)),
        "k": rng.permutation(4000),
        "v": np.round(rng.normal(size=4000), 2),
    })
    frame.loc[frame.index[:700], "v"] = 0.25          # heavy ties
    return frame, spark.createDataFrame(frame).repartition(6)


@pytest.mark.parametrize("ranges", [13, 2])
@pytest.mark.parametrize("by", [["g"], []])
def test_row_index(skewed, ranges, by):
    frame, df = skewed
    got = ranking.row_index(df, by, ["k"], "n", ranges=ranges).toPandas().set_index("k")["n"]
    ordered = frame.sort_values("k")
    want = (ordered.groupby("g").cumcount() if by else pd.Series(range(len(ordered)), index=ordered.index)) + 1
    want.index = ordered["k"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False, check_dtype=False)


@pytest.mark.parametrize("ranges", [13, 2])
def test_previous_value(skewed, ranges):
    frame, df = skewed
    got = ranking.previous_value(df, ["g"], ["k"], "v", "p", ranges=ranges).toPandas().set_index("k")["p"]
    ordered = frame.sort_values("k")
    want = ordered.groupby("g")["v"].shift(1)
    want.index = ordered["k"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


@pytest.mark.parametrize("ranges", [13, 2])
@pytest.mark.parametrize("by", [["g"], []])
def test_exact_quantiles(skewed, ranges, by):
    frame, df = skewed
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 1.0]
    got = ranking.exact_quantiles(df, by, "v", probs, ranges=ranges).toPandas()
    if by:
        for _, row in got.iterrows():
            np.testing.assert_allclose(row["quantiles"], frame[frame.g == row["g"]]["v"].quantile(probs))
        assert len(got) == frame.g.nunique()
    else:
        assert len(got) == 1
        np.testing.assert_allclose(got["quantiles"][0], frame["v"].quantile(probs))


def test_null_group_is_kept(spark):
    rows = [(None, i) for i in range(30)] + [("a", i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, k int")
    got = ranking.row_index(df, ["g"], ["k"], "n", ranges=5).toPandas()
    assert len(got) == 33 and (got["n"] == got["k"] + 1).all()


def test_hot_group_of_equal_rows_is_spread(spark):
    """Rows that tie in group and order are dealt to several ranges, and their numbers are still 1..n."""
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'rare', 'hot') as g", "if(id % 3 = 0, id, 5) as k", "id").repartition(4)
    numbered = ranking.row_index(df, ["g"], ["k"], "n", ranges=6)
    got = numbered.toPandas()
    assert sorted(got[got.g == "hot"].n) == list(range(1, 2001)) and sorted(got[got.g == "rare"].n) == list(range(1, 1001))
    dealt = ranking.sorted_ranges(df, ["g"], ["k"], 6).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert dealt.max() < 1000
    assert ranking.row_index(df.limit(0), ["g"], ["k"], "n").count() == 0


def test_previous_value_may_be_null(spark):
    rows = [(g, k, None if k % 3 == 1 else float(k)) for g in (None, "a") for k in range(40)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(3)
    for ranges in (1, 9):
        got = {(r.g, r.k): r.p for r in ranking.previous_value(df, ["g"], ["k"], "v", "p", ranges=ranges).collect()}
        assert got == {(g, k): None if k == 0 or (k - 1) % 3 == 1 else float(k - 1) for g in (None, "a") for k in range(40)}
