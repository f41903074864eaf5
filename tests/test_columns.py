import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicelab.functions import columns as fc
from choicelab.functions import conditions as cond
from choicelab.functions import value
from choicelab.operators import shaping


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(spark, values, build, kind="string"):
    rows = column(spark, values, kind).select("i", build(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


def test_to_number(spark):
    got = apply(spark, ["3", " 4.5 ", "1e3", "-.5", "abc", "", None, "3d", "1F", "0x1p3", "nan", "inf", "m3"], fc.to_number)
    assert got == [3.0, 4.5, 1000.0, -0.5, None, None, None, None, None, None, None, math.inf, None]


def test_parse_levels(spark):
    assert apply(spark, ["m3", "m12", "p3", None, "mx"], lambda c: fc.parse_prefixed_int(c, "m")) == [3, 12, None, None, None]
    assert apply(spark, ["'m3'", "m4", None, "?"], fc.parse_level_strip) == [3, 4, None, None]


def test_labels_and_names(spark):
    assert apply(spark, [7, 125, 12345], fc.numbered_label, "int") == ["trial_007", "trial_125", "trial_12345"]
    got = apply(spark, ["v_x:C(f)[T.M]", "a[T.low_OV]", "b[T.P]", "T.Q"], fc.sanitize_name)
    assert got == ["v_x_C_f__T_M_", "a_T_low_OV_", "b_T_P_", "T.Q"]
    assert apply(spark, ["Comment/on", "on", "off", None], lambda c: fc.recode(c, {"on": 2}, "Comment/")) == [2, 2, None, None]


def test_reverse_score_is_an_involution(spark):
    once = apply(spark, [1, 2, 3, 4, 5, None], fc.reverse_score, "int")
    assert once == [4, 3, 2, 1, 5, None]
    assert apply(spark, once, fc.reverse_score, "int") == [1, 2, 3, 4, 5, None]


def test_conditions_cover_every_offer(spark):
    levels = range(1, 6)
    df = spark.createDataFrame([(m, p) for m in levels for p in levels] + [(None, 3)], "moneylevel int, painlevel int")
    for r in shaping.add_conditions(df).collect():
        m, p = r["moneylevel"], r["painlevel"]
        if m is None:
            assert all(r[c] is None for c in cond.CONDITIONS)
            continue
        side = "_h_money" if m > p else "_h_pain"
        gap = abs(m - p)
        size = "low_abs" if gap < 2 else "high_abs" if gap > 2 else "mid_abs"
        assert r["acceptance_pair"] == ("I" if m == p else "M" if m > p else "P")
        assert r["OV_value"] == ("low_OV" if m + p <= 5 else "high_OV")
        assert r["Abs_value"] == size
        assert r["OV_Money_Pain"] == ("low_OV" if m + p <= 5 else "h_OV") + side
        assert r["Abs_Money_Pain"] == (size if size == "mid_abs" else size + side)


def test_flag_component(spark):
    df = spark.createDataFrame([("brain", 0.9), ("eye blink", 0.71), ("eye blink", 0.7), ("other", 1.0)], "l string, p double")
    got = [r["f"] for r in df.select(cond.flag_component(F.col("l"), F.col("p")).alias("f")).collect()]
    assert got == [False, True, False, True]


@pytest.mark.parametrize("form,want", [
    ("none", 0.1 * 3), ("linear", 0.1 * 0.5 * 3), ("para", 0.1 * 0.5 * 9), ("cubic", 0.1 * 0.5 * 27),
    ("hyper", 0.1 / (1 - 0.5 * 3)), ("expo", math.exp(0.15)), ("root", math.sqrt(0.15)), ("logarithmic", math.log(0.15))])
def test_value_forms(spark, form, want):
    got = spark.range(1).select(value.sv_pain(F.lit(0.5), F.lit(3), form).alias("v")).first()["v"]
    assert got == pytest.approx(want)


def test_value_domains(spark):
    row = spark.range(1).select(value.sv_pain(F.lit(0.5), F.lit(2), "hyper").alias("pole"),
                                value.sv_pain(F.lit(0.0), F.lit(2), "logarithmic").alias("log0"),
                                value.accept_probability(F.lit(10.0), F.lit(-3.0)).alias("p"),
                                value.accept_logit(F.lit(10.0), F.lit(-3.0)).alias("l")).first()
    assert row["pole"] is None and row["log0"] is None
    assert math.log(row["p"] / (1 - row["p"])) == pytest.approx(row["l"])


def test_bernoulli_loglik_is_stable(spark):
    rows = spark.createDataFrame([(1, 2.0), (0, 2.0), (1, -800.0), (0, 800.0)], "a int, l double")
    got = [r["v"] for r in rows.select(value.bernoulli_loglik(F.col("a"), F.col("l")).alias("v")).collect()]
    np.testing.assert_allclose(got, [-math.log1p(math.exp(-2)), -2 - math.log1p(math.exp(-2)), -800, -800])


def test_registered_form(spark):
    value.register_form("double", lambda k, pain: 2.0 * k * pain)
    try:
        assert spark.range(1).select(value.sv_pain(F.lit(0.5), F.lit(3), "double").alias("v")).first()["v"] == 3.0
    finally:
        del value.FORMS["double"]


def test_shaping(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (2, None, 1.0), (3, "c", 2.0)], "k int, s string, `d.x` double")
    assert [r["k"] for r in shaping.drop_incomplete(df, ["s", "d.x"]).collect()] == [3]
    assert shaping.columns_containing(df, ".x") == ["d.x"]
    assert shaping.drop_columns_containing(df, ".x").columns == ["k", "s"]
    names = spark.createDataFrame([("s", " text "), ("absent", "q")], "old string, new string")
    assert shaping.rename_by_lookup(df, names).columns == ["k", "text", "d.x"]
    both = shaping.union_rows(df.select("k"), df.select("k", "s"))
    assert both.filter("s is null").count() == 4
    assert [r["k"] for r in shaping.tail(df, 2, ["k"]).collect()] == [2, 3]
    assert shaping.row_sum(df, ["k", "d.x"], "t").filter("k = 2").first()["t"] == 3.0
    events = spark.createDataFrame([(1, "on"), (99999, "New Segment"), (None, "DIN7"), (None, None)], "code int, label string")
    assert shaping.drop_event_codes(events, [99999], ["DIN7"]).count() == 2
