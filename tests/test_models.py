import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from choicelab.functions import diffusion, value
from choicelab.functions.design import Factor, crossed, design_columns
from choicelab.operators import models
from choicelab.plans.catalog import MODELS, model_catalog

FF = Factor("f", ("a", "b", "c"))
G = Factor("g", ("x", "y"))


def test_design_names(spark):
    assert list(design_columns([("n",), ("n", FF)])) == ["Intercept", "n", "n:C(f)[T.b]", "n:C(f)[T.c]"]
    assert list(design_columns([("n", FF)])) == ["Intercept", "n:C(f)[a]", "n:C(f)[b]", "n:C(f)[c]"]
    assert list(design_columns([(FF,)], intercept=False)) == ["C(f)[a]", "C(f)[b]", "C(f)[c]"]
    assert len(design_columns([("n", FF, G)], intercept=False)) == 6
    ref = Factor("f", ("a", "b", "c"), "b")
    assert list(design_columns([(ref,)])) == ["Intercept", "C(f, Treatment('b'))[T.a]", "C(f, Treatment('b'))[T.c]"]
    assert crossed("a", "b") == [("a",), ("b",), ("a", "b")]
    assert len(crossed("a", "b", "c", "d")) == 15


@pytest.mark.parametrize("terms,intercept", [
    ([(FF,), (G,), (FF, G)], True), ([(FF, G)], True), ([(FF, G)], False), (crossed("n", FF, G), False),
    ([("n", FF, G)], False), ([("n",), ("n", FF), ("n", G), ("n", FF, G)], True)])
def test_design_is_full_rank_and_spans_the_cells(spark, terms, intercept):
    rows = [(f, g, float(n)) for f in FF.levels for g in G.levels for n in (1, 2, 4)]
    df = spark.createDataFrame(rows, "f string, g string, n double")
    cols = design_columns(terms, intercept)
    x = np.array([list(r) for r in df.select(*[e.alias(k) for k, e in cols.items()]).collect()])
    assert np.linalg.matrix_rank(x) == x.shape[1]
    numeric = any("n" in t for t in terms)
    plain = any("n" not in t for t in terms) or intercept
    cells = x.shape[1]
    assert cells <= 6 * (numeric + plain)
    if intercept is False and not numeric or terms == crossed("n", FF, G):
        assert cells == 6 * (numeric + plain)


def test_catalog(spark):
    rows = model_catalog(spark).collect()
    versions = {r["version"] for r in rows}
    assert len(versions) == 54 and versions == set(range(57)) - {30, 31, 32}
    text = {(r["version"], r["parameter"]): r["formula"] for r in rows}
    assert text[1, "v"] == "v ~ 1 + sv_pain_para"
    assert text[12, "z"] == "z ~ 1 + sv_pain_para + sv_money"
    assert text[23, "v"] == "v ~ 0 + sv_pain_para:C(OV_value):C(Abs_value)"
    assert text[46, "t"] == "t ~ 0 + STA_SAI_Score:sv_pain_para:C(Abs_value)"
    assert (0, None) in text and len(MODELS[56]["a"][1]) == 15


def test_ez_recovers_parameters(spark):
    """Moments implied by known parameters give the parameters back."""
    cases = [(0.8, 1.6, 0.3), (2.0, 1.2, 0.25), (-1.0, 1.4, 0.4)]
    rows = []
    for v, a, t in cases:
        y = -v * a
        p = 1 / (1 + np.exp(y))
        mdt = (a / (2 * v)) * (1 - np.exp(y)) / (1 + np.exp(y))
        var = (a / (2 * v**3)) * (2 * y * np.exp(y) - np.exp(2 * y) + 1) / (np.exp(y) + 1) ** 2
        rows.append((v, a, t, float(p), 10**6, float(t + mdt), float(var)))
    df = spark.createDataFrame(rows, "v0 double, a0 double, t0 double, p double, n int, m double, s double")
    fit = diffusion.ez_parameters(F.col("p"), F.col("n"), F.col("m"), F.col("s"))
    for r in df.withColumns(fit).collect():
        assert (r["v"], r["a"], r["t"]) == (pytest.approx(r["v0"]), pytest.approx(r["a0"]), pytest.approx(r["t0"]))


def test_ez_edges(spark):
    rows = [("none", 0, 0.5), ("none", 0, 0.6)] + [("all", 1, 0.5 + i / 10) for i in range(4)]
    rows += [("half", i % 2, 0.4 + i / 20) for i in range(8)] + [("one", 1, 0.7)] + [("flat", 1, 0.5)] * 3
    got = {r["c"]: r for r in models.ez_diffusion(spark.createDataFrame(rows, "c string, accepted int, rt double"), ["c"]).collect()}
    assert got["none"]["v"] is None and got["one"]["v"] is None and got["flat"]["v"] is None
    assert got["all"]["v"] > 0 and got["all"]["a"] > 0
    assert got["half"]["v"] is not None and np.isfinite(got["half"]["t"])


def density(t, resp, v, a, t0, z, terms=200):
    """Large-time series with many terms."""
    if resp == 1:
        v, z = -v, 1 - z
    t = t - t0
    if t <= 0:
        return 0.0
    k = np.arange(1, terms)
    s = (k * np.exp(-(k**2) * np.pi**2 * t / (2 * a * a)) * np.sin(k * np.pi * z)).sum()
    return float(np.pi / a**2 * s * np.exp(-v * a * z - v * v * t / 2))


def test_wiener_density(spark):
    rng = np.random.default_rng(8)
    rows = [(float(rng.uniform(0.21, 4)), int(rng.integers(0, 2)), float(rng.normal(0, 2)), float(rng.uniform(0.6, 3)), 0.2,
             float(rng.uniform(0.2, 0.8))) for _ in range(300)] + [(0.1, 1, 1.0, 1.0, 0.2, 0.5), (0.2, 0, 1.0, 1.0, 0.2, 0.5)]
    df = spark.createDataFrame(rows, "rt double, r int, v double, a double, t double, z double")
    got = df.select("*", diffusion.wiener_density(*[F.col(c) for c in ("rt", "r", "v", "a", "t", "z")]).alias("d")).collect()
    want = [density(*r[:6]) if (r["rt"] - r["t"]) / r["a"] ** 2 > 0.003 else None for r in got]
    for g, w in zip(got, want):
        if w is not None:
            assert g["d"] == pytest.approx(w, rel=1e-6, abs=1e-8)


def test_wiener_density_is_a_density(spark):
    t = np.arange(0.2, 12, 0.002)
    df = spark.createDataFrame([(float(x), r) for x in t for r in (0, 1)], "rt double, r int")
    d = diffusion.wiener_density(F.col("rt"), F.col("r"), F.lit(0.7), F.lit(1.5), F.lit(0.2), F.lit(0.45))
    mass = {r["r"]: r["m"] * 0.002 for r in df.groupBy("r").agg(F.sum(d).alias("m")).collect()}
    up = (1 - np.exp(-2 * 0.7 * 1.5 * 0.45)) / (1 - np.exp(-2 * 0.7 * 1.5))
    assert mass[1] == pytest.approx(up, abs=2e-3) and mass[0] == pytest.approx(1 - up, abs=2e-3)


def test_wiener_grid(spark):
    trials = spark.createDataFrame([("p", 1, 0.6), ("p", 0, 0.9), ("q", 1, 0.5), ("q", None, 0.5)], "s string, accepted int, rt double")
    grid = models.wiener_grid(trials, ["s"], [0.5, 1.5], [1.0], [0.1, 0.2], [0.5])
    rows = grid.collect()
    assert len(rows) == 8
    for r in rows:
        mine = [("p", 1, 0.6), ("p", 0, 0.9)] if r["s"] == "p" else [("q", 1, 0.5)]
        want = sum(np.log(0.95 * density(t, c, r["v"], r["a"], r["t"], r["z"]) + 0.005) for _, c, t in mine)
        assert r["loglik"] == pytest.approx(want)
    best = {r["s"]: r for r in models.wiener_params(grid, ["s"]).collect()}
    top = max((r for r in rows if r["s"] == "p"), key=lambda r: r["loglik"])
    assert (best["p"]["v_map"], best["p"]["t_map"]) == (top["v"], top["t"])
    at = models.loglik_at(trials, best_as_params(spark, best), ["s"]).collect()
    assert {r["s"]: r["loglik"] for r in at}["p"] == pytest.approx(top["loglik"])


def best_as_params(spark, best):
    return spark.createDataFrame([(s, r["v_map"], r["a_map"], r["t_map"], r["z_map"]) for s, r in best.items()],
                                 "s string, v double, a double, t double, z double")


@pytest.mark.parametrize("form", ["linear", "para", "root"])
def test_value_model_recovers_parameters(spark, form):
    """Choices drawn from the model by its own probabilities lead back to (k, beta)."""
    k, beta = 1.5, 60.0
    func = {"linear": lambda p: 0.1 * k * p, "para": lambda p: 0.1 * k * p * p, "root": lambda p: np.sqrt(0.1 * k * p)}[form]
    rows = []
    for money in range(1, 6):
        for pain in range(1, 6):
            n_yes = round(4000 / (1 + np.exp(beta * 0.01 * (func(pain) - money))))
            rows += [("s", money, pain, 1, n_yes), ("s", money, pain, 0, 4000 - n_yes)]
    cells = spark.createDataFrame(rows, "participant string, moneylevel int, painlevel int, accepted int, n int")
    trials = cells.filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    fit = models.fit_value_model(trials, [form, "none"], [0.5, 1.0, 1.5, 2.0, 3.0], [30.0, 60.0, 90.0], prior_scale=1000)
    weights = fit.groupBy("form").agg(F.sum("weight").alias("w"), F.count("k").alias("n")).collect()
    assert {r["form"]: (round(r["w"], 9), r["n"]) for r in weights} == {form: (1.0, 15), "none": (1.0, 3)}
    best = models.value_params(fit).filter(F.col("form") == form).first()
    assert (best["k_map"], best["beta_map"]) == (k, beta)
    assert best["k"] == pytest.approx(k, abs=0.1)


def test_outside_the_domain_is_impossible(spark):
    trials = spark.createDataFrame([("s", 1, 2, 1), ("s", 2, 2, 0)], "participant string, moneylevel int, painlevel int, accepted int")
    fit = models.fit_value_model(trials, ["hyper"], [0.5, 0.25], [1.0])
    assert {r["k"]: r["weight"] for r in fit.collect()} == {0.5: 0.0, 0.25: 1.0}


def test_score_value_model(spark):
    trials = spark.createDataFrame([("s", 3, 2), ("u", 1, 1)], "participant string, moneylevel int, painlevel int")
    params = spark.createDataFrame([("s", "para", 2.0, 10.0), ("s", "none", 1.0, 5.0)],
                                   "participant string, form string, k double, beta double")
    got = {r["participant"]: r for r in models.score_value_model(trials, params, ["para", "none"]).collect()}
    r = got["s"]
    assert r["sv_pain_para"] == pytest.approx(0.8) and r["sv_both_para"] == pytest.approx(-2.2)
    assert r["p_accept_para"] == pytest.approx(1 / (1 + np.exp(10 * 0.01 * -2.2)))
    assert r["bias_para"] == r["beta_para"] == 10.0 and (r["sv_pain_none"], r["sv_both_none"]) == (2.0, -1.0)
    assert got["u"]["sv_pain_para"] is None


def test_regression_by(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"s": rng.integers(0, 3, 120), "x": rng.normal(size=120), "z": rng.normal(size=120),
                          "f": rng.choice(["a", "b", "c"], 120), "g": rng.choice(["x", "y"], 120)})
    frame["y"] = 1 + 2 * frame.x - frame.z + 0.5 * frame.x * frame.z + rng.normal(size=120)
    df = spark.createDataFrame(frame)
    terms = [("x",), ("z",), ("x", "z"), ("x", FF)]
    got = models.regression_by(df, ["s"], "y", terms).toPandas()
    for s, rows in got.groupby("s"):
        d = frame[frame.s == s]
        x = np.column_stack([np.ones(len(d)), d.x, d.z, d.x * d.z, d.x * (d.f == "b"), d.x * (d.f == "c")])
        want = np.linalg.lstsq(x, d.y, rcond=None)[0]
        names = ["Intercept", "x", "z", "x:z", "x:C(f)[T.b]", "x:C(f)[T.c]"]
        np.testing.assert_allclose(rows.set_index("term")["beta"].reindex(names), want, rtol=1e-6)
    assert models.regression_by(df.filter("s = 0").limit(3), ["s"], "y", terms).count() == 0      # too few rows
    effects = models.group_effects(got_df(spark, got), ["term"]).filter("term = 'x'").first()
    b = got[got.term == "x"]["beta"]
    assert effects["t"] == pytest.approx(b.mean() / (b.std(ddof=1) / np.sqrt(3))) and effects["n_subjects"] == 3


def got_df(spark, frame):
    return spark.createDataFrame(frame)


def test_link(spark):
    df = spark.createDataFrame([(1, float(x), float(np.exp(1 + 2 * x))) for x in range(4)], "s int, x double, y double")
    got = {r["term"]: r["beta"] for r in models.regression_by(df, ["s"], "y", [("x",)], link=F.ln).collect()}
    assert got["x"] == pytest.approx(2) and got["Intercept"] == pytest.approx(1)


def test_regression_of_a_null_group(spark):
    rows = [(g, float(x), 2.0 * x + 1 + x % 2) for g in ("a", None) for x in range(8)]
    got = {(r.g, r.term): r.beta for r in models.regression_by(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "y", ["x"]).collect()}
    assert len(got) == 4 and all(got[None, t] == pytest.approx(b) for (g, t), b in got.items() if g == "a")


def test_no_possible_grid_point(spark):
    trials = spark.createDataFrame([("s", 1.0, 2.0, 1)] * 4, "participant string, moneylevel double, painlevel double, accepted int")
    fit = models.fit_value_model(trials, ["hyper"], [0.5], [1.0])
    assert {r.weight for r in fit.collect()} == {0.0}
    assert models.value_pointwise(trials, fit, ["hyper"]).count() == 0


def test_scores_are_written_to_counted_offers(spark, tmp_path, monkeypatch):
    """The wide scores meet a row per subject and offer, whatever the number of trials."""
    from choicelab.plans import model_queries

    spark.range(3_000).selectExpr(
        "nullif(id % 4, 3) as l_suppkey", "cast(id % 5 as double) as l_quantity", "cast(id % 2 as int) as l_linenumber",
        "id % 7 / 100.0D as l_discount", "id as l_orderkey", "id as l_partkey", "1000.0D + id as l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, score = [], models.score_value_model

    def counting(trials, *args):
        seen.append(trials.count())
        return score(trials, *args)

    monkeypatch.setattr(models, "score_value_model", counting)
    got = model_queries.score_value_model(spark, str(tmp_path)).collect()
    assert seen == [len(got)]
    assert sum(r["n"] for r in got) == 3_000
    none = [r for r in got if r["participant"] is None]
    assert none and all(r["p_accept_para"] is not None for r in none)
