import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from choicelab.functions import columns as fc
from choicelab.operators import joins
from choicelab.operators import posterior as post


def long(chains: dict) -> pd.DataFrame:
    rows = [(p, c, d, float(v)) for p, arr in chains.items() for c, chain in enumerate(arr) for d, v in enumerate(chain)]
    return pd.DataFrame(rows, columns=["param", "chain", "draw", "value"])


@pytest.fixture(scope="module")
def chains():
    rng = np.random.default_rng(11)
    ar = np.zeros((3, 300))
    for t in range(1, 300):
        ar[:, t] = 0.6 * ar[:, t - 1] + rng.normal(size=3)
    return {"iid": rng.normal(size=(3, 300)), "ar": ar, "shift": rng.normal(size=(3, 300)) + np.array([[0], [3], [6]])}


@pytest.fixture(scope="module")
def draws(spark, chains):
    return spark.createDataFrame(long(chains)).repartition(4)


def by_param(df):
    return {r["param"]: r.asDict() for r in df.collect()}


def test_gelman_rubin(draws, chains, spark):
    got = by_param(post.gelman_rubin(draws, ["param"]))
    for name, x in chains.items():
        n = x.shape[1]
        w, b = x.var(axis=1, ddof=1).mean(), x.mean(axis=1).var(ddof=1)
        assert got[name]["r_hat"] == pytest.approx(np.sqrt(((n - 1) / n * w + b) / w))
    assert got["shift"]["r_hat"] > 1.1 and got["iid"]["r_hat"] < 1.05
    same = spark.createDataFrame(long({"p": np.tile(chains["iid"][:1], (2, 1))}))
    assert by_param(post.gelman_rubin(same, ["param"]))["p"]["r_hat"] < 1


@pytest.mark.parametrize("ranges", [17, None])
def test_posterior_summary(draws, chains, ranges):
    got = by_param(post.posterior_summary(draws, ["param"], 50, ranges=ranges))
    for name, x in chains.items():
        flat = x.ravel()
        assert got[name]["mean"] == pytest.approx(flat.mean()) and got[name]["std"] == pytest.approx(flat.std())
        for q in (2.5, 25, 50, 75, 97.5):
            assert got[name][f"{q:g}q"] == pytest.approx(np.percentile(flat, q))
        batches = flat[: 50 * 18].reshape(50, 18).mean(axis=1)
        assert got[name]["mc_err"] == pytest.approx(batches.std() / np.sqrt(50))


@pytest.mark.parametrize("ranges", [17, None])
def test_hdi(draws, chains, ranges):
    got = by_param(post.hdi(draws, ["param"], ranges=ranges))
    for name, x in chains.items():
        s = np.sort(x.ravel())
        k = int(np.floor(0.94 * len(s)))
        i = int(np.argmin(s[k:] - s[: len(s) - k]))
        assert (got[name]["hdi_low"], got[name]["hdi_high"]) == (pytest.approx(s[i]), pytest.approx(s[i + k]))


@pytest.mark.parametrize("segment", [40, 4096])
def test_autocovariance(draws, chains, segment):
    rows = post.autocovariance(draws, ["param"], 20, segment=segment).collect()
    assert len(rows) == 3 * 21
    for r in rows:
        x = chains[r["param"]]
        c = x - x.mean(axis=1, keepdims=True)
        lag = r["lag"]
        want = np.mean([(a[: len(a) - lag] * a[lag:]).sum() / len(a) for a in c])
        assert r["autocov"] == pytest.approx(want, abs=1e-10)


def test_effective_size(draws):
    got = by_param(post.effective_size(draws, ["param"], 60))
    assert 600 < got["iid"]["ess"] < 1400
    assert 120 < got["ar"]["ess"] < 400                   # about n * (1 - 0.6) / (1 + 0.6)
    assert got["shift"]["ess"] < 20


def test_interval_summary(draws):
    got = by_param(post.interval_summary(draws, ["param"]))
    for r in got.values():
        assert r["hdi_low"] < r["mean"] < r["hdi_high"]
        assert r["mcse_mean"] == pytest.approx(r["sd"] / np.sqrt(r["ess"]))


def test_density_integrates_to_one(draws, chains):
    d = post.posterior_density(draws, ["param"], 200).toPandas()
    for name, rows in d.groupby("param"):
        rows = rows.sort_values("x")
        assert np.trapezoid(rows["density"], rows["x"]) == pytest.approx(1, abs=0.01)
        x = chains[name].ravel()
        bw = x.std(ddof=1) * len(x) ** -0.2
        point = rows.iloc[80]
        want = np.mean(np.exp(-(((point["x"] - x) / bw) ** 2) / 2) / (bw * np.sqrt(2 * np.pi)))
        assert point["density"] == pytest.approx(want)


def test_density_of_nulls_and_mixed_parameters(spark, monkeypatch):
    monkeypatch.setattr(post, "_KERNEL_CELLS", 64)  # blocks of two draws
    rng = np.random.default_rng(5)
    rows = [(None if k == 2 else f"p{k}", s, None if i == 3 else float(v)) for s in (1, 2) for k in range(4) for i, v in enumerate(rng.normal(k, s, 25))]
    rows += [("flat", 1, 2.0)] * 3 + [("single", 1, 1.0), ("none", 1, None)]
    got = {}
    for r in post.posterior_density(spark.createDataFrame(rows, "param string, subject int, value double").repartition(3), ["param", "subject"], 32).collect():
        got.setdefault((r["param"], r["subject"]), {})[r["point"]] = (r["x"], r["density"])
    assert set(got) == {(None if k == 2 else f"p{k}", s) for k in range(4) for s in (1, 2)}
    for key, points in got.items():
        v = np.array([v for p, s, v in rows if (p, s) == key and v is not None])
        bw = v.std(ddof=1) * len(v) ** -0.2
        grid = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 32)
        want = np.exp(-(((grid[:, None] - v) / bw) ** 2) / 2).mean(axis=1) / (bw * np.sqrt(2 * np.pi))
        assert sorted(points) == list(range(32))
        assert np.allclose([points[i] for i in range(32)], np.column_stack([grid, want]))
    empty = spark.createDataFrame([], "param string, value double")
    assert post.posterior_density(empty, ["param"]).count() == 0


def test_sign_transform_mean_and_matrix(draws, chains, spark):
    got = by_param(post.sign_probability(draws, ["param"]))
    x = chains["shift"]
    assert got["shift"]["p"] == pytest.approx(min((x > 0).mean(), (x < 0).mean()))
    moved = post.transform_draws(draws, ["iid"], fc.inv_logit)
    means = by_param(post.posterior_mean_by(moved, ["param"], chain=0))
    assert means["iid"]["mean"] == pytest.approx((1 / (1 + np.exp(-chains["iid"][0]))).mean())
    assert means["ar"]["mean"] == pytest.approx(chains["ar"][0].mean())
    wide = post.subject_param_matrix(draws.withColumnRenamed("chain", "subject"), ["iid", "ar", "none"])
    row = wide.filter("subject = 2").first()
    assert row["iid"] == pytest.approx(chains["iid"][2].mean()) and row["none"] is None


def test_compare_draws(draws, chains):
    row = joins.compare_draws(draws, [("shift", "iid")]).first()
    assert row["p_greater"] == pytest.approx((chains["shift"] > chains["iid"]).mean()) and row["n_draws"] == 900


# --- model comparison -------------------------------------------------------

@pytest.fixture(scope="module")
def loglik():
    rng = np.random.default_rng(2)
    base = rng.normal(-1, 0.5, size=(60, 1))
    out = {m: base + shift + rng.normal(scale=s, size=(60, 80)) for m, shift, s in (
        ("good", 0.3, 0.2), ("fair", 0.0, 0.3), ("far", -900.0, 3.0))}
    out["far"][:, ::2] -= 300                             # several bands, and exp underflows
    return out


@pytest.fixture(scope="module")
def pointwise(spark, loglik):
    rows = [(m, i, d, float(v)) for m, x in loglik.items() for i, row in enumerate(x) for d, v in enumerate(row)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["model", "obs", "draw", "loglik"])).repartition(5)


def lme(x):
    m = x.max(axis=1, keepdims=True)
    return (m + np.log(np.exp(x - m).mean(axis=1, keepdims=True)))[:, 0]


def test_waic_and_loo(pointwise, loglik):
    waic = {r["model"]: r for r in post.waic(pointwise, ["model"], ["obs"]).collect()}
    loo = {r["model"]: r for r in post.is_loo(pointwise, ["model"], ["obs"]).collect()}
    for m, x in loglik.items():
        p = x.var(axis=1)
        elpd = lme(x) - p
        assert waic[m]["elpd"] == pytest.approx(elpd.sum()) and waic[m]["p"] == pytest.approx(p.sum())
        assert waic[m]["se"] == pytest.approx(np.sqrt(60 * elpd.var())) and waic[m]["warning"] == bool((p > 0.4).any())
        assert loo[m]["elpd"] == pytest.approx((-lme(-x)).sum())
        assert loo[m]["p"] == pytest.approx((lme(x) + lme(-x)).sum())


def test_weights_and_counts_mean_repetition(spark, pointwise):
    twice = pointwise.unionByName(pointwise.filter("draw < 40").withColumn("draw", F.col("draw") + 100))
    weighted = pointwise.withColumn("weight", F.when(F.col("draw") < 40, 2.0).otherwise(1.0))
    a = sorted(map(tuple, post.waic(twice, ["model"], ["obs"]).select(F.round("elpd", 6), F.round("p", 6)).collect()))
    b = sorted(map(tuple, post.waic(weighted, ["model"], ["obs"]).select(F.round("elpd", 6), F.round("p", 6)).collect()))
    assert a == b
    again = pointwise.unionByName(pointwise.withColumn("obs", F.col("obs") + 1000))
    counted = pointwise.withColumn("count", F.lit(2))
    a = sorted(map(tuple, post.is_loo(again, ["model"], ["obs"]).select(F.round("elpd", 5), F.round("se", 5)).collect()))
    b = sorted(map(tuple, post.is_loo(counted, ["model"], ["obs"]).select(F.round("elpd", 5), F.round("se", 5)).collect()))
    assert a == b


def test_compare_models(pointwise, loglik):
    table = post.compare_models(post.pointwise_elpd(pointwise, ["model"], ["obs"]), "model", ["obs"]).toPandas().sort_values("rank")
    assert table["model"].tolist() == ["good", "fair", "far"] and table["rank"].tolist() == [0, 1, 2]
    assert table["elpd"].is_monotonic_decreasing and table["elpd_diff"].iloc[0] == 0 and table["dse"].iloc[0] == 0
    np.testing.assert_allclose(table["elpd_diff"], table["elpd"].max() - table["elpd"])
    e = {m: lme(x) - x.var(axis=1) for m, x in loglik.items()}
    assert table["dse"].iloc[1] == pytest.approx(np.sqrt(60 * (e["good"] - e["fair"]).var()))


def test_stacking_weights(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(-1, 0.6, size=(50, 3))
    e[:, 2] -= 4
    rows = [(i, f"m{k}", float(e[i, k]), 0.0, 1) for i in range(50) for k in range(3)]
    elpd = spark.createDataFrame(rows, "obs int, model string, elpd double, p double, count int")
    got = post.stacking_weights(elpd, "model", ["m0", "m1", "m2"], ["obs"]).toPandas()
    w = got.set_index("model")["weight"].reindex(["m0", "m1", "m2"]).to_numpy()
    assert w.sum() == pytest.approx(1)
    score = lambda v: np.log(np.exp(e) @ v).sum()
    grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1, 41) if a + b <= 1]
    assert score(w) >= max(map(score, grid)) - 1e-6


def test_dic(spark, pointwise, loglik):
    at = spark.createDataFrame([("good", i, -0.5) for i in range(60)], "model string, obs int, loglik double")
    row = post.dic(pointwise.filter("model = 'good'"), at, ["model"]).first()
    mean = (-2 * loglik["good"].sum(axis=0)).mean()
    assert row["mean_deviance"] == pytest.approx(mean)
    assert row["dic"] == pytest.approx(2 * mean - 60)


def test_batch_error_uses_every_draw(spark):
    rows = [("a", 0, k, 100.0 if k >= 100 else 0.0) for k in range(199)]
    moved = [("b", 0, 250 + 3 * k, v) for _, _, k, v in rows]
    table = spark.createDataFrame(rows + moved + [(None, *r[1:]) for r in rows], "param string, chain int, draw int, value double")
    got = {r.param: r.mc_err for r in post.batch_error(table, ["param"]).collect()}
    batch = np.floor(np.arange(199) * 100 / 199)
    means = np.array([np.mean([r[3] for r, b in zip(rows, batch) if b == k]) for k in range(100)])
    assert got == {k: pytest.approx(means.std() / 10) for k in ("a", "b", None)}


def test_effective_size_does_not_depend_on_first_lags(spark):
    rng = np.random.default_rng(3)
    x = np.zeros((2, 3000))
    for k in range(1, 3000):
        x[:, k] = 0.99 * x[:, k - 1] + rng.normal(size=2)
    rows = [("p", c, k, float(x[c, k])) for c in range(2) for k in range(3000)]
    table = spark.createDataFrame(rows, "param string, chain int, draw int, value double")
    one, two = (post.effective_size(table, ["param"], n).first()["ess"] for n in (8, 512))
    assert one == pytest.approx(two) and one < 120


def test_null_parameter_is_a_parameter(spark):
    rows = [(p, c, k, float(k * c + k % 7)) for p in ("a", None) for c in (0, 1) for k in range(50)]
    table = spark.createDataFrame(rows, "param string, chain int, draw int, value double")
    for summary in (post.posterior_summary, post.hdi, post.interval_summary):
        one, two = sorted(summary(table, ["param"]).collect(), key=lambda r: r.param is None)
        assert two.param is None and tuple(two)[1:] == pytest.approx(tuple(one)[1:])


def test_impossible_observation(spark):
    rows = [("m", o, d, -1.0 - d if (o, d) != (1, 2) else float("-inf")) for o in range(2) for d in range(4)]
    table = spark.createDataFrame(rows, "model string, obs int, draw int, loglik double")
    for kind in ("waic", "loo"):
        got = {r.obs: r.elpd for r in post.pointwise_elpd(table, ["model"], ["obs"], kind).collect()}
        assert got[1] == float("-inf") and np.isfinite(got[0])
    assert post.waic(table, ["model"], ["obs"]).first()["warning"]


def test_autocovariance_of_thinned_draws(spark):
    """Lags count draws: numbers with gaps change nothing, also where a chain is cut into segments."""
    rng = np.random.default_rng(11)
    x = np.cumsum(rng.normal(size=300)) * 0.3
    frames = [pd.DataFrame({"param": "p", "chain": 0, "draw": np.arange(300) * step + first, "value": x}) for step, first in ((1, 0), (50, 7))]
    plain, thinned = ({r["lag"]: r["autocov"] for r in post.autocovariance(spark.createDataFrame(f), ["param"], 20, segment=64).collect()} for f in frames)
    c = x - x.mean()
    for lag in range(21):
        want = (c[:300 - lag] * c[lag:]).sum() / 300
        assert plain[lag] == pytest.approx(want) and thinned[lag] == pytest.approx(want)
