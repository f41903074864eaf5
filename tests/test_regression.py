"""Factors, surfaces and formulas against plain versions of their rules."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from choicelab.functions import diffusion
from choicelab.functions.design import Factor
from choicelab.functions.formula import parse_formula
from choicelab.operators import models, regression
from choicelab.operators import surface as surfaces
from choicelab.operators.grouped import group_rows
from choicelab.operators.regression import Model
from choicelab.plans import views
from tests.test_models import density

LEVELS = {"f": ("c", "a", "b"), "pair": ("I", "M", "P")}
FF = Factor("f", ("a", "b", "c"))


def test_formula():
    assert parse_formula("v ~ 1 + x + y:z", {}) == ("v", True, [("x",), ("y", "z")])
    assert parse_formula("a ~ 0 + x:C(f)", LEVELS) == ("a", False, [("x", FF)])
    assert parse_formula("v~C(pair, Treatment('P'))", LEVELS) == ("v", True, [(Factor("pair", ("I", "M", "P"), "P"),)])
    assert parse_formula("v ~ x * y * z", {})[2] == [("x",), ("y",), ("z",), ("x", "y"), ("x", "z"), ("y", "z"), ("x", "y", "z")]
    assert parse_formula("v ~ s * (x * y)", {})[2] == [("s",), ("x",), ("y",), ("x", "y"), ("s", "x"), ("s", "y"), ("s", "x", "y")]
    assert parse_formula("v ~ x + x * y + y", {})[2] == [("x",), ("y",), ("x", "y")]
    assert parse_formula("v ~ 1", {}) == ("v", True, [])
    for wrong in ("v ~ x +", "v ~ (x", "v ~ x y", "v ~ 1 x", "v ~ x * -y", "v ~ : x"):
        with pytest.raises(ValueError):
            parse_formula(wrong, {})
    with pytest.raises(KeyError):
        parse_formula("v ~ C(g)", LEVELS)


def test_group_rows():
    import pyarrow as pa
    a, b = pa.array([1, None, 1, 2, None]), pa.array(["x", "y", "x", None, "y"])
    got = {k: v.tolist() for k, v in group_rows([a, b], 5).items()}
    assert got == {(1, "x"): [0, 2], (None, "y"): [1, 4], (2, None): [3]}
    assert group_rows([], 3)[()].tolist() == [0, 1, 2]


def ols(x, y):
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rest = ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1])
    return beta, np.sqrt(rest * np.diag(np.linalg.inv(x.T @ x)))


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    n = 30_000
    f = pd.DataFrame({"g": rng.choice(["hot", "a", "b", None], n, p=[0.9, 0.05, 0.04, 0.01]), "x": rng.normal(1000, 3, n), "w": rng.normal(size=n),
                      "f": rng.choice(["a", "b", "c"], n)})
    f["y"] = 3 + 0.5 * f.x - f.w + 0.1 * f.x * f.w + rng.normal(size=n)
    f.loc[rng.random(n) < 0.05, "y"] = None
    f.loc[rng.random(n) < 0.05, "x"] = None
    return f


def test_pooled_regressions(spark, frame):
    """Hot, small and null groups over many tasks; rows with nulls are left out."""
    df = spark.createDataFrame(frame, "g string, x double, w double, f string, y double").repartition(13)
    df = df.select("g", "f", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "w", "y")])
    fits = [Model((1, "y"), "y", (("x",), ("w",), ("x", "w"))), Model((2, "y"), "y", (("w", FF),), False)]
    got = regression.pooled_regressions(df, ["g"], fits, "version int, param string").toPandas()
    assert len(got) == 4 * 7
    for g in ("hot", "a", "b", None):
        own = frame[(frame.g == g) if g else frame.g.isna()]
        d = own.dropna(subset=["x", "y"])
        beta, se = ols(np.column_stack([np.ones(len(d)), d.x, d.w, d.x * d.w]), d.y.to_numpy())
        mine = got[((got.g == g) if g else got.g.isna()) & (got.version == 1)].set_index("term").loc[["Intercept", "x", "w", "x:w"]]
        np.testing.assert_allclose(mine.beta, beta, rtol=1e-6)
        np.testing.assert_allclose(mine.se, se, rtol=1e-6)
        assert set(mine.n) == {len(d)}
        d = own.dropna(subset=["y"])
        beta, se = ols(np.column_stack([d.w * (d.f == k) for k in "abc"]), d.y.to_numpy())
        mine = got[((got.g == g) if g else got.g.isna()) & (got.version == 2)]
        np.testing.assert_allclose(mine.beta, beta, rtol=1e-6)
        assert set(mine.n) == {len(d)}
    assert regression.pooled_regressions(df.limit(0), ["g"], fits, "version int, param string").count() == 0


def test_aliased_terms(spark):
    """A column that depends on earlier ones has no coefficient; the others are those of the model without it."""
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200), "nil": 0.0})
    f["c"] = f.a - f.b
    f["y"] = 1 + 2 * f.a + rng.normal(size=200)
    fit = Model((), "y", (("a",), ("nil",), ("b",), ("c",), ("a", "c")))
    got = regression.pooled_regressions(spark.createDataFrame(f), [], [fit]).toPandas().set_index("term")
    assert got.beta.isna().to_dict() == {"Intercept": False, "a": False, "nil": True, "b": False, "c": True, "a:c": False}
    beta, se = ols(np.column_stack([np.ones(200), f.a, f.b, f.a * f.c]), f.y.to_numpy())
    np.testing.assert_allclose(got.beta.dropna(), beta, rtol=1e-9)
    np.testing.assert_allclose(got.se.dropna(), se, rtol=1e-9)
    assert regression.pooled_regressions(spark.createDataFrame(f), [], [fit], aliased=False).count() == 0


def test_ill_conditioned_design(spark):
    """Normal equations lose all digits here, factors do not."""
    x = np.linspace(0, 1, 400)
    f = pd.DataFrame({"p": 1e3 + x, "y": 2 * (1e3 + x)})
    f["q"] = f.p ** 2
    got = regression.pooled_regressions(spark.createDataFrame(f).repartition(5), [], [Model((), "y", (("p",), ("q",)))]).toPandas().set_index("term")
    assert got.beta["p"] == pytest.approx(2, abs=1e-3) and got.beta["q"] == pytest.approx(0, abs=1e-6)


def test_cell_regressions_agree_with_pooled(spark, frame):
    cells = frame[frame.g != "hot"].dropna(subset=["g"]).assign(z=lambda d: d.w * 2)
    df = spark.createDataFrame(cells, "g string, x double, w double, f string, y double, z double")
    df = df.select("g", "f", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "w", "y", "z")])
    fits = [Model((1, "y"), "y", (("x",), ("w",))), Model((2, "z"), "z", (("x",), ("w",))), Model((3, "y"), "y", (("x", FF),))]
    one = regression.cell_regressions(df, "g", fits, "version int, param string").toPandas().set_index(["g", "version", "term"]).sort_index()
    two = regression.pooled_regressions(df, ["g"], fits, "version int, param string").toPandas().set_index(["g", "version", "term"]).sort_index()
    assert len(one) == len(two) == 2 * 10
    np.testing.assert_allclose(one.beta, two.beta, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(one.n, two.n)


def test_catalog_effects(spark):
    """Between-subject regressors are fitted to all subjects, the others per subject."""
    rng = np.random.default_rng(6)
    rows = [(s, float(x), 5.0 + s % 4, float(1 + s % 4 + 2 * x + rng.normal() * 0.01)) for s in range(12) for x in range(5)]
    cells = spark.createDataFrame(rows, "participant long, x double, score double, v double")
    catalog = {1: {"v": (True, [("x",)])}, 2: {"v": (True, [("score",), ("x",)])}, 0: {}}
    got = {(r.version, r.term): r for r in models.catalog_effects(cells, catalog, ("score",)).collect()}
    assert got[1, "x"].fit == "subject" and got[1, "x"].n == 12 and got[1, "x"].mean == pytest.approx(2, abs=0.01)
    assert got[2, "x"].fit == "pooled" and got[2, "x"].n == 60 and got[2, "score"].mean == pytest.approx(1, abs=0.01)
    assert len(got) == 5


def simulate(v, a, t, z, n, seed):
    """First passages of a random walk in small steps."""
    rng = np.random.default_rng(seed)
    dt = 1e-3
    place, time, done = np.full(n, a * z), np.zeros(n), np.zeros(n, bool)
    for _ in range(8000):
        place[~done] += v * dt + np.sqrt(dt) * rng.normal(size=(~done).sum())
        time[~done] += dt
        done |= (place <= 0) | (place >= a)
    return (place >= a).astype(int), t + time


def test_grid_loglik():
    rng = np.random.default_rng(9)
    rt, upper, count = rng.uniform(0.15, 3, 50), rng.random(50) < 0.5, rng.integers(1, 4, 50).astype(float)
    axes = [np.array(x) for x in ([-2.0, 0.0, 1.0], [0.7, 1.5], [0.1, 0.3], [0.3, 0.6])]
    got = diffusion.grid_loglik(rt, upper, count, *axes)
    for i, v in enumerate(axes[0]):
        for j, a in enumerate(axes[1]):
            for k, t in enumerate(axes[2]):
                for m, z in enumerate(axes[3]):
                    want = sum(c * np.log(0.95 * density(r, int(u), v, a, t, z, 2000) + 0.005) for r, u, c in zip(rt, upper, count))
                    assert got[i, j, k, m] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("v,z", [(-1.2, 0.5), (0.8, 0.35)])
def test_refined_surface_finds_the_parameters(spark, v, z):
    choice, rt = simulate(v, 1.3, 0.25, z, 1500, 3)
    trials = spark.createDataFrame(pd.DataFrame({"s": "p", "accepted": choice, "rt": rt}))
    coarse = {"v": [-4.0, -2.0, 0.0, 2.0, 4.0], "a": [0.6, 1.0, 1.6, 2.4], "t": [0.05, 0.2, 0.35], "z": [0.25, 0.5, 0.75]}
    collapsed = surfaces.collapse_trials(trials, ["s"])
    grid = surfaces.refined_surface(collapsed, ["s"], coarse, {"v": 5, "a": 4, "t": 4, "z": 4}, 4)
    best = models.wiener_params(grid, ["s"]).first()
    assert best["v"] == pytest.approx(v, abs=0.25) and best["a"] == pytest.approx(1.3, abs=0.1)
    assert best["t"] == pytest.approx(0.25, abs=0.03) and best["z"] == pytest.approx(z, abs=0.06)
    for name in surfaces.AXES:  # the best point is inside the grid
        ends = grid.agg(F.min(name), F.max(name)).first()
        assert ends[0] < best[f"{name}_map"] < ends[1]
    at = surfaces.loglik_points(collapsed, models.wiener_params(grid, ["s"]), ["s"]).first()["loglik"]
    mean = grid.agg(F.sum(F.col("weight") * F.col("loglik"))).first()[0]
    assert 2 < 2 * (at - mean) < 6  # four parameters


def test_starting_points(spark):
    rows = [("p", 1, 1, 0.6), ("p", 1, 0, 0.9), ("p", 2, 1, 0.5), ("q", 1, 0, 0.7)]
    trials = spark.createDataFrame(rows, "s string, level int, accepted int, rt double")
    cells = spark.createDataFrame([("p", 1, 0.5, 1.0, 0.2), ("p", 2, 1.0, 1.2, 0.1), ("q", 1, None, None, None)], "s string, level int, v double, a double, t double")
    z_grid = [0.2, 0.5, 0.8]
    got = {(r.s, r.level): r.z for r in surfaces.starting_points(trials, cells, ["s", "level"], z_grid).collect()}
    assert got["q", 1] is None
    for (s, level, v, a, t) in (("p", 1, 0.5, 1.0, 0.2), ("p", 2, 1.0, 1.2, 0.1)):
        like = np.array([np.prod([0.95 * density(rt, c, v, a, t, z) + 0.005 for k, j, c, rt in rows if (k, j) == (s, level)]) for z in z_grid])
        assert got[s, level] == pytest.approx((like * z_grid).sum() / like.sum(), rel=1e-6)


def test_surface_collapses_and_splits(spark):
    """One shuffle deals out the trials, and the rows that leave the tasks do not depend on their number."""
    trials = spark.range(20_000).selectExpr("id % 3 as s", "cast(id % 2 as int) as accepted", "0.4 + (id % 50) / 100.0 as rt")
    collapsed = surfaces.collapse_trials(trials, ["s"])
    assert collapsed.count() == 150
    assert collapsed.agg(F.sum("_count")).first()[0] == 20_000
    grid = surfaces.surface(collapsed, ["s"], {"v": [0.0, 1.0], "a": [1.0], "t": [0.1], "z": [0.5]})
    assert grid.count() == 6
    assert "explode(sequence" not in grid._jdf.queryExecution().toString()


def test_grid_logliks():
    """Many small groups at once are each group alone."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 9, 40)
    n = sizes.sum()
    rt, upper, count = rng.uniform(0.05, 3, n), rng.random(n) < 0.5, rng.integers(1, 4, n).astype(float)
    axes = [rng.uniform(low, high, (40, k)) for low, high, k in ((-2, 2, 3), (0.6, 2, 2), (0.05, 0.4, 2), (0.2, 0.8, 4))]
    got = diffusion.grid_logliks(rt, upper, count, sizes, *axes)
    ends = np.cumsum(sizes)
    for i, (low, high) in enumerate(zip(ends - sizes, ends)):
        alone = diffusion.grid_loglik(rt[low:high], upper[low:high], count[low:high], *[x[i] for x in axes])
        assert np.allclose(got[i], alone, rtol=1e-9)


def test_trials_of_a_group_lie_together(spark):
    """An Arrow batch holds few groups, however many groups a task has."""
    trials = spark.range(60_000).selectExpr("id % 600 as s", "cast(id % 2 as int) as accepted", "0.4 + id / 60000.0 as rt")
    calls = spark.sparkContext.accumulator(0)
    seen = surfaces.group_rows

    def counting(batches):
        for batch in batches:
            calls.add(len(seen(batch.columns[:1], batch.num_rows)))
        yield from ()

    surfaces.collapse_trials(trials, ["s"]).mapInArrow(counting, "s long").collect()
    assert calls.value < 1_200


def test_grid_makes_no_shuffle_of_points(spark):
    """Sums and weights come from tensors: after them no point is exchanged."""
    trials = spark.range(2_000).selectExpr("id % 7 as s", "cast(id % 2 as int) as accepted", "0.4 + id / 2000.0 as rt")
    grid = models.wiener_grid(trials, ["s"], [0.0, 1.0], [1.0], [0.1, 0.2], [0.5])
    plan = grid._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Window" not in plan
    assert "Exchange" not in plan.split("MapInArrow")[0]
    assert grid.groupBy("s").agg(F.sum("weight").alias("w")).filter("abs(w - 1) < 1e-9").count() == 7


def test_starting_points_take_cells_together(spark, monkeypatch):
    """Cells of a few trials share a kernel call, and neither points nor windows are shuffled."""
    rng = np.random.default_rng(2)
    axes = [pa.array([[x]] * 50) for x in (0.5, 1.0, 0.2)] + [pa.array([[0.3, 0.5, 0.7]] * 50)]
    trials = [pa.array([[True, False]] * 50), pa.array(rng.uniform(0.4, 1, (50, 2)).tolist()), pa.array([[1, 2]] * 50)]
    monkeypatch.setattr(diffusion, "grid_loglik", None)  # one call per cell
    assert [x.shape for x in surfaces._row_sums([*trials, *axes], 7)] == [(1, 1, 1, 3)] * 50
    rows = spark.range(400).selectExpr("id % 40 as s", "cast(id % 3 > 0 as int) as accepted", "0.4 + id / 400.0 as rt")
    cells = spark.range(40).selectExpr("id as s", "0.5D as v", "1.0D as a", "0.2D as t")
    placed = surfaces.starting_points(rows, cells, ["s"], [0.3, 0.5, 0.7])
    assert "Window" not in placed._jdf.queryExecution().toString()


def test_small_groups_are_fitted_in_stacks(spark, monkeypatch):
    """One call per design for all groups of a stack, with each group's own rows, aliased terms and unknown responses."""
    rng = np.random.default_rng(11)
    sizes = np.array([9, 4, 12, 1, 7, 0, 12])
    x = np.column_stack([np.ones(sizes.sum()), rng.normal(size=(sizes.sum(), 3))])
    x[:, 3] = x[:, 1] - 2 * x[:, 2]
    x[:9, 2] = 0
    x[rng.random(len(x)) < 0.1, 1] = np.nan
    y = rng.normal(size=(len(x), 2))
    y[rng.random(len(x)) < 0.2, 1] = np.nan
    design, targets = (0, 1, 2, 3), [0, 1, 0]
    got, calls, solve = {}, [], regression.stacked_solutions
    monkeypatch.setattr(regression, "stacked_solutions", lambda *args: calls.append(1) or solve(*args))
    stacks = list(regression._stacks(sizes))
    for some, at in stacks:
        for m, who, beta, error, n in regression._stack_fits(x, y, at, {design: [0, 1, 2]}, targets):
            got.update({(some[g], m): (b, e, k) for g, b, e, k in zip(who, beta, error, n)})
    assert len(stacks) == 1 and len(calls) <= 3
    ends = np.cumsum(sizes)
    for g, (low, high) in enumerate(zip(ends - sizes, ends)):
        for m, target in enumerate(targets):
            rows = np.column_stack([x[low:high], y[low:high, target]])
            rows = rows[~np.isnan(rows).any(axis=1)]
            if not len(rows):
                assert (g, m) not in got
                continue
            beta, error = regression.solution(regression.factor(rows), len(rows), 4)
            np.testing.assert_allclose(got[g, m][0], beta[0], rtol=1e-8, atol=1e-12)
            np.testing.assert_allclose(got[g, m][1], error[0], rtol=1e-6, atol=1e-12)
            assert got[g, m][2] == len(rows)


def test_trials_of_many_cells_share_a_kernel_call(spark, monkeypatch):
    """Sums of starting points: a call per batch, however many cells it has, and null is a cell's key like any other."""
    rng = np.random.default_rng(12)
    n, z = 600, np.array([0.2, 0.5, 0.9])
    key = rng.integers(0, 200, n)
    cell = rng.uniform([0.3, 0.6, 0.05], [2.0, 2.0, 0.4], (200, 3))[key]
    rt, upper = rng.uniform(0.1, 3, n), rng.random(n) < 0.5
    batch = pa.RecordBatch.from_arrays([pa.array([None if k == 7 else int(k) for k in key]), pa.array(upper), pa.array(rt), *map(pa.array, cell.T)], list("kurvat"))
    schema = pa.schema([("k", pa.int64()), *[(f"s{i}", pa.float64()) for i in range(3)]])
    calls, kernel = [], diffusion.start_logliks
    monkeypatch.setattr(diffusion, "start_logliks", lambda *args: calls.append(1) or kernel(*args))
    got = pa.Table.from_batches(surfaces._start_sums(1, z, schema, 7)([batch])).to_pandas().set_index("k")
    assert len(calls) == 1 and len(got) == len(set(key))
    for k in set(key) - {7}:
        own = key == k
        alone = diffusion.grid_loglik(rt[own], upper[own], np.ones(own.sum()), *[c[own][:1] for c in cell.T], z)
        np.testing.assert_allclose(got.loc[k].to_numpy(), alone.ravel(), rtol=1e-9)


def test_whole_numbers_are_those_of_round(spark):
    """Halves, their neighbours and large numbers."""
    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 0.5000000000000001, 4503599627370497.5, 1e300, -0.0, 7.000000000000001, 28.999999999999996, None]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    rows = df.select(F.round("x").alias("a"), views._whole(F.col("x")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
