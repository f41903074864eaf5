"""Diagnostics and model comparison over posterior draws.

``draws`` is long: (param, chain, draw, value). ``pointwise`` is long:
(model, obs, draw, loglik), optionally with a draw ``weight`` and a ``count`` of
identical observations per row of ``obs``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicelab.operators.joins import attach
from choicelab.operators.ranking import col, exact_quantiles, row_index
from choicelab.staging import stage


#: Draws times grid points that are in memory at once.
_KERNEL_CELLS = 1 << 20


def combine_chains(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def gelman_rubin(draws: DataFrame, param: list[str], chain: str = "chain", value: str = "value") -> DataFrame:
    """R = sqrt(V/W) with W the mean chain variance, B/n the variance of chain
    means and V = (n-1)/n W + B/n. n is the mean chain length."""
    chains = draws.groupBy(*map(col, param), col(chain)).agg(
        F.count(col(value)).alias("_n"), F.avg(col(value)).alias("_mean"), F.var_samp(col(value)).alias("_var"))
    parts = chains.groupBy(*map(col, param)).agg(
        F.avg("_n").alias("_n"), F.avg("_var").alias("_w"), F.var_samp("_mean").alias("_b"),
        F.count(F.lit(1)).alias("n_chains"))
    v = (F.col("_n") - 1) / F.col("_n") * F.col("_w") + F.col("_b")
    return parts.select(*map(col, param), "n_chains", F.when(F.col("_w") > 0, F.sqrt(v / F.col("_w"))).alias("r_hat"))


def laid_end_to_end(draws: DataFrame, param: list[str], chain: str = "chain", draw: str = "draw",
                    ranges: int | None = None) -> DataFrame:
    """Draws with their position from 0 when a parameter's chains follow each other, and the ``_total`` of its draws.

    Positions come from the rank of a draw in its chain, so draw numbers may start
    anywhere and have gaps.
    """
    ranked = row_index(draws, [*param, chain], [draw], "_rank", ranges)
    lengths = draws.groupBy(*map(col, (*param, chain))).agg(F.count(F.lit(1)).alias("_len"))
    whole = Window.partitionBy(*map(col, param))  # one row per chain
    starts = lengths.select(*map(col, (*param, chain)), F.sum("_len").over(whole).alias("_total"),
                            (F.sum("_len").over(whole.orderBy(col(chain)).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_len")).alias("_start"))
    placed = attach(ranked, starts, [*param, chain])
    return placed.withColumn("_position", F.col("_start") + F.col("_rank") - 1).drop("_rank", "_start")


def batch_error(draws: DataFrame, param: list[str], batches: int = 100, value: str = "value",
                ranges: int | None = None) -> DataFrame:
    """Monte Carlo error: std of batch means over the root of their number, batches consecutive.

    Chains are laid end to end, and every draw is in one of the batches, whose sizes
    differ by one draw at most.
    """
    placed = laid_end_to_end(draws, param, ranges=ranges)
    batch = F.floor(F.col("_position") * batches / F.col("_total"))
    means = placed.withColumn("_batch", batch).groupBy(*map(col, param), "_batch").agg(F.avg(col(value)).alias("_mean"))
    return means.groupBy(*map(col, param)).agg(
        (F.stddev_pop("_mean") / F.sqrt(F.count("_mean"))).alias("mc_err"))


def posterior_summary(draws: DataFrame, param: list[str], batches: int = 100, value: str = "value",
                      ranges: int | None = None) -> DataFrame:
    """mean, std, 2.5/25/50/75/97.5 % quantiles and Monte Carlo error per parameter."""
    draws = stage(draws, "draws")  # read by each of the three parts
    moments = draws.groupBy(*map(col, param)).agg(
        F.avg(col(value)).alias("mean"), F.stddev_pop(col(value)).alias("std"))
    probs = [0.025, 0.25, 0.5, 0.75, 0.975]
    names = ["2.5q", "25q", "50q", "75q", "97.5q"]
    quant = exact_quantiles(draws, param, value, probs, "_q", ranges)
    errors = batch_error(draws, param, batches, value, ranges)
    joined = attach(attach(moments, quant, param), errors, param)
    return joined.select(*map(col, param), "mean", "std",
                         *[F.try_element_at("_q", F.lit(i + 1)).alias(n) for i, n in enumerate(names)], "mc_err")


def sign_probability(draws: DataFrame, param: list[str], value: str = "value") -> DataFrame:
    """Smaller share of draws on one side of zero."""
    shares = draws.groupBy(*map(col, param)).agg(
        F.avg((col(value) > 0).cast("int")).alias("_up"), F.avg((col(value) < 0).cast("int")).alias("_down"))
    s = F.least("_up", "_down")
    return shares.select(*map(col, param), F.least(s, 1 - s).alias("p"))


def transform_draws(draws: DataFrame, names: list, build, param: str = "param", value: str = "value") -> DataFrame:
    """Apply ``build`` (a column function, e.g. ``inv_logit``) to the named parameters only."""
    return draws.withColumn(value, F.when(col(param).isin(names), build(col(value))).otherwise(col(value)))


def posterior_mean_by(draws: DataFrame, param: list[str], chain: int | None = None, value: str = "value") -> DataFrame:
    """Posterior mean; ``chain`` limits it to one chain."""
    rows = draws if chain is None else draws.filter(F.col("chain") == chain)
    return rows.groupBy(*map(col, param)).agg(F.avg(col(value)).alias("mean"))


def subject_param_matrix(draws: DataFrame, params: list, subject: str = "subject", param: str = "param",
                         value: str = "value", prefix: str = "") -> DataFrame:
    """Subjects by parameters, posterior means; absent parameters are null."""
    cells = [F.avg(F.when(col(param) == p, col(value))).alias(f"{prefix}{p}") for p in params]
    return draws.groupBy(col(subject)).agg(*cells)


def hdi(draws: DataFrame, param: list[str], mass: float = 0.94, value: str = "value",
        ranges: int | None = None) -> DataFrame:
    """Narrowest interval over the sorted draws that spans floor(mass * n) steps.

    The draw that closes an interval is met by its rank, so the sort and the
    join are spread over ranks also when one parameter holds most draws.
    """
    rows = draws.select(*map(col, param), col(value).alias("_x")).filter(F.col("_x").isNotNull())
    ranked = stage(row_index(rows, param, ["_x"], "_rank", ranges), "ranked")
    totals = ranked.groupBy(*map(col, param)).agg(F.count(F.lit(1)).alias("_n"))
    span = F.floor(F.col("_n") * mass).cast("long")
    lows = attach(ranked, totals, param).filter(F.col("_rank") + span <= F.col("_n"))
    lows = lows.select(*map(col, param), F.col("_x").alias("_lo"), (F.col("_rank") + span).alias("_rank"))
    highs = ranked.select(*map(col, param), "_rank", F.col("_x").alias("_hi"))
    pairs = attach(lows, highs, [*param, "_rank"], "inner")
    best = F.min_by(F.struct("_lo", "_hi"), F.struct(F.col("_hi") - F.col("_lo"), F.col("_lo")))
    return pairs.groupBy(*map(col, param)).agg(best.alias("_b")).select(
        *map(col, param), F.col("_b._lo").alias("hdi_low"), F.col("_b._hi").alias("hdi_high"))


def autocovariance(draws: DataFrame, param: list[str], max_lag: int, value: str = "value",
                   segment: int = 4096) -> DataFrame:
    """Mean over chains of the lag covariances (divisor n) up to ``max_lag``.

    Lags count draws, whatever their numbers: these may start anywhere and have gaps.
    A chain is cut into segments of consecutive draws that also hold the first
    ``max_lag`` draws of the next one, so a group never exceeds segment + max_lag
    draws and every draw is shuffled about once.
    """
    keys = [*param, "chain"]
    segment = max(segment, max_lag)
    draws = laid_out(draws, param)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def lag_products(values: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(values, own):
            x = np.concatenate([np.asarray(x, dtype=float), np.zeros(max_lag)])
            out.append([float(x[:n] @ x[lag:lag + n]) for lag in range(max_lag + 1)])
        return pd.Series(out)

    means = draws.groupBy(*map(col, keys)).agg(F.avg(col(value)).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    home = F.floor(col("draw") / segment)
    spill = (col("draw") % segment < max_lag) & (home > 0)
    centred = attach(draws, means, keys).select(
        *map(col, keys), col("draw").cast("long").alias("_i"), (col(value) - F.col("_mean")).alias("_c"), "_n",
        F.explode(F.when(spill, F.array(home, home - 1)).otherwise(F.array(home))).alias("_segment"))
    pieces = centred.groupBy(*map(col, keys), "_segment").agg(
        F.array_sort(F.collect_list(F.struct("_i", "_c"))).alias("_rows"), F.first("_n").alias("_n"),
        F.sum((F.floor(F.col("_i") / segment) == F.col("_segment")).cast("int")).alias("_own"))
    products = pieces.select(*map(col, keys), "_n", F.posexplode(
        lag_products(F.col("_rows._c"), F.col("_own"))).alias("lag", "_product"))
    per_chain = products.groupBy(*map(col, keys), "lag").agg((F.sum("_product") / F.first("_n")).alias("_cov"))
    return per_chain.groupBy(*map(col, param), "lag").agg(F.avg("_cov").alias("autocov"))


def effective_size(draws: DataFrame, param: list[str], first_lags: int = 64, value: str = "value") -> DataFrame:
    """Effective sample size by Geyer's initial positive sequence.

    Pairs of neighbouring autocorrelations are added until the first pair that is not
    positive. The number of lags doubles until every parameter has reached that pair
    or run out of draws.
    """
    draws = stage(draws, "draws")
    chains = draws.groupBy(*map(col, param), "chain").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(col(value)).alias("_mean"), F.var_samp(col(value)).alias("_var"))
    pooled = chains.groupBy(*map(col, param)).agg(
        F.sum("_n").alias("_total"), F.avg("_n").alias("_n"), F.max("_n").alias("_longest"), F.avg("_var").alias("_w"),
        F.coalesce(F.var_samp("_mean"), F.lit(0.0)).alias("_b"))
    pooled = stage(pooled.withColumn("_v", (F.col("_n") - 1) / F.col("_n") * F.col("_w") + F.col("_b")), "pooled")
    rho = F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(
        1 - (F.col("_w") - F.col("autocov") * F.col("_n") / (F.col("_n") - 1)) / F.col("_v"))
    lags = first_lags
    while True:
        covariances = attach(autocovariance(draws, param, lags, value), pooled, param, "inner")
        # one row per lag and parameter from here on
        pairs = stage(covariances.filter((F.col("_v") > 0) & (F.col("lag") < F.col("_longest"))).withColumn("_rho", rho)
                      .groupBy(*map(col, param), F.floor(F.col("lag") / 2).alias("_pair"))
                      .agg(F.sum("_rho").alias("_sum"), F.count(F.lit(1)).alias("_k"), F.first("_total").alias("_total"), F.first("_longest").alias("_longest"))
                      .filter(F.col("_k") == 2), "lag-pairs")
        open_ = pairs.groupBy(*map(col, param)).agg(F.min("_sum").alias("_least"), F.first("_longest").alias("_longest"))
        if open_.filter((F.col("_least") > 0) & (F.col("_longest") > lags)).isEmpty():
            break
        lags *= 2
    upto = Window.partitionBy(*map(col, param)).orderBy("_pair").rowsBetween(Window.unboundedPreceding, 0)
    kept = pairs.withColumn("_least", F.min("_sum").over(upto)).filter(F.col("_least") > 0)
    tau = -1 + 2 * F.sum(F.col("_least"))
    return kept.groupBy(*map(col, param)).agg(
        (F.first("_total") / F.greatest(tau, 1 / F.log10(F.first("_total")))).alias("ess"))


def laid_out(draws: DataFrame, param: list[str]) -> DataFrame:
    """Draws numbered from 0 within their chain without gaps."""
    ranked = row_index(draws, [*param, "chain"], ["draw"], "_rank")
    return ranked.withColumn("draw", F.col("_rank") - 1).drop("_rank")


def interval_summary(draws: DataFrame, param: list[str], mass: float = 0.94,
                     value: str = "value", ranges: int | None = None) -> DataFrame:
    """mean, sd, HDI bounds, mcse, ess and r_hat per parameter."""
    draws = stage(draws, "draws")  # read by each of the parts
    moments = draws.groupBy(*map(col, param)).agg(F.avg(col(value)).alias("mean"), F.stddev_samp(col(value)).alias("sd"))
    bounds = hdi(draws, param, mass, value, ranges)
    size = effective_size(draws, param, value=value)
    rhat = gelman_rubin(draws, param, value=value).select(*map(col, param), "r_hat")
    joined = attach(attach(attach(moments, bounds, param), size, param), rhat, param)
    return joined.select(*map(col, param), "mean", "sd", "hdi_low", "hdi_high",
                         (F.col("sd") / F.sqrt("ess")).alias("mcse_mean"), "ess", "r_hat")


def posterior_density(draws: DataFrame, param: list[str], grid: int = 100, cut: float = 3.0,
                      value: str = "value") -> DataFrame:
    """Gaussian kernel density on an even grid, Scott's bandwidth, ``cut`` bandwidths beyond the ends.

    Every draw counts at every point of the grid, but the kernels are summed inside
    the task: a batch of draws gives one row of ``grid`` sums per parameter in it.
    """
    stats = draws.groupBy(*map(col, param)).agg(
        (F.stddev_samp(col(value)) * F.pow(F.count(col(value)), F.lit(-0.2))).alias("_bw"),
        F.min(col(value)).alias("_lo"), F.max(col(value)).alias("_hi")).filter(F.col("_bw") > 0)
    sized = attach(draws, stats, param, "inner").filter(col(value).isNotNull()).select(
        *map(col, param), "_bw", *(F.col(c).cast("double").alias(c) for c in ("_lo", "_hi")), col(value).cast("double").alias("_v"))

    def kernel_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, _KERNEL_CELLS // grid)
        for batch in batches:
            names = batch.schema.names[:len(param)]
            code = batch.select(names).to_pandas().groupby(names, dropna=False, sort=False).ngroup().to_numpy()
            bw, lo, hi, v = (batch.column(c).to_numpy() for c in ("_bw", "_lo", "_hi", "_v"))
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            low, high = lo[first] - cut * bw[first], hi[first] + cut * bw[first]
            x = low[:, None] + (high - low)[:, None] * np.arange(grid) / (grid - 1)
            sums = np.zeros(x.shape)
            order = np.argsort(code, kind="stable")
            for at in range(0, len(order), rows):
                block = order[at:at + rows]
                of = code[block]
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                z = (x[of] - v[block, None]) / bw[block, None]
                sums[of[starts]] += np.add.reduceat(np.exp(-z * z / 2), starts, axis=0)
            offsets = np.arange(len(first) + 1, dtype=np.int32) * grid
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(first)) for c in names), pa.array(bw[first]), pa.array(n),
                 *(pa.ListArray.from_arrays(offsets, pa.array(m.ravel())) for m in (x, sums))],
                names=[*names, "_bw", "_n", "_x", "_sums"])

    schema = T.StructType([sized.schema[c] for c in param])
    for name, kind in (("_bw", T.DoubleType()), ("_n", T.LongType()), ("_x", T.ArrayType(T.DoubleType())), ("_sums", T.ArrayType(T.DoubleType()))):
        schema = schema.add(name, kind)
    points = sized.mapInArrow(kernel_sums, schema).select(*map(col, param), "_bw", "_n", F.posexplode(F.arrays_zip("_x", "_sums")).alias("point", "_p"))
    density = F.sum("_p._sums") / F.sum("_n") / (F.first("_bw") * 2.5066282746310002)
    return points.groupBy(*map(col, param), "point").agg(F.first("_p._x").alias("x"), density.alias("density"))


# --- model comparison -------------------------------------------------------

_BAND = 64.0

def _weight(pointwise: DataFrame) -> Column:
    return F.col("weight") if "weight" in pointwise.columns else F.lit(1.0)


def dic(pointwise: DataFrame, plug_in: DataFrame, model: list[str]) -> DataFrame:
    """Mean deviance plus pD; ``plug_in`` holds log-likelihoods at the posterior mean."""
    count = F.col("count") if "count" in pointwise.columns else F.lit(1)
    per_draw = pointwise.groupBy(*map(col, model), "draw").agg(
        (-2 * F.sum(F.col("loglik") * count)).alias("_d"), F.first(_weight(pointwise)).alias("_w"))
    mean = per_draw.groupBy(*map(col, model)).agg((F.sum(F.col("_d") * F.col("_w")) / F.sum("_w")).alias("mean_deviance"))
    count = F.col("count") if "count" in plug_in.columns else F.lit(1)
    at_mean = plug_in.groupBy(*map(col, model)).agg((-2 * F.sum(F.col("loglik") * count)).alias("_at"))
    joined = mean.join(at_mean, model)
    p_d = F.col("mean_deviance") - F.col("_at")
    return joined.select(*map(col, model), "mean_deviance", p_d.alias("p_d"),
                         (F.col("mean_deviance") + p_d).alias("dic"))


def pointwise_elpd(pointwise: DataFrame, model: list[str], obs: list[str], kind: str = "waic") -> DataFrame:
    """Expected log predictive density per observation: (model, obs, elpd, p, count).

    ``waic``: log mean likelihood minus the variance of the log-likelihood.
    ``loo``: plain importance sampling, -ln mean exp(-loglik). Means over draws
    use the draw weights.

    Exponentials must be shifted to stay in range. Instead of a first pass for
    the extremes, draws are summed per band of 64 log units around the band's
    middle; the few bands of an observation are then put on a common shift.
    """
    keys = [col(c) for c in (*model, *obs)]
    w = _weight(pointwise)
    band = F.when(F.col("loglik") > float("-inf"), F.floor(F.col("loglik") / _BAND))  # null: an impossible observation
    count = F.first(F.col("count")) if "count" in pointwise.columns else F.lit(1)
    near = F.col("loglik") - F.col("_mid")
    bands = pointwise.withColumn("_mid", band * _BAND + _BAND / 2).groupBy(*keys, "_mid").agg(
        F.sum(w).alias("_w"), F.sum(w * F.exp(near)).alias("_up"), F.sum(w * F.exp(-near)).alias("_down"),
        F.sum(w * near).alias("_s1"), F.sum(w * near * near).alias("_s2"), count.alias("count"))
    whole = Window.partitionBy(*keys)               # one row per band
    bands = bands.withColumns({"_max": F.max("_mid").over(whole), "_min": F.min("_mid").over(whole)})
    rise, drop = F.col("_mid") - F.col("_max"), F.col("_min") - F.col("_mid")
    sums = bands.groupBy(*keys).agg(
        F.sum("_w").alias("_w"), F.first("_max").alias("_max"), F.first("_min").alias("_min"),
        F.sum(F.col("_up") * F.exp(rise)).alias("_up"), F.sum(F.col("_down") * F.exp(drop)).alias("_down"),
        F.sum(F.col("_s1") + F.col("_w") * rise).alias("_s1"),
        F.sum(F.col("_s2") + 2 * rise * F.col("_s1") + F.col("_w") * rise * rise).alias("_s2"),
        F.first("count").alias("count"), F.max(F.col("_mid").isNull()).alias("_impossible"))
    lppd = F.col("_max") + F.ln(F.col("_up") / F.col("_w"))
    mean = F.col("_s1") / F.col("_w")
    variance = F.greatest(F.col("_s2") / F.col("_w") - mean * mean, F.lit(0.0))
    loo = F.col("_min") - F.ln(F.col("_down") / F.col("_w"))
    elpd, p = (lppd - variance, variance) if kind == "waic" else (loo, lppd - loo)
    never = F.col("_impossible")
    return sums.select(*keys, F.when(never, float("-inf")).otherwise(elpd).alias("elpd"), F.when(never, float("inf")).otherwise(p).alias("p"), "count")


def _total_se(value: Column, count: Column) -> Column:
    """sqrt(n * population variance) of values that each occur ``count`` times."""
    n = F.sum(count)
    mean = F.sum(value * count) / n
    return F.sqrt(F.greatest(n * (F.sum(value * value * count) / n - mean * mean), F.lit(0.0)))


def elpd_summary(elpd: DataFrame, model: list[str], p_limit: float = 0.4) -> DataFrame:
    """Totals per model: elpd, effective parameters, se and the high-variance warning."""
    n = F.col("count")
    return elpd.groupBy(*map(col, model)).agg(
        F.sum(F.col("elpd") * n).alias("elpd"), F.sum(F.col("p") * n).alias("p"),
        _total_se(F.col("elpd"), n).alias("se"), F.max(F.col("p") > p_limit).alias("warning"))


def waic(pointwise: DataFrame, model: list[str], obs: list[str]) -> DataFrame:
    return elpd_summary(pointwise_elpd(pointwise, model, obs, "waic"), model)


def is_loo(pointwise: DataFrame, model: list[str], obs: list[str]) -> DataFrame:
    return elpd_summary(pointwise_elpd(pointwise, model, obs, "loo"), model).drop("warning")


def compare_models(elpd: DataFrame, model: str, obs: list[str], p_limit: float = 0.4) -> DataFrame:
    """Rank, elpd, p, difference to the best model, se, dse, warning and scale.

    ``elpd`` comes from ``pointwise_elpd``. Only the name of the best model is
    read back, so the difference per observation needs one join.
    """
    elpd = stage(elpd, "elpd")
    totals = elpd_summary(elpd, [model], p_limit)
    best = totals.orderBy(F.col("elpd").desc(), col(model)).first()
    top = elpd.filter(col(model) == F.lit(best[model])).select(*map(col, obs), F.col("elpd").alias("_best"))
    n = F.col("count")
    gaps = elpd.join(top, obs).groupBy(col(model)).agg(_total_se(F.col("_best") - F.col("elpd"), n).alias("dse"))
    # one row per model: the global window is bounded by the number of models
    order = Window.orderBy(F.col("elpd").desc(), col(model))
    return totals.join(gaps, [model]).select(
        col(model), (F.row_number().over(order) - 1).alias("rank"), "elpd", "p",
        (F.lit(best["elpd"]) - F.col("elpd")).alias("elpd_diff"), "se", "dse", "warning", F.lit("log").alias("scale"))


def stacking_weights(elpd: DataFrame, model: str, models: list[str], obs: list[str], rounds: int = 200,
                     tolerance: float = 1e-9) -> DataFrame:
    """Weights that maximise the summed log of the mixed predictive density.

    Densities are laid out once as one column per model. A round is one aggregate over
    them, gradient and curvature at the present weights, and a Newton step on the weights
    that are free to move; only these numbers, none per observation, visit the driver.
    At the optimum no model's gradient exceeds 1, and its excess bounds what the mean log
    density can still gain: above ``tolerance`` after all rounds it is an error.
    """
    size = range(len(models))
    cells = [F.max(F.when(col(model) == m, F.col("elpd"))).alias(f"_e{i}") for i, m in enumerate(models)]
    wide = elpd.groupBy(*map(col, obs)).agg(*cells, F.first("count").alias("_n"))
    top = F.greatest(*[F.col(f"_e{i}") for i in size])
    wide = stage(wide.select("_n", *[F.coalesce(F.exp(F.col(f"_e{i}") - top), F.lit(0.0)).alias(f"_p{i}") for i in size]), "densities")

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean log density, its gradient and the negative of its second derivatives."""
        mix = reduce(Column.__add__, [F.lit(float(w)) * F.col(f"_p{i}") for i, w in enumerate(weights)])
        share = [F.col(f"_p{i}") / F.col("_mix") for i in size]
        n = F.col("_n")
        row = wide.withColumn("_mix", mix).agg(
            F.sum("_n"), F.sum(n * F.ln("_mix")), *[F.sum(n * x) for x in share],
            *[F.sum(n * share[i] * share[j]) for i in size for j in size if i <= j]).first()
        total, level, first, second = row[0], row[1], np.array(row[2:2 + len(models)], float), iter(row[2 + len(models):])
        curve = np.zeros((len(models), len(models)))
        for i in size:
            for j in size:
                if i <= j:
                    curve[i, j] = curve[j, i] = next(second)
        return level / total, first / total, curve / total

    weights = np.full(len(models), 1 / len(models))
    level, gradient, curve = at(weights)
    for _ in range(rounds):
        if gradient.max() - 1 <= tolerance:
            break
        step = _simplex_step(weights, gradient, curve)
        share = 1.0
        while True:
            tried = np.maximum(weights + share * step, 0)
            tried /= tried.sum()
            found = at(tried)
            if found[0] >= level or share < 1e-6:
                break
            share /= 2
        if found[0] < level:  # the multiplicative step never goes down
            tried = weights * gradient
            found = at(tried)
        weights, (level, gradient, curve) = tried, found
    else:
        raise RuntimeError(f"weights not optimal within {rounds} rounds: {gradient.max() - 1:.2g} above the bound")
    pairs = F.array(*[F.struct(F.lit(m).alias(model), F.lit(float(w)).alias("weight")) for m, w in zip(models, weights)])
    return wide.select(pairs.alias("_w")).limit(1).select(F.inline("_w"))


def _simplex_step(weights: np.ndarray, gradient: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Newton step that keeps the sum; weights at zero move only if their gradient pulls them up, and none goes below."""
    free = (weights > 1e-12) | (gradient > 1)
    while True:
        k = np.flatnonzero(free)
        ridge = curve[np.ix_(k, k)] + 1e-10 * np.eye(len(k))
        system = np.block([[ridge, np.ones((len(k), 1))], [np.ones((1, len(k))), np.zeros((1, 1))]])
        step = np.zeros(len(weights))
        step[k] = np.linalg.solve(system, np.append(gradient[k], 0.0))[:-1]
        stuck = free & (weights <= 1e-12) & (step < 0)
        if not stuck.any():
            break
        free &= ~stuck
    below = step < 0
    reach = np.min(weights[below] / -step[below], initial=1.0)
    return step * min(1.0, reach)
