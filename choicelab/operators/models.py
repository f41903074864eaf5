"""Estimation of value and diffusion models as set-based jobs.

Grids have a fixed size given by the caller. Trials are collapsed before they
meet a grid wherever the data allow it, and the likelihood of a grid point is a
sum that combines map-side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicelab.functions import diffusion, value
from choicelab.functions.design import Term
from choicelab.operators.joins import attach
from choicelab.operators.ranking import col
from choicelab.operators.regression import Model, cell_regressions, pooled_regressions
from choicelab.operators.surface import collapse_trials, loglik_points, weighted_surface
from choicelab.staging import spread


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def choice_cells(trials: DataFrame, subject: str = "participant", money: str = "moneylevel",
                 pain: str = "painlevel", accepted: str = "accepted") -> DataFrame:
    """Trials collapsed to one row per (subject, money, pain, accepted) with its ``count``."""
    return trials.groupBy(*map(col, (subject, money, pain, accepted))).agg(F.count(F.lit(1)).alias("count"))


def _on_grid(cells: DataFrame, forms: list[str], k_grid, beta_grid, money: str, pain: str, accepted: str) -> DataFrame:
    names = F.array(*[F.lit(f) for f in forms])
    k = F.when(F.col("form") == "none", _numbers([1.0])).otherwise(_numbers(k_grid))
    points = (cells.withColumn("form", F.explode(names)).withColumn("k", F.explode(k))
              .withColumn("_net", value.stored_value_by_name(F.col("k"), col(pain), F.col("form"), forms) - col(money))
              .withColumn("beta", F.explode(_numbers(beta_grid))))
    loglik = value.bernoulli_loglik(col(accepted), value.accept_logit(F.col("beta"), F.col("_net")))
    # a grid point outside the domain of its form is impossible, not ignorable
    return points.withColumn("loglik", F.coalesce(loglik, F.lit(float("-inf")))).drop("_net")


def fit_value_model(trials: DataFrame, forms: list[str], k_grid, beta_grid, subject: str = "participant",
                    money: str = "moneylevel", pain: str = "painlevel", accepted: str = "accepted",
                    prior_scale: float = 3.0) -> DataFrame:
    """Posterior of (k, beta) on a grid per subject and value form.

    Bernoulli likelihood, HalfNormal(``prior_scale``) priors on k and beta. The
    priors are fixed, without a group level, so values differ from a hierarchical
    sampler by design. Returns (subject, form, k, beta, loglik, weight). Where no grid
    point is possible all weights are 0.
    """
    cells = spread(choice_cells(trials.filter(col(accepted).isNotNull()), subject, money, pain, accepted), subject)
    points = _on_grid(cells, forms, k_grid, beta_grid, money, pain, accepted)
    grid = points.groupBy(col(subject), "form", "k", "beta").agg(
        F.sum(F.col("loglik") * F.col("count")).alias("loglik"))
    width = 2 * prior_scale * prior_scale
    free_k = F.when(F.col("form") == "none", F.lit(0.0)).otherwise(F.col("k"))
    log_post = F.col("loglik") - free_k * free_k / width - F.col("beta") * F.col("beta") / width
    # a window of one subject and form holds grid points only
    one = Window.partitionBy(col(subject), "form")
    possible = F.col("_lp") > float("-inf")
    shifted = grid.withColumn("_lp", log_post).withColumn("_e", F.when(possible, F.exp(F.col("_lp") - F.max("_lp").over(one))).otherwise(0.0))
    whole = F.sum("_e").over(one)
    return shifted.withColumn("weight", F.when(whole > 0, F.col("_e") / whole).otherwise(0.0)).drop("_lp", "_e")


def value_params(posterior: DataFrame, subject: str = "participant") -> DataFrame:
    """Posterior mean and best grid point of k and beta per subject and form."""
    w = F.col("weight")
    top = F.max_by(F.struct("k", "beta"), F.struct(w, -F.col("k"), -F.col("beta")))
    return posterior.groupBy(col(subject), "form").agg(
        F.sum(w * F.col("k")).alias("k"), F.sum(w * F.col("beta")).alias("beta"), top.alias("_top")).select(
        col(subject), "form", "k", "beta", F.col("_top.k").alias("k_map"), F.col("_top.beta").alias("beta_map"))


def value_pointwise(trials: DataFrame, posterior: DataFrame, forms: list[str], subject: str = "participant",
                    money: str = "moneylevel", pain: str = "painlevel", accepted: str = "accepted") -> DataFrame:
    """Pointwise log-likelihood table of the value models.

    An observation is a cell with its multiplicity ``count``, a draw is a grid
    point with its posterior ``weight``: the size does not depend on the number
    of trials.
    """
    cells = choice_cells(trials.filter(col(accepted).isNotNull()), subject, money, pain, accepted)
    points = posterior.filter(F.col("weight") > 0).select(col(subject), "form", "k", "beta", "weight")
    joined = spread(cells, subject).join(points, subject)
    net = value.stored_value_by_name(F.col("k"), col(pain), F.col("form"), forms) - col(money)
    loglik = value.bernoulli_loglik(col(accepted), value.accept_logit(F.col("beta"), net))
    return joined.select(F.col("form").alias("model"), *map(col, (subject, money, pain, accepted)),
                         F.struct("k", "beta").alias("draw"), "weight", "count", loglik.alias("loglik"))


def score_value_model(trials: DataFrame, params: DataFrame, forms: list[str], subject: str = "participant",
                      money: str = "moneylevel", pain: str = "painlevel") -> DataFrame:
    """Write the fitted values to the trials, or to the offers they are counted by: per form the
    pain value, net value, k, beta, bias (a copy of beta) and acceptance probability."""
    cells = []
    for f in forms:
        cells += [F.max(F.when(F.col("form") == f, F.col("k"))).alias(f"k_pain_{f}"),
                  F.max(F.when(F.col("form") == f, F.col("beta"))).alias(f"beta_{f}")]
    out = attach(trials, params.groupBy(col(subject)).agg(*cells), [subject])
    for f in forms:
        out = out.withColumn(f"sv_pain_{f}", value.stored_value(F.col(f"k_pain_{f}"), col(pain), f))
    out = out.withColumns({f"sv_both_{f}": value.net_value(F.col(f"sv_pain_{f}"), col(money)) for f in forms})
    return out.withColumns({
        **{f"bias_{f}": F.col(f"beta_{f}") for f in forms},
        **{f"p_accept_{f}": value.accept_probability(F.col(f"beta_{f}"), F.col(f"sv_both_{f}")) for f in forms}})


def ez_diffusion(trials: DataFrame, by: list[str], response: str = "accepted", rt: str = "rt",
                 s: float = 1.0) -> DataFrame:
    """Closed-form drift, boundary and non-decision time per cell.

    Mean and variance of the reaction time come from accepted trials. Moments
    are rounded to 12 digits before the edge test so that it does not depend on
    the order of summation.
    """
    answered = trials.filter(col(response).isNotNull() & col(rt).isNotNull())
    accepted_rt = F.when(col(response) == 1, col(rt).cast("double"))
    cells = answered.groupBy(*map(col, by)).agg(
        F.count(F.lit(1)).alias("n_trials"), F.avg(col(response)).alias("p_accept"),
        F.avg(accepted_rt).alias("mean_rt"), F.round(F.var_samp(accepted_rt), 12).alias("var_rt"))
    fitted = diffusion.ez_parameters(F.col("p_accept"), F.col("n_trials"), F.col("mean_rt"), F.col("var_rt"), s)
    return cells.withColumns(fitted)


def regression_by(df: DataFrame, by: list[str], y: str, terms: list[Term], intercept: bool = True,
                  link=None) -> DataFrame:
    """Ordinary least squares per group as (by, term, beta, n).

    ``link`` transforms the response, identity by default. A task sends one triangular
    factor per group, so a group of any size costs a few kilobytes per task. Groups
    whose design is rank deficient give no rows.
    """
    target = link(col(y)) if link else col(y)
    model = Model((), "_response", tuple(terms), intercept)
    fitted = pooled_regressions(df.withColumn("_response", target), by, [model], aliased=False)
    return fitted.select(*map(col, by), "term", "beta", "n")


def subject_regression(cells: DataFrame, params: dict[str, tuple[bool, list[Term]]], subject: str = "participant",
                       link=None) -> DataFrame:
    """Per-subject regressions of diffusion parameters on their design.

    ``cells`` holds one row per subject and level cell with the parameter columns
    (see ``ez_diffusion``); ``params`` is one entry of the model catalog.
    """
    fits = [regression_by(cells, [subject], p, terms, intercept, link).withColumn("param", F.lit(p))
            for p, (intercept, terms) in params.items()]
    return reduce(DataFrame.unionByName, fits)


def catalog_models(catalog: dict[int, dict], constants: tuple[str, ...]) -> tuple[list[Model], list[Model]]:
    """Models named (version, param) that are fitted per subject, and those that need all subjects.

    A regressor in ``constants`` has one value per subject, so its effect can only be
    seen between subjects.
    """
    within, pooled = [], []
    for version, params in catalog.items():
        for param, (intercept, terms) in params.items():
            between = any(r in constants for term in terms for r in term)
            (pooled if between else within).append(Model((version, param), param, tuple(terms), intercept))
    return within, pooled


def catalog_effects(cells: DataFrame, catalog: dict[int, dict], constants: tuple[str, ...] = (), subject: str = "participant") -> DataFrame:
    """Every model of a catalog: version, param, fit, term, mean, se, t, n.

    Models without between-subject regressors are fitted per subject, and mean, se and t
    are over the ``n`` subjects whose coefficient is known. The others are fitted once to
    the ``n`` cells of all subjects. All models of a kind share one pass over ``cells``.
    """
    within, pooled = catalog_models(catalog, constants)
    t = F.when(F.col("se") > 0, F.col("mean") / F.col("se")).alias("t")
    names = "version int, param string"
    parts = []
    if within:
        betas = cell_regressions(cells, subject, within, names)
        effects = group_effects(betas, ["version", "param", "term"])
        parts.append(effects.select("version", "param", F.lit("subject").alias("fit"), "term", "mean", "se", t, F.col("n_subjects").alias("n")))
    if pooled:
        fitted = pooled_regressions(cells, [], pooled, names).withColumnRenamed("beta", "mean")
        parts.append(fitted.select("version", "param", F.lit("pooled").alias("fit"), "term", "mean", "se", t, "n"))
    return reduce(DataFrame.unionByName, parts)


def group_effects(betas: DataFrame, keys: list[str], value_col: str = "beta") -> DataFrame:
    """Mean, standard error, t and number of subjects per coefficient."""
    stats = betas.groupBy(*map(col, keys)).agg(
        F.avg(col(value_col)).alias("mean"), (F.stddev_samp(col(value_col)) / F.sqrt(F.count(col(value_col)))).alias("se"),
        F.count(col(value_col)).alias("n_subjects"))
    return stats.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))


def wiener_grid(trials: DataFrame, by: list[str], v_grid, a_grid, t_grid, z_grid, response: str = "accepted",
                rt: str = "rt", terms: int = 7) -> DataFrame:
    """Summed diffusion log-likelihood per group and grid point, with its posterior
    weight under a flat prior on the grid."""
    axes = {"v": v_grid, "a": a_grid, "t": t_grid, "z": z_grid}
    return weighted_surface(collapse_trials(trials, by, response, rt), by, axes, terms)


def wiener_params(grid: DataFrame, by: list[str]) -> DataFrame:
    """Posterior mean and best grid point per group."""
    w = F.col("weight")
    names = ("v", "a", "t", "z")
    best = F.max_by(F.struct(*names), F.struct("loglik", *names))
    return grid.groupBy(*map(col, by)).agg(*[F.sum(w * F.col(n)).alias(n) for n in names], best.alias("_b")).select(
        *map(col, by), *names, *[F.col(f"_b.{n}").alias(f"{n}_map") for n in names])


def loglik_at(trials: DataFrame, params: DataFrame, by: list[str], response: str = "accepted", rt: str = "rt",
              terms: int = 7) -> DataFrame:
    """Summed diffusion log-likelihood at one parameter set per group."""
    return loglik_points(collapse_trials(trials, by, response, rt), params, by, terms)
