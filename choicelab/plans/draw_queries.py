"""Queries over posterior draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelab.functions import columns as fc
from choicelab.operators import joins
from choicelab.operators import posterior as post
from choicelab.plans import views
from choicelab.plans.registry import query
from choicelab.plans.views import DRAWS, TRIALS


def _rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(f"`{c}`", digits) for c in cols})


@query("gelman_rubin", f"""WITH {DRAWS},
c AS (SELECT param, chain, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM draws GROUP BY param, chain),
p AS (SELECT param, count(*) AS n_chains, avg(n) AS n, avg(v) AS w, var_samp(m) AS b FROM c GROUP BY param)
SELECT param, n_chains, round(sqrt(((n - 1) / n * w + b) / w), 6) AS r_hat FROM p""")
def gelman_rubin(spark, sf):
    return _rounded(post.gelman_rubin(views.draws(spark, sf), ["param"]), ["r_hat"])


@query("posterior_summary", f"""WITH {DRAWS},
s AS (SELECT param, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std,
  quantile_cont(value, [0.025, 0.25, 0.5, 0.75, 0.975]) AS q FROM draws GROUP BY param),
b AS (SELECT param, (chain * 64 + draw) * 100 // n AS batch, avg(value) AS m FROM draws JOIN s USING (param) GROUP BY ALL),
e AS (SELECT param, stddev_pop(m) / sqrt(count(m)) AS mc_err FROM b GROUP BY param)
SELECT param, round(mean, 6) AS mean, round(std, 6) AS std, round(q[1], 6) AS "2.5q", round(q[2], 6) AS "25q",
  round(q[3], 6) AS "50q", round(q[4], 6) AS "75q", round(q[5], 6) AS "97.5q", round(mc_err, 6) AS mc_err
FROM s JOIN e USING (param)""")
def posterior_summary(spark, sf):
    s = post.posterior_summary(views.draws(spark, sf), ["param"])
    return _rounded(s, [c for c in s.columns if c != "param"])


@query("sign_probability", f"""WITH {DRAWS},
s AS (SELECT param, least(avg(CASE WHEN value > 0 THEN 1 ELSE 0 END), avg(CASE WHEN value < 0 THEN 1 ELSE 0 END)) AS s
  FROM draws GROUP BY param)
SELECT param, round(least(s, 1 - s), 6) AS p FROM s""")
def sign_probability(spark, sf):
    return _rounded(post.sign_probability(views.draws(spark, sf), ["param"]), ["p"])


_PAIRS = [(0, 1), (2, 3), (4, 0)]


@query("draw_comparison", f"""WITH {DRAWS} {' UNION ALL '.join(f'''
SELECT {a} AS "first", {b} AS "second", round(avg(CASE WHEN x.value > y.value THEN 1 ELSE 0 END), 6) AS p_greater, count(*) AS n_draws
FROM draws x JOIN draws y USING (chain, draw) WHERE x.param = {a} AND y.param = {b}''' for a, b in _PAIRS)}""")
def draw_comparison(spark, sf):
    return _rounded(joins.compare_draws(views.draws(spark, sf), _PAIRS), ["p_greater"])


@query("posterior_mean_first_chain", f"""WITH {DRAWS}
SELECT param, round(avg(value), 6) AS mean FROM draws WHERE chain = 0 GROUP BY param""")
def posterior_mean_first_chain(spark, sf):
    return _rounded(post.posterior_mean_by(views.draws(spark, sf), ["param"], chain=0), ["mean"])


@query("transform_draws", f"""WITH {DRAWS}
SELECT param, round(avg(CASE WHEN param IN (0, 3) THEN 1 / (1 + exp(-value)) ELSE value END), 6) AS mean
FROM draws GROUP BY param""")
def transform_draws(spark, sf):
    d = post.transform_draws(views.draws(spark, sf), [0, 3], fc.inv_logit)
    return _rounded(post.posterior_mean_by(d, ["param"]), ["mean"])


@query("combine_chains", f"""WITH {DRAWS} SELECT param, count(*) AS n, round(avg(value), 6) AS mean FROM draws GROUP BY param""")
def combine_chains(spark, sf):
    d = views.draws(spark, sf)
    both = post.combine_chains(d.filter("chain % 2 = 0"), d.filter("chain % 2 = 1"))
    return both.groupBy("param").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("hdi", f"""WITH {DRAWS},
r AS (SELECT param, value, row_number() OVER (PARTITION BY param ORDER BY value) AS k, count(*) OVER (PARTITION BY param) AS n
  FROM draws),
i AS (SELECT a.param, a.value AS lo, b.value AS hi FROM r a JOIN r b
  ON a.param = b.param AND b.k = a.k + CAST(floor(a.n * 0.94::DOUBLE) AS BIGINT))
SELECT param, round(lo, 9) AS hdi_low, round(hi, 9) AS hdi_high FROM i
QUALIFY row_number() OVER (PARTITION BY param ORDER BY hi - lo, lo) = 1""")
def hdi(spark, sf):
    return _rounded(post.hdi(views.draws(spark, sf), ["param"]), ["hdi_low", "hdi_high"], 9)


@query("autocovariance", f"""WITH {DRAWS},
c AS (SELECT param, chain, draw, value - avg(value) OVER (PARTITION BY param, chain) AS c,
  count(*) OVER (PARTITION BY param, chain) AS n FROM draws),
l AS (SELECT unnest(generate_series(0, 10)) AS lag),
p AS (SELECT a.param, a.chain, lag, sum(a.c * b.c) / any_value(a.n) AS v FROM c a JOIN l ON true
  JOIN c b ON a.param = b.param AND a.chain = b.chain AND b.draw = a.draw + lag GROUP BY ALL)
SELECT param, CAST(lag AS INT) AS lag, round(avg(v), 8) AS autocov FROM p GROUP BY ALL""")
def autocovariance(spark, sf):
    return _rounded(post.autocovariance(views.draws(spark, sf), ["param"], 10), ["autocov"], 8)


@query("interval_summary", f"""WITH {DRAWS},
c AS (SELECT param, chain, draw, value - avg(value) OVER w AS c, count(*) OVER w AS n FROM draws
  WINDOW w AS (PARTITION BY param, chain)),
l AS (SELECT unnest(generate_series(0, (SELECT max(draw) + 1 FROM draws))) AS lag),
pr AS (SELECT a.param, a.chain, lag, sum(a.c * b.c) / any_value(a.n) AS v FROM c a JOIN l ON true
  JOIN c b ON a.param = b.param AND a.chain = b.chain AND b.draw = a.draw + lag GROUP BY ALL),
ac AS (SELECT param, lag, avg(v) AS autocov FROM pr GROUP BY ALL),
ch AS (SELECT param, chain, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM draws GROUP BY ALL),
po AS (SELECT param, sum(n) AS total, avg(n) AS n, avg(v) AS w, var_samp(m) AS b FROM ch GROUP BY param),
rho AS (SELECT param, lag // 2 AS pair, lag, total, CASE WHEN lag = 0 THEN 1 ELSE
  1 - (w - autocov * n / (n - 1)) / ((n - 1) / n * w + b) END AS rho FROM ac JOIN po USING (param)),
pa AS (SELECT param, pair, any_value(total) AS total, sum(rho) AS s FROM rho GROUP BY param, pair HAVING count(*) = 2),
cm AS (SELECT param, total, min(s) OVER (PARTITION BY param ORDER BY pair) AS s FROM pa),
es AS (SELECT param, any_value(total) / greatest(-1 + 2 * sum(s), 1 / log10(any_value(total))) AS ess FROM cm WHERE s > 0 GROUP BY param),
r AS (SELECT param, value, row_number() OVER (PARTITION BY param ORDER BY value) AS k, count(*) OVER (PARTITION BY param) AS n
  FROM draws),
hd AS (SELECT a.param, a.value AS lo, b.value AS hi FROM r a JOIN r b
  ON a.param = b.param AND b.k = a.k + CAST(floor(a.n * 0.94::DOUBLE) AS BIGINT)
  QUALIFY row_number() OVER (PARTITION BY a.param ORDER BY b.value - a.value, a.value) = 1),
mo AS (SELECT param, avg(value) AS mean, stddev_samp(value) AS sd FROM draws GROUP BY param)
SELECT param, round(mean, 6) AS mean, round(sd, 6) AS sd, round(lo, 6) AS hdi_low, round(hi, 6) AS hdi_high,
  round(sd / sqrt(ess), 6) AS mcse_mean, round(ess, 3) AS ess, round(sqrt(((n - 1) / n * w + b) / w), 6) AS r_hat
FROM mo JOIN hd USING (param) JOIN es USING (param) JOIN po USING (param)""")
def interval_summary(spark, sf):
    s = post.interval_summary(views.draws(spark, sf), ["param"])
    return _rounded(_rounded(s, [c for c in s.columns if c not in ("param", "ess")]), ["ess"], 3)


_GRID = 40


@query("posterior_density", f"""WITH {DRAWS},
s AS (SELECT param, stddev_samp(value) * pow(count(value), -0.2) AS bw, min(value) AS lo, max(value) AS hi
  FROM draws GROUP BY param),
g AS (SELECT param, bw, point, lo - 3 * bw + ((hi + 3 * bw) - (lo - 3 * bw)) * point / {_GRID - 1} AS x
  FROM s, (SELECT unnest(generate_series(0, {_GRID - 1})) AS point))
SELECT param, CAST(point AS INT) AS point, round(any_value(x), 6) AS x,
  round(avg(exp(-((x - value) / bw) * ((x - value) / bw) / 2) / (bw * sqrt(2 * pi()))), 6) AS density
FROM draws JOIN g USING (param) GROUP BY param, point""")
def posterior_density(spark, sf):
    return _rounded(post.posterior_density(views.draws(spark, sf), ["param"], _GRID), ["x", "density"])


# Subject-level draws: the chain number names the subject, the label the parameter.
_SUBJECT_DRAWS = DRAWS + """,
sd AS (SELECT chain AS subject, param, draw, value FROM draws)"""


def _subject_draws(spark, sf):
    return views.draws(spark, sf).withColumnRenamed("chain", "subject")


@query("subject_params", f"""WITH {_SUBJECT_DRAWS}
SELECT subject, {', '.join(f"round(avg(CASE WHEN param = {p} THEN value END), 6) AS param_{p}" for p in range(4))}
FROM sd GROUP BY subject""")
def subject_params(spark, sf):
    wide = post.subject_param_matrix(_subject_draws(spark, sf), [0, 1, 2, 3], prefix="param_")
    return _rounded(wide, [f"param_{p}" for p in range(4)])


def _contribution_sql(terms: dict[str, tuple[int, str]], masks: dict[str, str] | None = None) -> str:
    masks = masks or {}
    cells = ", ".join(
        f'round(avg(CASE WHEN {masks.get(out, "true")} THEN m{p} * {x} END), 6) AS "{out}"' for out, (p, x) in terms.items())
    means = ", ".join(f"avg(CASE WHEN param = {p} THEN value END) AS m{p}" for p in sorted({p for p, _ in terms.values()}))
    return f"""WITH {_SUBJECT_DRAWS}, {TRIALS},
m AS (SELECT subject AS participant, {means} FROM sd GROUP BY subject)
SELECT participant, painlevel, moneylevel, count(*) AS n, {cells} FROM trials LEFT JOIN m USING (participant) GROUP BY ALL"""


def _contribution(spark, sf, terms, mask=None):
    d = _subject_draws(spark, sf).withColumnRenamed("subject", "participant")
    t = joins.contribution(views.trials(spark, sf), d, terms, "participant", mask=mask)
    return t.groupBy("participant", "painlevel", "moneylevel").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(out), 6).alias(out) for out in terms])


_ONE = {"v_pain_contrib": (0, "painlevel")}
_FOUR = {f"full_{n}_contrib": (i, "painlevel") for i, n in enumerate("vatz")}
_MONEY = {"v_money_contrib": (1, "moneylevel")}
_ABS = {"abs_low": (0, "painlevel"), "abs_mid": (1, "painlevel"), "abs_high": (2, "painlevel")}
_OV = {"ov_low": (3, "painlevel"), "ov_high": (4, "painlevel")}


@query("contribution_pain", _contribution_sql(_ONE))
def contribution_pain(spark, sf):
    return _contribution(spark, sf, _ONE)


@query("contribution_all_params", _contribution_sql(_FOUR))
def contribution_all_params(spark, sf):
    return _contribution(spark, sf, _FOUR)


@query("contribution_money", _contribution_sql(_MONEY))
def contribution_money(spark, sf):
    return _contribution(spark, sf, _MONEY)


@query("contribution_abs_levels", _contribution_sql(_ABS))
def contribution_abs_levels(spark, sf):
    return _contribution(spark, sf, _ABS)


@query("contribution_ov_levels", _contribution_sql(_OV, {
    "ov_low": "moneylevel + painlevel <= 5", "ov_high": "moneylevel + painlevel > 5"}))
def contribution_ov_levels(spark, sf):
    total = F.col("moneylevel") + F.col("painlevel")
    return _contribution(spark, sf, _OV, {"ov_low": total <= 5, "ov_high": total > 5})
