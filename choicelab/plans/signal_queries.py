"""Queries over signals and epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelab.operators import aggregates as ag
from choicelab.operators import clusters, joins, shaping, signals, windows
from choicelab.plans import views
from choicelab.plans.registry import query
from choicelab.plans.views import EPOCH_TRIALS, EPOCHS, SIGNAL
from choicelab.staging import stage


def _rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in cols})


def _keyed(long):
    return long.select("participant", "epoch", "channel", "t_idx", F.round("value", 8).alias("value"))


@query("average_reference", f"""WITH {EPOCHS}
SELECT participant, epoch, channel, t_idx, round(value - avg(value) OVER (PARTITION BY participant, epoch, t_idx), 8) AS value
FROM epochs""")
def average_reference(spark, sf):
    return _keyed(signals.average_reference(views.epochs(spark, sf), ["participant", "epoch", "t_idx"]))


@query("baseline_correct", f"""WITH {EPOCHS}
SELECT participant, epoch, channel, t_idx, round(value - avg(CASE WHEN t_idx <= 3 THEN value END)
  OVER (PARTITION BY participant, epoch, channel), 8) AS value FROM epochs""")
def baseline_correct(spark, sf):
    return _keyed(signals.to_long(signals.baseline_correct(views.epoch_arrays(spark, sf), 0, 3)))


@query("scale_channels", f"""WITH {EPOCHS}
SELECT participant, epoch, channel, t_idx, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS value
FROM epochs WINDOW w AS (PARTITION BY participant, channel)""")
def scale_channels(spark, sf):
    scaled = signals.scale_channels(views.epochs(spark, sf))
    return scaled.select("participant", "epoch", "channel", "t_idx", F.round("value", 6).alias("value"))


@query("peak_to_peak", f"""WITH {EPOCHS},
s AS (SELECT participant, epoch, channel, max(value) - min(value) > 0.45 AS bad FROM epochs GROUP BY ALL)
SELECT participant, epoch, coalesce(string_agg(CASE WHEN bad THEN CAST(channel AS VARCHAR) END, ',' ORDER BY channel), '') AS reasons,
  CAST(max(CASE WHEN bad THEN 1 ELSE 0 END) AS INT) AS badtrial FROM s GROUP BY participant, epoch""")
def peak_to_peak(spark, sf):
    logged = signals.reject_peak_to_peak(views.epoch_arrays(spark, sf), 0.45, ["participant", "epoch"])
    return logged.withColumn("reasons", F.array_join(F.col("reasons").cast("array<string>"), ","))


_DROPPED_SQL = f"""WITH {EPOCHS},
s AS (SELECT participant, epoch, max(CASE WHEN r > 0.45 THEN 1 ELSE 0 END) AS badtrial FROM (
  SELECT participant, epoch, channel, max(value) - min(value) AS r FROM epochs GROUP BY ALL) GROUP BY ALL)
SELECT participant, CAST(sum(1 - badtrial) AS BIGINT) AS kept, round((60 - sum(1 - badtrial)) / 60 * 100, 6) AS perc_removed
FROM s GROUP BY participant"""


@query("epoch_rejection_stats", _DROPPED_SQL)
def epoch_rejection_stats(spark, sf):
    logged = signals.reject_peak_to_peak(views.epoch_arrays(spark, sf), 0.45, ["participant", "epoch"])
    return _rounded(ag.rejection_stats(logged, n_trials=60), ["perc_removed"])


@query("channel_matrix", f"""WITH {EPOCHS},
m AS (SELECT n_nationkey % 4 AS in_ch, n_regionkey % 4 AS out_ch, sum(0.1::DOUBLE * n_regionkey - 0.02::DOUBLE * n_nationkey) AS w
  FROM nation GROUP BY ALL)
SELECT participant, epoch, t_idx, out_ch AS channel, round(sum(value * w), 8) AS value FROM epochs JOIN m ON channel = in_ch
GROUP BY ALL""")
def channel_matrix(spark, sf):
    nation = views.table(spark, sf, "nation")
    matrix = nation.groupBy((F.col("n_nationkey") % 4).alias("in_ch"), (F.col("n_regionkey") % 4).alias("out_ch")).agg(
        F.sum(0.1 * F.col("n_regionkey") - 0.02 * F.col("n_nationkey")).alias("w"))
    out = signals.apply_channel_matrix(views.epochs(spark, sf), matrix, ["participant", "epoch", "t_idx"])
    return _keyed(out)


@query("drop_pick_channels", f"""WITH {EPOCHS}
SELECT participant, channel, count(*) AS n, round(avg(value), 8) AS value FROM epochs WHERE channel IN (1, 2) GROUP BY ALL""")
def drop_pick_channels(spark, sf):
    kept = shaping.pick_channels(shaping.drop_channels(views.epochs(spark, sf), [3]), [1, 2, 3])
    return kept.groupBy("participant", "channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 8).alias("value"))


@query("decimate", f"""WITH {SIGNAL}
SELECT recording, channel, t // 4 AS t, round(value, 8) AS value FROM signal WHERE t % 4 = 0""")
def decimate(spark, sf):
    out = signals.decimate(views.signal(spark, sf), 4, "t")
    return out.select("recording", "channel", "t", F.round("value", 8).alias("value"))


@query("bucket_mean", f"""WITH {SIGNAL}
SELECT recording, channel, t // 8 AS t, round(avg(value), 8) AS value FROM signal GROUP BY ALL""")
def bucket_mean(spark, sf):
    return _rounded(signals.bucket_mean(views.signal(spark, sf), ["recording", "channel"], 8, "t"), ["value"], 8)


_KERNEL = signals.fir_kernel(1024, high=120, taps=9)
_KERNEL_ROWS = ", ".join(f"({i - 4}, {w!r}::DOUBLE)" for i, w in enumerate(_KERNEL))


@query("fir_short", f"""WITH {SIGNAL}, k(o, w) AS (VALUES {_KERNEL_ROWS})
SELECT a.recording, a.channel, a.t, round(sum(b.value * w), 8) AS value FROM signal a JOIN k ON true
JOIN signal b ON a.recording = b.recording AND a.channel = b.channel AND b.t = a.t - o GROUP BY ALL""")
def fir_short(spark, sf):
    out = signals.fir_filter(views.signal(spark, sf), _KERNEL, ["recording", "channel"], "t", chunk=512)
    return _rounded(out, ["value"], 8)


_BAND = signals.fir_kernel(1024, low=20, high=200, taps=201)
_BAND_ROWS = ", ".join(f"({i - 100}, {w!r}::DOUBLE)" for i, w in enumerate(_BAND))


@query("fir_band", f"""WITH {SIGNAL}, k(o, w) AS (VALUES {_BAND_ROWS})
SELECT a.recording, a.channel, a.t, round(sum(b.value * w), 8) AS value FROM signal a JOIN k ON true
JOIN signal b ON a.recording = b.recording AND a.channel = b.channel AND b.t = a.t - o GROUP BY ALL""")
def fir_band(spark, sf):
    out = signals.fir_filter(views.signal(spark, sf), _BAND, ["recording", "channel"], "t")
    return _rounded(out, ["value"], 8)


_SEG = 32


@query("power_spectrum", f"""WITH {SIGNAL},
f AS (SELECT unnest(generate_series(0, {_SEG // 2})) AS k),
full_segments AS (SELECT recording, channel, t // {_SEG} AS seg FROM signal WHERE t < 1024 GROUP BY ALL HAVING count(*) = {_SEG}),
d AS (SELECT recording, channel, t // {_SEG} AS seg, k, sum(value * cos(2 * pi() * k * (t % {_SEG}) / {_SEG})) AS c,
  sum(value * sin(2 * pi() * k * (t % {_SEG}) / {_SEG})) AS s FROM signal, f WHERE t < 1024 GROUP BY ALL),
p AS (SELECT recording, channel, k, (c * c + s * s) / (1024 * {_SEG}) * CASE WHEN k IN (0, {_SEG // 2}) THEN 1 ELSE 2 END AS power
  FROM d SEMI JOIN full_segments USING (recording, channel, seg))
SELECT recording, channel, k * 32.0::DOUBLE AS freq, round(avg(power) * 1e6, 6) AS power FROM p WHERE k * 32 <= 500 GROUP BY ALL""")
def power_spectrum(spark, sf):
    spec = signals.power_spectrum(views.signal(spark, sf), ["recording", "channel"], _SEG, 1024.0, fmax=500, last=1024, time="t")
    return spec.withColumn("power", F.round(F.col("power") * 1e6, 6))


@query("window_amplitude", f"""WITH {EPOCHS},
a AS (SELECT participant, epoch, avg(value) AS amp FROM epochs WHERE channel IN (0, 2) AND t_idx BETWEEN 6 AND 11 GROUP BY ALL)
SELECT participant, epoch, round(amp, 8) AS amp,
  round((amp - avg(amp) OVER w) / nullif(stddev_pop(amp) OVER w, 0), 6) AS amp_z FROM a WINDOW w AS (PARTITION BY participant)""")
def window_amplitude(spark, sf):
    amp = signals.window_amplitude(views.epoch_arrays(spark, sf), [0, 2], 6, 11)
    return amp.select("participant", "epoch", F.round("amp", 8).alias("amp"), F.round("amp_z", 6).alias("amp_z"))


@query("evoked", f"""WITH {EPOCHS}, {EPOCH_TRIALS}
SELECT participant, condition, channel, t_idx, round(avg(value), 8) AS value
FROM epochs JOIN epoch_trials USING (participant, epoch) GROUP BY ALL""")
def evoked(spark, sf):
    cond = views.epoch_trials(spark, sf).select("participant", "epoch", "condition")
    arrays = views.epoch_arrays(spark, sf).join(cond, ["participant", "epoch"])
    return _rounded(signals.evoked(arrays, ["participant", "condition", "channel"]), ["value"], 8)


@query("grand_average", f"""WITH {EPOCHS}, {EPOCH_TRIALS},
s AS (SELECT participant, condition, channel, t_idx, avg(value) AS value
  FROM epochs JOIN epoch_trials USING (participant, epoch) GROUP BY ALL)
SELECT condition, channel, t_idx, round(avg(value), 8) AS value, count(*) AS n_subjects FROM s GROUP BY ALL""")
def grand_average(spark, sf):
    cond = views.epoch_trials(spark, sf).select("participant", "epoch", "condition")
    long = signals.to_long(views.epoch_arrays(spark, sf).join(cond, ["participant", "epoch"]))
    return _rounded(ag.grand_average(long, "participant", ["condition", "channel", "t_idx"], "value"), ["value"], 8)


_BETAS = EPOCHS + ", " + EPOCH_TRIALS + """,
r AS (SELECT participant, epoch, 'price' AS regressor, price AS x FROM epoch_trials
  UNION ALL SELECT participant, epoch, 'late', late FROM epoch_trials WHERE late IS NOT NULL),
rz AS (SELECT participant, epoch, regressor, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM r
  WINDOW w AS (PARTITION BY participant, regressor)),
ez AS (SELECT participant, epoch, channel, t_idx, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS y FROM epochs
  WINDOW w AS (PARTITION BY participant, channel)),
betas AS (SELECT participant, regressor, channel, t_idx, regr_slope(y, x) AS beta FROM ez JOIN rz USING (participant, epoch)
  GROUP BY ALL)"""


def betas(spark, sf):
    return signals.massunivariate_ols(views.epoch_arrays(spark, sf), views.epoch_trials(spark, sf), ["price", "late"])


@query("massunivariate", f"WITH {_BETAS} SELECT participant, regressor, channel, t_idx, round(beta, 6) AS beta FROM betas")
def massunivariate(spark, sf):
    return _rounded(betas(spark, sf), ["beta"])


@query("group_t", f"""WITH {_BETAS}
SELECT regressor, channel, t_idx, round(avg(beta), 6) AS mean, count(beta) AS n,
  round(avg(beta) / (stddev_samp(beta) / sqrt(count(beta))), 5) AS t FROM betas GROUP BY ALL""")
def group_t(spark, sf):
    t = signals.onesample_t(betas(spark, sf), ["regressor", "channel", "t_idx"])
    return _rounded(_rounded(t, ["mean"]), ["t"], 5)


@query("sem_course", f"""WITH {_BETAS}
SELECT regressor, channel, t_idx, round(avg(beta), 6) AS mean, round(stddev_samp(beta) / sqrt(count(beta)), 6) AS sem
FROM betas GROUP BY ALL""")
def sem_course(spark, sf):
    return _rounded(signals.beta_timecourse(betas(spark, sf), ["regressor", "channel", "t_idx"]), ["mean", "sem"])


@query("binned_evoked", f"""WITH {EPOCHS}, {EPOCH_TRIALS},
e AS (SELECT quantile_cont(price, 0.5) AS q FROM epoch_trials),
b AS (SELECT participant, epoch, CASE WHEN price > q THEN 1 ELSE 0 END AS bin FROM epoch_trials, e),
s AS (SELECT participant, bin, channel, t_idx, avg(value) AS value FROM epochs JOIN b USING (participant, epoch) GROUP BY ALL)
SELECT bin, channel, t_idx, round(avg(value), 8) AS value, count(*) AS n_subjects FROM s GROUP BY ALL""")
def binned_evoked(spark, sf):
    out = signals.binned_evoked(views.epoch_arrays(spark, sf), views.epoch_trials(spark, sf), "price", 2)
    return _rounded(out, ["value"], 8)


_TARGETS = [0.2, 0.4, 0.6, 0.8]


@query("nearest_time", f"""WITH {EPOCHS},
t AS (SELECT DISTINCT t_idx / 16 AS t FROM epochs), x AS (SELECT unnest({_TARGETS}::DOUBLE[]) AS target)
SELECT target, t AS nearest FROM t, x QUALIFY row_number() OVER (PARTITION BY target ORDER BY abs(t - target), t) = 1""")
def nearest_time(spark, sf):
    times = views.epochs(spark, sf).select((F.col("t_idx") / 16).alias("t")).distinct()
    return joins.nearest_time(times, _TARGETS, "t")


@query("epoch_regular", f"""WITH {SIGNAL},
ev AS (SELECT label AS recording, CAST(vec_id % 37 * 16 + 8 AS BIGINT) AS sample, min(vec_id) AS cue FROM embeddings GROUP BY ALL)
SELECT s.recording, channel, cue, CAST(s.t - ev.sample AS INT) AS t_idx, round(value, 8) AS value
FROM signal s JOIN ev ON s.recording = ev.recording AND s.t BETWEEN ev.sample - 4 AND ev.sample + 12""")
def epoch_regular(spark, sf):
    emb = views.table(spark, sf, "embeddings")
    events = emb.groupBy(F.col("label").alias("recording"), (F.col("vec_id") % 37 * 16 + 8).alias("sample")).agg(
        F.min("vec_id").alias("cue"))
    out = joins.epoch_regular(views.signal(spark, sf), events, ["recording"], "t", "sample", -4, 12)
    return out.select("recording", "channel", "cue", "t_idx", F.round("value", 8).alias("value"))


_P, _N_PERM, _SEED = 0.2, 5000, 23
# The given vectors carry ten labels, that is ten participants.
_THRESHOLD = signals.t_critical(_P, 9)

_CLUSTER = _BETAS.replace("cells AS", "RECURSIVE cells AS", 1) + f""",
pm AS (SELECT unnest(generate_series(0, {_N_PERM - 1})) AS perm),
sg AS (SELECT perm, participant, CASE WHEN perm = 0 OR substring(md5('{_SEED}:' || perm || ':' || participant), 1, 1) < '8'
  THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM pm, (SELECT DISTINCT participant FROM betas)),
tm AS MATERIALIZED (SELECT regressor, perm, channel, t_idx, avg(s * beta) / (stddev_samp(s * beta) / sqrt(count(*))) AS t
  FROM betas JOIN sg USING (participant) GROUP BY ALL),
pt AS MATERIALIZED (SELECT regressor, perm, channel, t_idx, t, sign(t) AS sgn, channel * 100 + t_idx AS id FROM tm
  WHERE abs(t) > {_THRESHOLD!r}::DOUBLE),
lk AS MATERIALIZED (SELECT a.regressor, a.perm, a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.regressor = b.regressor AND a.perm = b.perm AND a.sgn = b.sgn
  AND abs(a.channel - b.channel) + abs(a.t_idx - b.t_idx) = 1),
rc AS (SELECT regressor, perm, id, id AS root FROM pt UNION SELECT rc.regressor, rc.perm, lk.b, rc.root
  FROM rc JOIN lk ON rc.regressor = lk.regressor AND rc.perm = lk.perm AND rc.id = lk.a),
cl AS (SELECT regressor, perm, id, min(root) AS cluster FROM rc GROUP BY regressor, perm, id),
ma AS MATERIALIZED (SELECT regressor, perm, cluster, round(sum(t), 9) AS mass FROM pt JOIN cl USING (regressor, perm, id) GROUP BY regressor, perm, cluster),
mx AS (SELECT regressor, perm, max(abs(mass)) AS top FROM ma GROUP BY regressor, perm),
pv AS (SELECT m.regressor, m.cluster, count(*) FILTER (top >= abs(mass)) / {_N_PERM} AS p FROM ma m JOIN mx USING (regressor) WHERE m.perm = 0 GROUP BY ALL),
pp AS (SELECT tm.regressor, tm.channel, tm.t_idx, tm.t, coalesce(pv.p, 1.0::DOUBLE) AS p FROM tm
  LEFT JOIN pt ON pt.regressor = tm.regressor AND pt.perm = 0 AND pt.channel = tm.channel AND pt.t_idx = tm.t_idx
  LEFT JOIN cl ON cl.regressor = tm.regressor AND cl.perm = 0 AND cl.id = pt.id
  LEFT JOIN pv ON pv.regressor = tm.regressor AND pv.cluster = cl.cluster WHERE tm.perm = 0)"""


def _tested(slopes):
    """Cluster test of all regressors; channels form a chain of neighbours."""
    n = slopes.select("participant").distinct().count()
    pairs = slopes.select(F.col("channel").alias("channel_a")).distinct().withColumn("channel_b", F.col("channel_a") + 1)
    edges = pairs.filter(F.col("channel_b") < views.CHANNELS)
    return clusters.cluster_permutation(slopes, edges, _N_PERM, _SEED, signals.t_critical(_P, n - 1), by=("regressor",))


@query("cluster_permutation", f"WITH {_CLUSTER} SELECT regressor, channel, t_idx, round(t, 6) AS t, round(p, 6) AS p FROM pp")
def cluster_permutation(spark, sf):
    out = _tested(stage(betas(spark, sf), "betas"))
    return _rounded(out.select("regressor", "channel", "t_idx", "t", "p"), ["t", "p"], 6)


@query("significant_timecourse", f"""WITH {_CLUSTER},
co AS (SELECT regressor, channel, t_idx, avg(beta) AS mean, stddev_samp(beta) / sqrt(count(beta)) AS sem FROM betas GROUP BY ALL)
SELECT regressor, channel, t_idx, round(mean, 6) AS mean, round(sem, 6) AS sem, p < 0.5 AS significant FROM co JOIN pp USING (regressor, channel, t_idx)""")
def significant_timecourse(spark, sf):
    """Mean slope with its error and the points inside clusters below an alpha of one half."""
    slopes = stage(betas(spark, sf), "betas")
    point = ["regressor", "channel", "t_idx"]
    course = signals.beta_timecourse(slopes, point, _tested(slopes).select(*point, "p"), 0.5)
    return _rounded(course, ["mean", "sem"])
