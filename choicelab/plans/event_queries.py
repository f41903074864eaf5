"""Queries over event marks: recoding, gaps, timing checks, epochs in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelab.functions import columns as fc
from choicelab.operators import aggregates as ag
from choicelab.operators import joins, shaping, windows
from choicelab.plans import views
from choicelab.plans.registry import query
from choicelab.plans.views import MARKS

CODES = {"view": 81, "click": 82, "purchase": 91, "signup": 92}
HOUR = 3_600_000_000


@query("recode_events", f"""WITH {MARKS}
SELECT event_id, CASE label WHEN 'view' THEN 81 WHEN 'click' THEN 82 WHEN 'purchase' THEN 91 WHEN 'signup' THEN 92 END
  AS code FROM marks""")
def recode_events(spark, sf):
    m = views.marks(spark, sf).withColumn("label", F.concat(F.lit("Comment/"), "label"))
    return m.select("event_id", fc.recode(F.col("label"), CODES, strip="Comment/").alias("code"))


@query("drop_codes", f"""WITH {MARKS}
SELECT recording, label, count(*) AS n FROM marks WHERE label NOT IN ('error', 'signup') GROUP BY ALL""")
def drop_codes(spark, sf):
    m = views.marks(spark, sf).withColumn("code", fc.recode(F.col("label"), CODES))
    return ag.value_counts(shaping.drop_event_codes(m, [92], ["error"]), ["recording", "label"])


@query("event_gaps", f"""WITH {MARKS}
SELECT event_id, recording, label, sample - coalesce(lag(sample) OVER (PARTITION BY recording ORDER BY sample, event_id), sample)
  AS diff FROM marks""")
def event_gaps(spark, sf):
    gaps = windows.event_gaps(views.marks(spark, sf), ["recording"], "sample", ["sample", "event_id"])
    return gaps.select("event_id", "recording", "label", "diff")


_ERROR = MARKS + """,
gaps AS (SELECT event_id, recording, label, sample, sample - coalesce(lag(sample) OVER (
  PARTITION BY recording ORDER BY sample, event_id), sample) AS diff FROM marks),
g AS (SELECT recording, diff / 1000.0::DOUBLE AS gap, row_number() OVER (PARTITION BY recording ORDER BY sample, event_id) AS n
  FROM gaps WHERE label = 'purchase'),
d AS (SELECT recording, value * 1000 AS duration, row_number() OVER (PARTITION BY recording ORDER BY sample, event_id) AS n
  FROM marks WHERE label = 'view'),
e AS (SELECT recording, n, gap - duration AS error FROM g FULL JOIN d USING (recording, n))"""


def _timing(spark, sf):
    m = views.marks(spark, sf)
    gaps = windows.event_gaps(m, ["recording"], "sample", ["sample", "event_id"])
    gaps = shaping.filter_eq(gaps, "label", "purchase").withColumn("gap", F.col("diff") / 1000)
    logged = shaping.filter_eq(m, "label", "view").withColumn("duration", fc.unit_scale(F.col("value"), 1e3))
    order = ["sample", "event_id"]
    return windows.timing_error(gaps, logged, ["recording"], "gap", order, "duration", order)


@query("timing_error", f"WITH {_ERROR} SELECT recording, n, round(error, 4) AS error FROM e")
def timing_error(spark, sf):
    return _timing(spark, sf).withColumn("error", F.round("error", 4))


@query("timing_summary", f"""WITH {_ERROR}
SELECT recording, count(error) AS count, round(avg(error), 0) AS mean, round(stddev_samp(error), 2) AS std,
  round(min(error), 6) AS min, round(quantile_cont(error, 0.25), 6) AS q25, round(quantile_cont(error, 0.5), 6) AS q50,
  round(quantile_cont(error, 0.75), 6) AS q75, round(max(error), 6) AS max FROM e GROUP BY recording""")
def timing_summary(spark, sf):
    s = windows.timing_summary(_timing(spark, sf), ["recording"])
    return s.select("recording", "count", F.round("mean", 0).alias("mean"), F.round("std", 2).alias("std"),
                    *[F.round(c, 6).alias(c) for c in ("min", "q25", "q50", "q75", "max")])


@query("first_values", f"""WITH {MARKS}
SELECT recording, label, value FROM marks QUALIFY row_number() OVER (PARTITION BY recording ORDER BY sample, event_id) = 1""")
def first_values(spark, sf):
    return ag.first_value_by(views.marks(spark, sf), ["recording"], ["sample", "event_id"], ["label", "value"])


@query("epoch_join", f"""WITH {MARKS}
SELECT p.event_id AS cue, s.event_id AS event_id, s.sample - p.sample AS "offset", s.value
FROM marks p JOIN marks s ON s.recording = p.recording
  AND s.sample BETWEEN p.sample - 12 * {HOUR} AND p.sample + 24 * {HOUR} WHERE p.label = 'purchase'""")
def epoch_join(spark, sf):
    m = views.marks(spark, sf)
    cues = shaping.filter_eq(m, "label", "purchase").select("recording", F.col("event_id").alias("cue"),
                                                           F.col("sample").alias("cue_sample"))
    samples = m.select("recording", "event_id", "sample", "value")
    out = joins.epoch_join(samples, cues, ["recording"], "sample", "cue_sample", -12 * HOUR, 24 * HOUR)
    return out.select("cue", "event_id", "offset", "value")


@query("bad_channels", f"""WITH {MARKS}, c AS (
  SELECT recording, label AS name, CASE WHEN avg(value) > 50 THEN 'bad' ELSE 'good' END AS status FROM marks GROUP BY ALL)
SELECT recording, coalesce(string_agg(CASE WHEN status <> 'good' THEN name END, ',' ORDER BY name), '') AS bads,
  count(CASE WHEN status <> 'good' THEN 1 END) AS n_bad FROM c GROUP BY recording""")
def bad_channels(spark, sf):
    from choicelab.sources.readers import channel_table

    m = views.marks(spark, sf)
    c = m.groupBy("recording", F.col("label").alias("name")).agg(
        F.when(F.avg("value") > 50, "bad").otherwise("good").alias("status"))
    return channel_table(c).withColumn("bads", F.array_join("bads", ","))
