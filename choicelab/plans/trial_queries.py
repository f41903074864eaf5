"""Queries over the trial table: preparation, condition codes, exclusion, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicelab.functions import columns as fc
from choicelab.functions.conditions import CONDITIONS
from choicelab.operators import aggregates as ag
from choicelab.operators import joins, shaping, windows
from choicelab.plans import views
from choicelab.plans.registry import query
from choicelab.plans.views import LEVELS, NUMBERED, SUBJECTS, TRIALS
from choicelab.staging import stage

# Share of accepted offers above which a subject of the given tables is excluded.
SHARE = 0.57
# Moments are rounded to 6 digits, observed values to 9.
DIGITS = {"mean": 6, "std": 6}


def text_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Trials as they come from a file: every level is text."""
    t = views.trials(spark, sf)
    return t.withColumns({"moneystim": F.concat(F.lit("m"), "moneylevel"), "painlevel": F.col("painlevel").cast("string"),
                          "accepted": F.col("accepted").cast("string")}).drop("moneylevel")


def prepared_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Parse, coerce, drop incomplete trials and exclude subjects who nearly always accept."""
    raw = text_trials(spark, sf).withColumn("moneylevel", fc.parse_prefixed_int(F.col("moneystim"), "m"))
    complete = shaping.drop_incomplete(raw, ["moneylevel", "painlevel", "accepted"])
    numeric = shaping.coerce_numeric(complete, ["painlevel", "accepted"])
    numeric = shaping.cast_int(numeric, ["painlevel", "accepted"])
    return ag.exclude_subjects(numeric, n_trials=None, share=SHARE)


KEPT = TRIALS + f""",
kept AS (SELECT participant FROM trials GROUP BY participant HAVING sum(accepted) < count(*) * {SHARE}::DOUBLE),
prepared AS (SELECT * FROM trials WHERE participant IN (SELECT participant FROM kept))"""


@query("accept_heatmap", f"""WITH {KEPT}
SELECT moneylevel, painlevel, round(avg(accepted), 6) AS accepted FROM prepared GROUP BY ALL""")
def accept_heatmap(spark, sf):
    cells = ag.mean_by(prepared_trials(spark, sf), ["moneylevel", "painlevel"], "accepted")
    return cells.withColumn("accepted", F.round("accepted", 6))


@query("rt_heatmap", f"""WITH {KEPT}
SELECT moneylevel, painlevel, round(avg(rt), 6) AS rt FROM prepared GROUP BY ALL""")
def rt_heatmap(spark, sf):
    return ag.mean_by(prepared_trials(spark, sf), ["moneylevel", "painlevel"], "rt").withColumn("rt", F.round("rt", 6))


@query("accept_heatmap_wide", f"""WITH {KEPT}
SELECT moneylevel, {', '.join(f"round(avg(CASE WHEN painlevel = {p} THEN accepted END), 6) AS pain_{p}" for p in LEVELS)}
FROM prepared GROUP BY moneylevel""")
def accept_heatmap_wide(spark, sf):
    wide = ag.heatmap(prepared_trials(spark, sf), "moneylevel", "painlevel", "accepted", LEVELS, "pain_")
    return wide.select("moneylevel", *[F.round(f"pain_{p}", 6).alias(f"pain_{p}") for p in LEVELS])


@query("project_alias_intercept", f"""WITH {TRIALS}
SELECT participant, participant AS subj_idx, accepted AS response, moneylevel, painlevel, rt, 1 AS "Intercept"
FROM trials""")
def project_alias_intercept(spark, sf):
    t = shaping.alias_columns(views.trials(spark, sf), {"subj_idx": "participant", "response": "accepted"})
    kept = shaping.keep_existing(["participant", "subj_idx", "response", "moneylevel", "painlevel", "rt", "absent"], t)
    return shaping.add_intercept(shaping.project(t, kept))


@query("coerce_numeric", """WITH t AS (SELECT part.p_partkey, split_part(p_brand, '#', 2) AS a, p_brand AS b,
  CAST(p_retailprice AS VARCHAR) AS c, p_type AS d FROM part)
SELECT p_partkey, try_cast(a AS DOUBLE) AS a, try_cast(b AS DOUBLE) AS b, round(try_cast(c AS DOUBLE), 6) AS c,
       try_cast(d AS DOUBLE) AS d FROM t""")
def coerce_numeric(spark, sf):
    part = views.table(spark, sf, "part").select(
        "p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("a"), F.col("p_brand").alias("b"),
        F.col("p_retailprice").cast("string").alias("c"), F.col("p_type").alias("d"))
    return shaping.coerce_numeric(part, ["a", "b", "c", "d"]).withColumn("c", F.round("c", 6))


@query("parse_level", """SELECT p_partkey, p_size % 5 + 1 AS prefixed, p_size % 5 + 1 AS stripped,
  CAST(NULL AS INT) AS foreign_prefix FROM part""")
def parse_level(spark, sf):
    part = views.table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5 + 1).cast("string").alias("n"))
    return part.select("p_partkey", fc.parse_prefixed_int(F.concat(F.lit("m"), "n"), "m").alias("prefixed"),
                       fc.parse_level_strip(F.concat(F.lit("'m"), "n", F.lit("'"))).alias("stripped"),
                       fc.parse_prefixed_int(F.concat(F.lit("p"), "n"), "m").alias("foreign_prefix"))


@query("sanitize_name", r"""SELECT page_id, replace(replace(replace(regexp_replace(url, '[:(\[)\]]', '_', 'g'),
  'T.M', 'T_M'), 'T.P', 'T_P'), 'T.low', 'T_low') AS name FROM pages""")
def sanitize_name(spark, sf):
    pages = views.table(spark, sf, "pages")
    return pages.select("page_id", fc.sanitize_name(F.col("url")).alias("name"))


@query("trial_label", f"""WITH {NUMBERED}
SELECT participant, trial_no, 'trial_' || CASE WHEN trial_no < 1000 THEN lpad(CAST(trial_no AS VARCHAR), 3, '0')
  ELSE CAST(trial_no AS VARCHAR) END AS trials_name FROM numbered""")
def trial_label(spark, sf):
    t = windows.trial_number(views.trials(spark, sf), ["participant"], views.TRIAL_ORDER, "trial_no")
    return t.select("participant", "trial_no", fc.numbered_label(F.col("trial_no")).alias("trials_name"))


_CODES_SQL = {
    "acceptance_pair": "CASE WHEN moneylevel = painlevel THEN 'I' WHEN moneylevel > painlevel THEN 'M' ELSE 'P' END",
    "OV_value": "CASE WHEN moneylevel + painlevel <= 5 THEN 'low_OV' ELSE 'high_OV' END",
    "Abs_value": "CASE WHEN abs(moneylevel - painlevel) < 2 THEN 'low_abs' WHEN abs(moneylevel - painlevel) > 2 "
                 "THEN 'high_abs' ELSE 'mid_abs' END",
    "OV_Money_Pain": "CASE WHEN moneylevel + painlevel > 5 THEN 'h_OV' ELSE 'low_OV' END || "
                     "CASE WHEN moneylevel > painlevel THEN '_h_money' ELSE '_h_pain' END",
    "Abs_Money_Pain": "CASE WHEN abs(moneylevel - painlevel) = 2 THEN 'mid_abs' ELSE "
                      "CASE WHEN abs(moneylevel - painlevel) < 2 THEN 'low_abs' ELSE 'high_abs' END || "
                      "CASE WHEN moneylevel > painlevel THEN '_h_money' ELSE '_h_pain' END END",
}

CODED = TRIALS + ", coded AS (SELECT *, " + ", ".join(f'{sql} AS "{n}"' for n, sql in _CODES_SQL.items()) + " FROM trials)"


def coded_trials(spark: SparkSession, sf: str) -> DataFrame:
    return shaping.add_conditions(views.trials(spark, sf))


def _condition_query(name: str):
    key = {"acceptance_pair": "acceptance_pair_counts", "OV_value": "overall_value", "Abs_value": "absolute_value",
           "OV_Money_Pain": "ov_money_pain", "Abs_Money_Pain": "abs_money_pain"}[name]

    @query(key, f"""WITH {CODED} SELECT "{name}", count(*) AS n FROM coded GROUP BY ALL""")
    def counts(spark, sf):
        return ag.value_counts(coded_trials(spark, sf), [name])


for _name in CONDITIONS:
    _condition_query(_name)


@query("condition_codes", f"""WITH {CODED}
SELECT participant, moneylevel, painlevel, {', '.join(f'"{n}"' for n in CONDITIONS)}, l_orderkey, l_linenumber,
       l_partkey FROM coded""")
def condition_codes(spark, sf):
    return coded_trials(spark, sf).select("participant", "moneylevel", "painlevel", *CONDITIONS, "l_orderkey",
                                          "l_linenumber", "l_partkey")


@query("exclude_subjects", f"""WITH {KEPT}
SELECT participant, count(*) AS n, CAST(sum(accepted) AS BIGINT) AS accepted FROM prepared GROUP BY participant""")
def exclude_subjects(spark, sf):
    kept = ag.exclude_subjects(views.trials(spark, sf), n_trials=None, share=SHARE)
    return kept.groupBy("participant").agg(F.count(F.lit(1)).alias("n"), F.sum("accepted").alias("accepted"))


@query("exclude_subjects_planned", f"""WITH {TRIALS}
SELECT participant, count(*) AS n FROM trials WHERE participant IN (
  SELECT participant FROM trials GROUP BY participant HAVING sum(accepted) < 600 * {SHARE}::DOUBLE) GROUP BY participant""")
def exclude_subjects_planned(spark, sf):
    kept = ag.exclude_subjects(views.trials(spark, sf), n_trials=600, share=SHARE)
    return ag.value_counts(kept, ["participant"])


@query("keep_list", f"""WITH {TRIALS}
SELECT participant, count(*) AS n FROM trials WHERE participant IN (
  SELECT participant FROM trials GROUP BY participant HAVING round(avg(accepted), 9) <= 0.56) GROUP BY participant""")
def keep_list(spark, sf):
    return ag.value_counts(ag.keep_subjects(views.trials(spark, sf), 0.56), ["participant"])


@query("count_subjects", f"""WITH {TRIALS}
SELECT 'participant' AS "column", count(DISTINCT participant) AS n_unique FROM trials
UNION ALL SELECT 'moneylevel', count(DISTINCT moneylevel) FROM trials
UNION ALL SELECT 'painlevel', count(DISTINCT painlevel) FROM trials""")
def count_subjects(spark, sf):
    return ag.count_distinct(views.trials(spark, sf), ["participant", "moneylevel", "painlevel"])


@query("distinct_ids", f"WITH {TRIALS} SELECT DISTINCT participant FROM trials")
def distinct_ids(spark, sf):
    return shaping.distinct_sorted_ids(views.trials(spark, sf), "participant")


@query("filter_conditions", f"""WITH {CODED}
SELECT participant, moneylevel, painlevel, count(*) AS n FROM coded
WHERE "OV_value" = 'high_OV' AND acceptance_pair IN ('M', 'P') GROUP BY ALL""")
def filter_conditions(spark, sf):
    high = shaping.filter_eq(coded_trials(spark, sf), "OV_value", "high_OV")
    return ag.value_counts(shaping.filter_in(high, "acceptance_pair", ["M", "P"]),
                           ["participant", "moneylevel", "painlevel"])


@query("accept_rates", f"""WITH {TRIALS}
SELECT participant, CAST(sum(accepted) AS BIGINT) AS accept_sum, round(avg(accepted), 6) AS perc_accept
FROM trials GROUP BY participant""")
def accept_rates(spark, sf):
    t = views.trials(spark, sf)
    rates = ag.accept_rate(t, "participant").withColumn("perc_accept", F.round("perc_accept", 6))
    return ag.accept_sum(t, "participant").join(rates, "participant")


@query("filter_notnull", f"""WITH {TRIALS}
SELECT participant, painlevel, count(*) AS n FROM (SELECT *, CASE WHEN accepted = 1 THEN rt END AS accept_rt FROM trials)
WHERE accept_rt IS NOT NULL GROUP BY ALL""")
def filter_notnull(spark, sf):
    t = views.trials(spark, sf).withColumn("accept_rt", F.when(F.col("accepted") == 1, F.col("rt")))
    return ag.value_counts(shaping.filter_notnull(t, "accept_rt"), ["participant", "painlevel"])


@query("order_by_index", f"""WITH {TRIALS}
SELECT participant, l_orderkey, l_linenumber, rt FROM trials ORDER BY participant, l_orderkey, l_linenumber""")
def order_by_index(spark, sf):
    t = views.trials(spark, sf).select("participant", "l_orderkey", "l_linenumber", "rt")
    return shaping.order_by_index(t, ["participant", "l_orderkey", "l_linenumber"])


@query("attach_subject_params", f"""WITH {TRIALS},
params AS (SELECT participant, avg(painlevel) AS mean_pain, max(moneylevel) AS top_money FROM trials WHERE accepted = 1 GROUP BY participant)
SELECT participant, painlevel, count(*) AS n, round(any_value(mean_pain), 6) AS mean_pain, any_value(top_money) AS top_money
FROM trials LEFT JOIN params USING (participant) GROUP BY participant, painlevel""")
def attach_subject_params(spark, sf):
    t = views.trials(spark, sf)
    params = t.filter("accepted = 1").groupBy("participant").agg(F.avg("painlevel").alias("mean_pain"), F.max("moneylevel").alias("top_money"))
    joined = joins.attach_subject_params(t, params, "participant")
    return joined.groupBy("participant", "painlevel").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.first("mean_pain"), 6).alias("mean_pain"), F.first("top_money").alias("top_money"))


@query("flip_rt", f"""WITH {TRIALS}
SELECT participant, accepted, count(*) AS n, round(avg(CASE WHEN accepted = 0 THEN -rt ELSE rt END), 6) AS mean_rt,
  round(min(CASE WHEN accepted = 0 THEN -rt ELSE rt END), 9) AS min_rt FROM trials GROUP BY ALL""")
def flip_rt(spark, sf):
    t = views.trials(spark, sf).withColumn("rt", fc.flip_rt(F.col("rt"), F.col("accepted")))
    return t.groupBy("participant", "accepted").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rt"), 6).alias("mean_rt"),
                                                    F.round(F.min("rt"), 9).alias("min_rt"))


FLIPPED = TRIALS + ", flipped AS (SELECT participant, CASE WHEN accepted = 0 THEN -rt ELSE rt END AS rt FROM trials)"


@query("rt_histogram", f"""WITH {FLIPPED},
ends AS (SELECT participant, min(rt) AS lo, max(rt) AS hi FROM flipped GROUP BY participant)
SELECT participant, CAST(least(floor((rt - lo) / (hi - lo) * 20), 19) AS INT) AS bin, count(*) AS n
FROM flipped JOIN ends USING (participant) GROUP BY ALL""")
def rt_histogram(spark, sf):
    t = views.trials(spark, sf).withColumn("rt", fc.flip_rt(F.col("rt"), F.col("accepted")))
    return ag.histogram_by(t, "participant", "rt", 20)


@query("describe_rt", f"""WITH {TRIALS}
SELECT participant, count(rt) AS count, round(avg(rt), 6) AS mean, round(stddev_samp(rt), 6) AS std,
  round(min(rt), 9) AS min, round(quantile_cont(rt, 0.25), 9) AS q25, round(quantile_cont(rt, 0.5), 9) AS q50,
  round(quantile_cont(rt, 0.75), 9) AS q75, round(max(rt), 9) AS max FROM trials GROUP BY participant""")
def describe_rt(spark, sf):
    out = ag.describe(views.trials(spark, sf), "rt", ["participant"])
    return out.select("participant", "count", *[F.round(c, DIGITS.get(c, 9)).alias(c) for c in out.columns[2:]])


@query("describe_rt_overall", f"""WITH {TRIALS}
SELECT count(rt) AS count, round(avg(rt), 6) AS mean, round(stddev_samp(rt), 6) AS std,
  round(min(rt), 9) AS min, round(quantile_cont(rt, 0.25), 9) AS q25, round(quantile_cont(rt, 0.5), 9) AS q50,
  round(quantile_cont(rt, 0.75), 9) AS q75, round(max(rt), 9) AS max FROM trials""")
def describe_rt_overall(spark, sf):
    out = ag.describe(views.trials(spark, sf), "rt")
    return out.select("count", *[F.round(c, DIGITS.get(c, 9)).alias(c) for c in out.columns[1:]])


_KEY = ["participant", *views.TRIAL_ORDER]
_KEY_SQL = ", ".join(_KEY)


@query("block_trial_index", f"""WITH {NUMBERED}
SELECT {_KEY_SQL}, CAST((trial_no - 1) // 25 AS INT) AS blocks_idx, CAST((trial_no - 1) % 25 AS INT) AS trialblocks
FROM numbered""")
def block_trial_index(spark, sf):
    t = views.trials(spark, sf).select(_KEY)
    return windows.block_trial_index(t, ["participant"], views.TRIAL_ORDER, 25)


@query("zscore_rt", f"""WITH {TRIALS}
SELECT l_orderkey, l_linenumber, l_partkey, participant,
  round((rt - avg(rt) OVER w) / nullif(stddev_pop(rt) OVER w, 0), 6) AS rt_z,
  round((moneylevel - avg(moneylevel) OVER w) / nullif(stddev_pop(moneylevel) OVER w, 0), 6) AS moneylevel_z
FROM trials WINDOW w AS (PARTITION BY participant)""")
def zscore_rt(spark, sf):
    z = windows.zscore(views.trials(spark, sf), ["rt", "moneylevel"], ["participant"])
    return z.select("l_orderkey", "l_linenumber", "l_partkey", "participant", F.round("rt_z", 6).alias("rt_z"),
                    F.round("moneylevel_z", 6).alias("moneylevel_z"))


@query("standardize_within", f"""WITH {TRIALS}, s AS (
SELECT participant, painlevel, (rt - avg(rt) OVER w) / nullif(stddev_pop(rt) OVER w, 0) AS rt
FROM trials WINDOW w AS (PARTITION BY participant))
SELECT painlevel, round(avg(rt), 6) AS rt, count(*) AS n FROM s GROUP BY painlevel""")
def standardize_within(spark, sf):
    t = views.trials(spark, sf).select("participant", "painlevel", "rt")
    s = windows.standardize_within(t, ["rt"], "participant")
    return s.groupBy("painlevel").agg(F.round(F.avg("rt"), 6).alias("rt"), F.count(F.lit(1)).alias("n"))


@query("qcut_bins", f"""WITH {TRIALS},
e AS (SELECT quantile_cont(rt, [0.2, 0.4, 0.6, 0.8]) AS q FROM trials),
b AS (SELECT moneylevel, rt, len(list_filter(q, lambda x: x < rt)) AS bin FROM trials, e)
SELECT moneylevel, CAST(bin AS INT) AS bin, count(*) AS n, round(min(rt), 9) AS lo, round(max(rt), 9) AS hi
FROM b GROUP BY ALL""")
def qcut_bins(spark, sf):
    b = windows.quantile_bins(views.trials(spark, sf), "rt", 5)
    return b.groupBy("moneylevel", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("rt"), 9).alias("lo"),
                                              F.round(F.max("rt"), 9).alias("hi"))


@query("qcut_edges", f"""WITH {TRIALS},
e AS (SELECT quantile_cont(rt, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM trials),
b AS (SELECT greatest(len(list_filter(q, lambda x: x < rt)) - 1, 0) AS bin, q FROM trials, e)
SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(q[bin + 1], 9) AS lower, round(q[bin + 2], 9) AS upper
FROM b GROUP BY bin, q""")
def qcut_edges(spark, sf):
    t = windows.bin_table(views.trials(spark, sf), "rt", 5)
    return t.select("bin", "n", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


@query("qcut_within", f"""WITH {TRIALS},
e AS (SELECT participant, quantile_cont(rt, [0.25, 0.5, 0.75]) AS q FROM trials GROUP BY participant),
b AS (SELECT participant, len(list_filter(q, lambda x: x < rt)) AS bin FROM trials JOIN e USING (participant))
SELECT participant, CAST(bin AS INT) AS bin, count(*) AS n FROM b GROUP BY ALL""")
def qcut_within(spark, sf):
    b = windows.quantile_bins(views.trials(spark, sf), "rt", 4, ["participant"])
    return ag.value_counts(b, ["participant", "bin"])


@query("left_join_scores", f"""WITH {TRIALS}, {SUBJECTS}
SELECT nation, painlevel, count(*) AS n, round(avg(rt * score), 4) AS rt_score, round(avg(score), 6) AS score
FROM trials LEFT JOIN subjects USING (participant) GROUP BY ALL""")
def left_join_scores(spark, sf):
    joined = joins.left_join(views.trials(spark, sf), views.subjects(spark, sf), ["participant"])
    joined = shaping.interaction_terms(joined, "rt", {"rt_score": "score"})
    return joined.groupBy("nation", "painlevel").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("rt_score"), 4).alias("rt_score"),
        F.round(F.avg("score"), 6).alias("score"))


@query("zip_columns", f"""WITH {SUBJECTS},
a AS (SELECT participant, score, row_number() OVER (ORDER BY participant) AS r FROM subjects),
b AS (SELECT c_custkey, c_acctbal AS score_2, row_number() OVER (ORDER BY c_custkey) AS r FROM customer)
SELECT participant, score, c_custkey, score_2 FROM a FULL JOIN b USING (r)""")
def zip_columns(spark, sf):
    a = views.subjects(spark, sf).select("participant", "score")
    b = views.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("score"))
    return joins.zip_columns(a, b, ["participant"], ["c_custkey"])


@query("zip_columns_within", f"""WITH {NUMBERED}, late AS (
  SELECT participant, rt, row_number() OVER (PARTITION BY participant
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS r FROM trials WHERE painlevel >= 3)
SELECT {', '.join(f'n.{c}' for c in _KEY)}, round(n.rt - l.rt, 9) AS gap FROM numbered n
LEFT JOIN late l ON n.participant = l.participant AND n.trial_no = l.r""")
def zip_columns_within(spark, sf):
    t = views.trials(spark, sf)
    order = views.TRIAL_ORDER
    right = t.filter(F.col("painlevel") >= 3).select("participant", "rt", *order)
    both = joins.zip_columns(t.select(*_KEY, "rt"), right, order, order, ["participant"])
    return both.select(*_KEY, F.round(F.col("rt") - F.col("rt_2"), 9).alias("gap"))


_MATCH = NUMBERED + """, behaviour AS (
  SELECT participant, trial_no, (trial_no - 1) // 25 AS b, (trial_no - 1) % 25 AS i FROM numbered
  WHERE accepted = 1)"""


@query("match_trials", f"""WITH {_MATCH}
SELECT participant, count(*) AS n, CAST(sum(trial_no) AS BIGINT) AS trials FROM numbered WHERE EXISTS (
  SELECT 1 FROM behaviour x WHERE x.participant = numbered.participant AND x.b = (numbered.trial_no - 1) // 25
  AND x.i = (numbered.trial_no - 1) % 25) GROUP BY participant""")
def match_trials(spark, sf):
    t = views.trials(spark, sf).select(*_KEY, "accepted")
    placed = stage(windows.block_trial_index(t, ["participant"], views.TRIAL_ORDER, 25), "placed")
    keys = ["participant", "blocks_idx", "trialblocks"]
    epochs = placed.select(*keys, (F.col("blocks_idx") * 25 + F.col("trialblocks") + 1).alias("trial_no"))
    kept = joins.match_trials(epochs, placed.filter("accepted = 1"), {k: k for k in keys})
    return kept.groupBy("participant").agg(F.count(F.lit(1)).alias("n"), F.sum("trial_no").alias("trials"))


@query("match_by_trial_number", f"""WITH {_MATCH}
SELECT participant, count(*) AS n FROM numbered WHERE (participant, trial_no) IN (
  SELECT participant, trial_no FROM behaviour) GROUP BY participant""")
def match_by_trial_number(spark, sf):
    t = stage(views.numbered_trials(spark, sf).select("participant", "trial_no", "accepted"), "numbered")
    kept = joins.match_trials(t, t.filter("accepted = 1"), {"participant": "participant", "trial_no": "trial_no"})
    return ag.value_counts(kept, ["participant"])


@query("union_rows", f"""WITH {TRIALS}
SELECT moneylevel, painlevel, count(*) AS n, count(response) AS n_response FROM (
  SELECT moneylevel, painlevel, accepted AS response FROM trials WHERE accepted = 1
  UNION ALL SELECT moneylevel, painlevel, NULL FROM trials WHERE accepted = 0) GROUP BY ALL""")
def union_rows(spark, sf):
    t = views.trials(spark, sf)
    yes = t.filter("accepted = 1").select("moneylevel", "painlevel", F.col("accepted").alias("response"))
    both = shaping.union_rows(yes, t.filter("accepted = 0").select("moneylevel", "painlevel"))
    return both.groupBy("moneylevel", "painlevel").agg(F.count(F.lit(1)).alias("n"), F.count("response").alias("n_response"))


@query("rejection_stats", f"""WITH {TRIALS},
s AS (SELECT participant, count(*) FILTER (WHERE rt <= 1.0) AS kept FROM trials GROUP BY participant)
SELECT participant, kept, round((700 - kept) / 700 * 100, 6) AS perc_removed FROM s""")
def rejection_stats(spark, sf):
    t = views.trials(spark, sf).withColumn("badtrial", (F.col("rt") > 1.0).cast("int"))
    return ag.rejection_stats(t, n_trials=700).withColumn("perc_removed", F.round("perc_removed", 6))


@query("drop_bad_trials", f"""WITH {TRIALS}
SELECT participant, count(*) AS n, round(avg(rt), 6) AS rt FROM trials WHERE rt <= 1.0 AND accepted IS NOT NULL
GROUP BY participant""")
def drop_bad_trials(spark, sf):
    t = views.trials(spark, sf).withColumn("badtrial", (F.col("rt") > 1.0).cast("int"))
    good = shaping.regressor_present(shaping.drop_bad_trials(t), "accepted")
    return good.groupBy("participant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rt"), 6).alias("rt"))


@query("head_tail", f"""WITH {TRIALS},
o AS (SELECT participant, l_orderkey, l_linenumber, l_partkey, round(rt, 9) AS rt FROM trials)
(SELECT * FROM o ORDER BY l_orderkey, l_linenumber, l_partkey, participant, rt LIMIT 5) UNION ALL
(SELECT * FROM o ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, participant DESC, rt DESC LIMIT 5)""")
def head_tail(spark, sf):
    t = views.trials(spark, sf).select("participant", "l_orderkey", "l_linenumber", "l_partkey", F.round("rt", 9).alias("rt"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "participant", "rt"]
    return shaping.union_rows(shaping.head(t, 5, order), shaping.tail(t, 5, order))


@query("cooldown_gap", f"""WITH {TRIALS},
g AS (SELECT {_KEY_SQL}, rt - coalesce(lag(l_extendedprice / 1000) OVER w, 0) AS cooldown FROM trials
  WINDOW w AS (PARTITION BY participant ORDER BY {', '.join(views.TRIAL_ORDER)})
  UNION ALL SELECT participant, NULL, NULL, NULL, NULL,
    0 - max_by(l_extendedprice / 1000, [l_orderkey, l_linenumber, l_partkey, l_extendedprice]) FROM trials GROUP BY participant)
SELECT {_KEY_SQL}, round(cooldown, 9) AS cooldown FROM g""")
def cooldown_gap(spark, sf):
    t = views.trials(spark, sf).withColumn("coold", F.col("l_extendedprice") / 1000)
    gaps = windows.cooldown_gap(t, ["participant"], views.TRIAL_ORDER, "rt", "coold")
    return gaps.withColumn("cooldown", F.round("cooldown", 9))


@query("sem_by_level", f"""WITH {TRIALS}
SELECT moneylevel, painlevel, round(avg(rt), 6) AS mean, round(stddev_samp(rt) / sqrt(count(rt)), 6) AS sem,
  count(rt) AS n FROM trials GROUP BY ALL""")
def sem_by_level(spark, sf):
    s = ag.sem_by(views.trials(spark, sf), ["moneylevel", "painlevel"], "rt")
    return s.withColumns({"mean": F.round("mean", 6), "sem": F.round("sem", 6)})
