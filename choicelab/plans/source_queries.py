"""Queries that write tables to the shared folder and scan them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelab.plans import views
from choicelab.plans.registry import query
from choicelab.plans.signal_queries import _BETAS, betas
from choicelab.plans.views import DRAWS, MARKS, TRIALS
from choicelab.sources import readers, writers
from choicelab.staging import scratch_path

_COLS = ["moneystim", "painlevel", "accepted", "choice_resp.rt", "P1"]


@query("subject_tables", f"""WITH {TRIALS}
SELECT CAST(participant AS VARCHAR) AS participant, count(*) AS n, count(CASE WHEN participant % 2 = 0 THEN 1 END) AS n_p1,
  CAST(sum(accepted) AS BIGINT) AS accepted, round(avg(rt), 6) AS rt, CAST(sum(moneylevel) AS BIGINT) AS money
FROM trials GROUP BY participant""")
def subject_tables(spark, sf):
    """One text table per subject. Half of the subjects have other columns in another order."""
    t = views.trials(spark, sf).select(
        "participant", F.concat(F.lit("m"), "moneylevel").alias("moneystim"), "painlevel", "accepted",
        F.col("rt").alias("choice_resp.rt"), F.lit("x").alias("comment"), (F.col("painlevel") * 10).alias("P1"))
    path = scratch_path(spark, "subjects")
    writers.write_table(t.filter("participant % 2 = 0").drop("comment"), path, "csv", "\t", ["participant"])
    other = t.filter("participant % 2 = 1").select(
        "comment", "accepted", "`choice_resp.rt`", "moneystim", "painlevel", "participant")
    writers.write_table(other, path, "csv", "\t", ["participant"], mode="append")
    raw = readers.read_subject_tables(spark, f"{path}/participant=*/*.csv", _COLS, "\t", r"participant=(\d+)/")
    return raw.groupBy("participant").agg(
        F.count(F.lit(1)).alias("n"), F.count("P1").alias("n_p1"), F.sum(F.col("accepted").cast("long")).alias("accepted"),
        F.round(F.avg(F.col("`choice_resp.rt`").cast("double")), 6).alias("rt"),
        F.sum(F.substring("moneystim", 2, 9).cast("long")).alias("money"))


@query("delimited_roundtrip", """SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def delimited_roundtrip(spark, sf):
    path = scratch_path(spark, "semicolon")
    supplier = views.table(spark, sf, "supplier")
    writers.write_table(supplier, path, "csv", ";")
    return readers.read_delimited(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", ";")


@query("kv_text", f"""WITH {DRAWS}
SELECT 'r' || param AS model, round(avg(value) * 1000, 6) AS value FROM draws GROUP BY param""")
def kv_text(spark, sf):
    """A fit statistic per model written as ``DIC: value`` files and scanned back."""
    stats = views.draws(spark, sf).groupBy("param").agg(F.avg("value").alias("m"))
    lines = stats.select(F.concat(F.lit("r"), "param").alias("model"), F.lit("DIC").alias("key"),
                         F.round(F.col("m") * 1000, 6).alias("value"))
    path = scratch_path(spark, "fits")
    writers.write_kv_text(lines, path, "key", "value", ["model"])
    return readers.scan_kv_text(spark, f"{path}/model=*/*.txt", "DIC", r"model=(r\d+)/")


@query("kv_lines", f"""WITH {DRAWS}
SELECT 'v_param(' || param || ')' AS name, round(avg(value), 9) AS value FROM draws GROUP BY param""")
def kv_lines(spark, sf):
    stats = views.draws(spark, sf).groupBy("param").agg(F.round(F.avg("value"), 9).alias("value"))
    named = stats.select(F.format_string("v_param(%d)", "param").alias("name"), "value")
    path = scratch_path(spark, "lines")
    writers.write_kv_text(named, path, "name", "value")
    return readers.read_kv_lines(spark, path)


@query("event_lists", f"""WITH {MARKS}
SELECT CAST(recording AS VARCHAR) AS participant, label AS trial_type, count(*) AS n, CAST(sum(sample % 1000) AS BIGINT) AS samples
FROM marks GROUP BY ALL""")
def event_lists(spark, sf):
    m = views.marks(spark, sf).select("recording", "sample", F.col("label").alias("trial_type"))
    path = scratch_path(spark, "events")
    writers.write_table(m, path, "csv", "\t", ["recording"])
    lists = readers.events_for_subject(spark, f"{path}/recording=*/*.csv", r"recording=(\d+)/", "sample bigint, trial_type string")
    return lists.groupBy("participant", "trial_type").agg(F.count(F.lit(1)).alias("n"),
                                                          F.sum(F.col("sample") % 1000).alias("samples"))


@query("draws_roundtrip", f"WITH {DRAWS} SELECT param, chain, count(*) AS n, round(sum(value), 8) AS total FROM draws GROUP BY ALL")
def draws_roundtrip(spark, sf):
    d = views.draws(spark, sf)
    first, second = scratch_path(spark, "draws"), scratch_path(spark, "draws")
    writers.write_table(d.filter("chain % 2 = 0"), first)
    writers.write_table(d.filter("chain % 2 = 1"), second)
    both = readers.read_draws(spark, [first, second])
    return both.groupBy("param", "chain").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 8).alias("total"))


@query("stat_maps", f"WITH {_BETAS} SELECT regressor, channel, t_idx, count(*) AS n, round(avg(beta), 6) AS beta FROM betas GROUP BY ALL")
def stat_maps(spark, sf):
    path = scratch_path(spark, "maps")
    writers.write_stat_maps(betas(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("regressor", "channel", "t_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("beta"), 6).alias("beta"))
