"""Queries over questionnaires, ratings and per-subject summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicelab.functions import columns as fc
from choicelab.functions.conditions import ARTEFACT_LABELS, flag_component
from choicelab.operators import aggregates as ag
from choicelab.operators import shaping
from choicelab.plans import views
from choicelab.plans.registry import query
from choicelab.plans.views import ITEMS, RATINGS, TRIALS


def _items(spark, sf):
    return views.items(spark, sf)


@query("reverse_scores", f"""WITH {ITEMS}
SELECT participant, 5 - scale_y1_a AS scale_y1_a, scale_y1_b, 5 - scale_y2_a AS scale_y2_a, scale_y2_b FROM items""")
def reverse_scores(spark, sf):
    reverse = shaping.keep_existing(["scale_y1_a", "scale_y2_a", "scale_y9_a"], _items(spark, sf))
    out = shaping.reverse_scores(_items(spark, sf), reverse)
    return shaping.project(out, ["participant", "scale_y1_a", "scale_y1_b", "scale_y2_a", "scale_y2_b"])


@query("scale_sums", f"""WITH {ITEMS}
SELECT participant, 5 - scale_y1_a + scale_y1_b AS y1_score, scale_y2_a + scale_y2_b AS y2_score FROM items""")
def scale_sums(spark, sf):
    scored = shaping.reverse_scores(_items(spark, sf), ["scale_y1_a"])
    first, second = (shaping.columns_containing(scored, part) for part in ("y1", "y2"))
    complete = shaping.drop_incomplete(scored, first + second)
    sums = shaping.row_sum(shaping.row_sum(complete, first, "y1_score"), second, "y2_score")
    return shaping.project(sums, ["participant", "y1_score", "y2_score"])


@query("rename_drop", """SELECT p_partkey AS id, p_brand AS brand, p_type AS kind, p_size, p_retailprice FROM part""")
def rename_drop(spark, sf):
    part = views.table(spark, sf, "part")
    # lookup table derived from the nation list: only its first three entries name columns of the table
    names = views.table(spark, sf, "nation").select(
        F.element_at(F.array(*map(F.lit, ["p_partkey", "p_brand", "p_type"])), F.col("n_nationkey") % 3 + 1).alias("old"),
        F.element_at(F.array(*map(F.lit, [" id ", "brand", " kind"])), F.col("n_nationkey") % 3 + 1).alias("new")).distinct()
    return shaping.drop_columns_containing(shaping.rename_by_lookup(part, names), "_name")


@query("interaction_terms", f"""WITH {ITEMS}
SELECT participant, round(price * scale_y1_a, 4) AS price_a, round(price * scale_y2_a, 4) AS price_b FROM items""")
def interaction_terms(spark, sf):
    out = shaping.interaction_terms(_items(spark, sf), "price", {"price_a": "scale_y1_a", "price_b": "scale_y2_a"})
    return out.select("participant", F.round("price_a", 4).alias("price_a"), F.round("price_b", 4).alias("price_b"))


@query("label_encode", f"""WITH {ITEMS},
t AS (SELECT type, CAST(row_number() OVER (ORDER BY type) - 1 AS INT) AS c FROM (SELECT DISTINCT type FROM items)),
b AS (SELECT brand, CAST(row_number() OVER (ORDER BY brand) - 1 AS INT) AS c FROM (SELECT DISTINCT brand FROM items))
SELECT participant, t.c AS type, b.c AS brand FROM items JOIN t USING (type) JOIN b USING (brand)""")
def label_encode(spark, sf):
    return ag.label_encode(_items(spark, sf).select("participant", "type", "brand"), ["type", "brand"])


_CORR = ["price", "size", "scale_y1_a", "scale_y1_b", "scale_y2_a", "scale_y2_b", "type"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i:]]


@query("correlation_matrix", f"""WITH {ITEMS},
t AS (SELECT type AS k, row_number() OVER (ORDER BY type) - 1 AS c FROM (SELECT DISTINCT type FROM items)),
n AS (SELECT items.* REPLACE (t.c AS type) FROM items JOIN t ON items.type = t.k)
{' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM n" for a, b in _PAIRS)}""")
def correlation_matrix(spark, sf):
    coded = ag.label_encode(_items(spark, sf), ["type"])
    return ag.correlation_matrix(coded, _CORR).withColumn("r", F.round("r", 6))


@query("pearson_by", f"""WITH {RATINGS}
SELECT source, count(*) AS n, round(CASE WHEN stddev_pop(n_chars) > 0 AND stddev_pop(quality) > 0
  THEN corr(n_chars, quality) END, 6) AS r FROM ratings GROUP BY source""")
def pearson_by(spark, sf):
    return ag.pearson(views.ratings(spark, sf), "n_chars", "quality", ["source"]).withColumn("r", F.round("r", 6))


@query("rating_accuracy", f"""WITH {RATINGS}
SELECT lang, round(avg(CASE WHEN (n_chars % 2) * 20 = quality * 20 THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n
FROM ratings GROUP BY lang""")
def rating_accuracy(spark, sf):
    r = views.ratings(spark, sf).select("lang", (F.col("n_chars") % 2).alias("rating"), (F.col("quality") * 20).alias("level"))
    return ag.rating_accuracy(r, "rating", "level", 20, ["lang"]).withColumn("accuracy", F.round("accuracy", 6))


@query("value_counts", f"WITH {RATINGS} SELECT lang, source, count(*) AS n FROM ratings GROUP BY ALL")
def value_counts(spark, sf):
    return ag.value_counts(views.ratings(spark, sf), ["lang", "source"])


_ARTEFACTS_SQL = ", ".join(f"'{a}'" for a in ARTEFACT_LABELS)
_CLASSES = ["brain", *ARTEFACT_LABELS]


@query("flag_components", f"""WITH c AS (
  SELECT p_size AS recording, ([{', '.join(f"'{c}'" for c in _CLASSES)}])[p_partkey % 8 + 1] AS label,
         p_retailprice / 2500 AS prob FROM part)
SELECT recording, CAST(sum(CASE WHEN label IN ({_ARTEFACTS_SQL}) AND prob > 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS n_removed
FROM c GROUP BY recording""")
def flag_components(spark, sf):
    classes = F.array(*map(F.lit, _CLASSES))
    c = views.table(spark, sf, "part").select(
        F.col("p_size").alias("recording"), F.element_at(classes, (F.col("p_partkey") % 8 + 1).cast("int")).alias("label"),
        (F.col("p_retailprice") / 2500).alias("prob"))
    return c.groupBy("recording").agg(F.sum(flag_component(F.col("label"), F.col("prob")).cast("int")).alias("n_removed"))


@query("qc_summary", f"""WITH {TRIALS},
a AS (SELECT participant, avg(accepted) AS perc_accept FROM trials GROUP BY participant),
r AS (SELECT participant, CASE WHEN stddev_pop(painlevel) > 0 AND stddev_pop(rt) > 0 THEN corr(painlevel, rt) END AS r
      FROM trials GROUP BY participant),
f AS (SELECT participant, moneylevel AS l1, painlevel AS l2 FROM trials QUALIFY row_number() OVER (
      PARTITION BY participant ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) = 1),
c AS (SELECT participant, avg(CASE WHEN moneylevel * 20 = painlevel * 20 THEN 1 ELSE 0 END) AS accuracy
      FROM trials GROUP BY participant),
k AS (SELECT participant, (700 - count(*) FILTER (WHERE rt <= 1.0)) / 700 * 100 AS removed FROM trials GROUP BY participant)
SELECT participant, round(perc_accept, 6) AS perc_accept, round(r, 6) AS corr_pain, l1, l2,
  round(accuracy, 6) AS accuracy, round(removed, 6) AS perc_removed
FROM a JOIN r USING (participant) JOIN f USING (participant) JOIN c USING (participant) JOIN k USING (participant)""")
def qc_summary(spark, sf):
    t = views.trials(spark, sf)
    rates = ag.accept_rate(t, "participant")
    corr = ag.pearson(t, "painlevel", "rt", ["participant"]).select("participant", F.col("r").alias("corr_pain"))
    first = ag.first_value_by(t, ["participant"], views.TRIAL_ORDER, ["moneylevel", "painlevel"]).select(
        "participant", F.col("moneylevel").alias("l1"), F.col("painlevel").alias("l2"))
    catch = ag.rating_accuracy(t.withColumn("level", F.col("painlevel") * 20), "moneylevel", "level", 20,
                               ["participant"]).drop("n")
    kept = ag.rejection_stats(t.withColumn("badtrial", (F.col("rt") > 1.0).cast("int")), n_trials=700).drop("kept")
    out = ag.qc_summary(t, [rates, corr, first, catch, kept])
    return out.select("participant", "l1", "l2", *[F.round(c, 6).alias(c) for c in (
        "perc_accept", "corr_pain", "accuracy", "perc_removed")])


@query("rank_models", """WITH m AS (SELECT p_brand AS model, -2 * sum(ln(p_retailprice / 3000)) AS dic FROM part GROUP BY p_brand)
SELECT model, round(dic, 4) AS dic, CAST(row_number() OVER (ORDER BY dic) - 1 AS INT) AS rank FROM m""")
def rank_models(spark, sf):
    part = views.table(spark, sf, "part")
    m = part.groupBy(F.col("p_brand").alias("model")).agg((-2 * F.sum(F.ln(F.col("p_retailprice") / 3000))).alias("dic"))
    return ag.rank_models(m, "dic").withColumn("dic", F.round("dic", 4))


@query("rows_named", """SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#3') GROUP BY p_brand""")
def rows_named(spark, sf):
    counts = ag.value_counts(views.table(spark, sf, "part"), ["p_brand"])
    return shaping.rows_named(counts, "p_brand", ["Brand#1", "Brand#3", "Brand#none"])


@query("logistic_columns", """SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 5000)), 9) AS share,
  round(c_acctbal / 5000, 6) AS back, round(c_acctbal * 1000, 2) AS scaled FROM customer""")
def logistic_columns(spark, sf):
    c = views.table(spark, sf, "customer")
    share = fc.inv_logit(F.col("c_acctbal") / 5000)
    return c.select("c_custkey", F.round(share, 9).alias("share"), F.round(fc.logit(share), 6).alias("back"),
                    F.round(fc.unit_scale(F.col("c_acctbal"), 1e3), 2).alias("scaled"))
