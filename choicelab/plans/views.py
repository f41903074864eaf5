"""The given tables seen as trials, marks, epochs, draws, scores and ratings.

Each view exists as a DataFrame and as the SQL text that the checks run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from choicelab.operators.ranking import row_index

CHANNELS = 4
SAMPLES = 16
LEVELS = [1, 2, 3, 4, 5]
TRIAL_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _whole(x: Column) -> Column:
    """``F.round`` of a double without its way through a decimal text: halves go away from zero."""
    near = F.rint(x)
    return F.when(F.abs(x - near) == 0.5, x + 0.5 * F.signum(x)).otherwise(near)


def trials(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    levels = li.select(
        F.col("l_suppkey").alias("participant"),
        (F.col("l_quantity").cast("int") % 5 + 1).alias("moneylevel"),
        (F.col("l_linenumber") % 5 + 1).alias("painlevel"),
        _whole(F.col("l_discount") * 100).cast("int").alias("_bonus"), *TRIAL_ORDER)
    return levels.select(
        "participant", "moneylevel", "painlevel",
        (2 * F.col("moneylevel") + F.col("_bonus") >= 2 * F.col("painlevel") + 5).cast("int").alias("accepted"),
        (0.3 + F.col("l_extendedprice") / 100000 + 0.05 * F.col("painlevel")).alias("rt"), *TRIAL_ORDER)


TRIALS = """lv AS (
  SELECT l_suppkey AS participant, CAST(l_quantity AS INT) % 5 + 1 AS moneylevel, l_linenumber % 5 + 1 AS painlevel,
         CAST(round(l_discount * 100) AS INT) AS bonus, l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lineitem),
trials AS (
  SELECT participant, moneylevel, painlevel,
         CASE WHEN 2 * moneylevel + bonus >= 2 * painlevel + 5 THEN 1 ELSE 0 END AS accepted,
         0.3::DOUBLE + l_extendedprice / 100000 + 0.05::DOUBLE * painlevel AS rt,
         l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lv)"""

NUMBERED = TRIALS + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY participant
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS trial_no
  FROM trials)"""


def numbered_trials(spark: SparkSession, sf: str) -> DataFrame:
    return row_index(trials(spark, sf), ["participant"], TRIAL_ORDER, "trial_no")


def marks(spark: SparkSession, sf: str) -> DataFrame:
    """Event marks; ``sample`` is the time in microseconds."""
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.col("user_id").alias("recording"), F.col("event_type").alias("label"),
                     F.unix_micros(F.col("ts").cast("timestamp")).alias("sample"), "value")


MARKS = """marks AS (
  SELECT event_id, user_id AS recording, event_type AS label, epoch_us(ts) AS sample, value FROM events)"""


def _channels() -> Column:
    """64 numbers per vector = 4 channels of 16 samples."""
    parts = [F.struct(F.lit(c).alias("channel"),
                      F.slice("embedding", c * SAMPLES + 1, SAMPLES).cast("array<double>").alias("x"))
             for c in range(CHANNELS)]
    return F.inline(F.array(*parts))


def epoch_arrays(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    return emb.select(F.col("label").alias("participant"), F.col("vec_id").alias("epoch"), _channels())


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    return epoch_arrays(spark, sf).select("participant", "epoch", "channel", F.posexplode("x").alias("t_idx", "value"))


EPOCHS = """cells AS (
  SELECT label, vec_id, unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos FROM embeddings),
epochs AS (
  SELECT label AS participant, vec_id AS epoch, pos // 16 AS channel, pos % 16 AS t_idx, CAST(x AS DOUBLE) AS value
  FROM cells)"""


def epoch_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Trial table of the epochs: regressors come from the order with the epoch's number.

    ``late`` is missing on finished orders, so that regressors with gaps occur.
    """
    ids = table(spark, sf, "embeddings").select(F.col("label").alias("participant"), F.col("vec_id").alias("epoch"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey").cast("double")).alias("late"),
        F.col("o_orderstatus").alias("condition"))
    return ids.join(orders, "epoch")


EPOCH_TRIALS = """epoch_trials AS (
  SELECT label AS participant, vec_id AS epoch, o_totalprice AS price,
         CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS DOUBLE) END AS late, o_orderstatus AS condition
  FROM embeddings JOIN orders ON o_orderkey = vec_id)"""


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous recording: a participant's epochs laid end to end."""
    emb = table(spark, sf, "embeddings").select(F.col("label").alias("recording"), "vec_id", "embedding")
    placed = row_index(emb, ["recording"], ["vec_id"], "_n").select("recording", "_n", _channels())
    long = placed.select("recording", "channel", "_n", F.posexplode("x").alias("_pos", "value"))
    return long.select("recording", "channel", ((F.col("_n") - 1) * SAMPLES + F.col("_pos")).alias("t"), "value")


SIGNAL = EPOCHS + """,
placed AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings),
signal AS (
  SELECT participant AS recording, channel, n * 16 + t_idx AS t, value FROM epochs JOIN placed ON epoch = vec_id)"""


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """A vector is a chain of 64 draws of the parameter named by its label."""
    emb = table(spark, sf, "embeddings").select(F.col("label").alias("param"), "vec_id", "embedding")
    chains = row_index(emb, ["param"], ["vec_id"], "_n")
    return chains.select("param", (F.col("_n") - 1).alias("chain"),
                         F.posexplode(F.col("embedding").cast("array<double>")).alias("draw", "value"))


DRAWS = """chains AS (
  SELECT label AS param, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chain, embedding FROM embeddings),
draws AS (
  SELECT param, chain, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS draw,
         CAST(unnest(embedding) AS DOUBLE) AS value
  FROM chains)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Questionnaire items 1..4 and factors of a respondent."""
    part = table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("participant"), (F.col("p_size") % 4 + 1).cast("long").alias("scale_y1_a"),
        (F.col("p_partkey") % 4 + 1).alias("scale_y1_b"), (F.length("p_name") % 4 + 1).cast("long").alias("scale_y2_a"),
        (F.col("p_size") * 7 % 4 + 1).cast("long").alias("scale_y2_b"), F.col("p_type").alias("type"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))


ITEMS = """items AS (
  SELECT p_partkey AS participant, CAST(p_size % 4 + 1 AS BIGINT) AS scale_y1_a, p_partkey % 4 + 1 AS scale_y1_b,
         CAST(length(p_name) % 4 + 1 AS BIGINT) AS scale_y2_a, CAST(p_size * 7 % 4 + 1 AS BIGINT) AS scale_y2_b,
         p_type AS type, p_brand AS brand, p_retailprice AS price, p_size AS size
  FROM part)"""


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings of documents: level 0/1 from the labels, size and factors from the text."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


RATINGS = """ratings AS (
  SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"""


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("participant"), F.col("s_acctbal").alias("score"), F.col("s_nationkey").alias("nation"))


# Questionnaire scores of a subject, whatever their unit.
_SCORES = {"STA_SAI_Score": "score / 1000", "STA_TAI_Score": "nation / 10", "PCS_Score": "participant * 7 % 53 / 10"}


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return subjects(spark, sf).select("participant", *[F.expr(sql).cast("double").alias(name) for name, sql in _SCORES.items()])


SUBJECTS = "subjects AS (SELECT s_suppkey AS participant, s_acctbal AS score, s_nationkey AS nation FROM supplier)"
SCORES = SUBJECTS + f""",
scores AS (SELECT participant, {', '.join(f'({sql})::DOUBLE AS "{name}"' for name, sql in _SCORES.items())} FROM subjects)"""
