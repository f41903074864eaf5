"""Mixing sources to target weights.

Documents of a source are put in the order of a random key; running sums of
their sizes tell which of them the budget still covers after whole epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choicelab.llm.prefix import random_key, running_sums
from choicelab.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
MOST_EPOCHS = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """source_key, source_size, rows, target: every source's share of all words by weight.

    Sources by code point, null last, weigh 1, 2, 3, repeating. No target is above
    MOST_EPOCHS times its source; what is above goes to the others by weight. Filling
    starts with the source that reaches its limit first, so one pass finds the level.
    One task sorts the sums, a row per source: meant for sources that fit one task, not for URLs as sources.
    """
    sums = sizes.groupBy("source_key", "_named", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    big = "decimal(38,0)"
    listed = sums.withColumn("_weight", ((place - 1) % 3 + 1).cast("long")).withColumn("_cap", F.col("source_size") * MOST_EPOCHS)
    full = Window.orderBy(F.col("_cap") / F.col("_weight"), "_cap", "source_key")
    filled = (listed.withColumn("_rest", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("_weights", F.sum("_weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("_open", F.col("_rest").cast(big) * F.col("_weight") <= F.col("_cap").cast(big) * F.col("_weights")))
    level = F.first(F.when(F.col("_open"), F.col("_rest").cast("double") / F.col("_weights")), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, 0))
    return filled.select("source_key", "source_size", "rows", F.coalesce(F.col("_weight") * level, F.col("_cap").cast("double")).alias("target"))


def mix(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``.

    A source's taken words add up to its target rounded down: whole epochs of all its
    documents, then documents in random order, the last one in part. Null text has no
    words, a null source is a source. Rows that repeat id and size are
    interchangeable. An empty table gives an empty result. Other columns are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
                  .withColumn("_named", F.col("source").isNotNull())
                  .withColumn("source_key", F.concat(F.when(F.col("_named"), "=").otherwise("-"), F.coalesce("source", F.lit(""))))
                  .withColumn("_key", random_key(F.col("doc_id"), seed=seed)), "mix-sizes")
    targets = stage(source_targets(sizes), "mix-targets")
    placed = running_sums(sizes.drop("source", "_named").join(targets, "source_key"), "source_key", "rows", "_key", "size", ["doc_id", "size"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size")
    part = F.least(F.greatest(left - F.col("before"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, the last in part counting as whole.

    Documents without words take no part in a mix by words.
    """
    taken = mix(docs, seed).filter("taken > 0").select(F.col("doc_id").alias("_id"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    per_id = stage(taken.groupBy("_id").agg(F.max("_times").alias("_times")), "mix-times")
    worded = docs.filter(F.col("text").rlike(WORD)).select(F.struct("*").alias("_whole"), F.col("doc_id").alias("_doc"))
    joined = worded.join(per_id.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")))
    return joined.select("_whole", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_whole.*")


SQL = f"""
    WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('0:' || doc_id) AS rnd FROM documents),
    sums AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sizes GROUP BY source),
    listed AS (SELECT source, source_size, (place - 1) % 3 + 1 AS weight, {MOST_EPOCHS} * source_size AS cap FROM sums),
    filled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest,
                      sum(weight) OVER (ORDER BY cap / weight, cap, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM listed),
    level AS (SELECT arg_min(rest::DOUBLE / weights::DOUBLE, cap / weight) AS level, min(cap / weight) AS share FROM filled WHERE rest * weight <= cap * weights),
    targets AS (SELECT source, source_size, CASE WHEN cap / weight >= share THEN weight * level ELSE cap::DOUBLE END AS target FROM filled, level),
    placed AS (SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
                      (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.rnd, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS before
               FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + least(greatest(budget % source_size - before, 0), size) END)::BIGINT AS taken
    FROM placed"""
