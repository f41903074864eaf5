"""Exact duplicates by most-significant-digit radix partitioning.

The digits of a document are its length and then its bytes, taken in strips that
grow geometrically. A round counts the documents of each (group, strip); those
alone are finished, the others go on as a new group with the rest of their bytes.
A group whose bytes are used up holds equal documents: all bytes were compared,
no digest decides. A strip is read once, and the number of rounds grows with the
logarithm of the longest text that shares its strips with another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelab.staging import stage

FIRST_STRIP = 32
GROWTH = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _split(rows: DataFrame, by: list[str], width: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the group they go on in (null: alone), and the groups of more than one row."""
    rows = rows.withColumn("_strip", F.substring("_rest", 1, width))
    # Counted with map-side combine, so a hot group is a few rows here. Written, it is an ordinary input of
    # the join, whose hot partitions adaptive execution can split.
    groups = stage(rows.groupBy(*by, "_strip").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
                   .select(*by, "_strip", F.monotonically_increasing_id().alias("_next")), "radix-groups")
    # One plan at every size: texts are shuffled whether or not the groups would fit a broadcast.
    joined = rows.join(groups.hint("merge"), [*by, "_strip"], "left")
    return joined.withColumn("_group", F.col("_next")).withColumn(
        "_rest", F.when(F.col("_next").isNotNull(), F.expr(f"substring(_rest, {width + 1})"))).drop("_next", "_strip"), groups


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The
    row with the largest id stays (a null id is smallest; of rows that repeat id and
    text, one stays). An empty table gives an empty result. Other columns are ignored.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(norm, 256).alias("_sha"), norm.cast("binary").alias("_rest"))
    rows = rows.withColumn("_len", F.length("_rest").cast("long"))
    split, groups = _split(rows, ["_len"], FIRST_STRIP)
    longest = groups.agg(F.max("_len")).first()[0]
    active = stage(split.select("_id", "_sha", "_len", "_rest", "_group", F.monotonically_increasing_id().alias("_row")), "radix-rows")
    alone = [active.filter("_group is null").select("_id", "_sha", "_row")]
    equal = []
    used, width = FIRST_STRIP, FIRST_STRIP * GROWTH
    while longest is not None:
        ended = F.col("_len") <= used
        equal.append(active.filter(F.col("_group").isNotNull() & ended).select("_id", "_sha", "_row", "_group"))
        if longest <= used:
            break
        going = active.filter(F.col("_group").isNotNull() & ~ended).select("_id", "_sha", "_len", "_rest", "_group", "_row")
        split, groups = _split(going, ["_len", "_group"], width)
        longest = groups.agg(F.max("_len")).first()[0]
        active = stage(split, "radix-rows")
        alone.append(active.filter("_group is null").select("_id", "_sha", "_row"))
        used, width = used + width, width * GROWTH
    singles = reduce(DataFrame.unionByName, alone).select(
        F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    copies = [_copies(rows, k) for k, rows in enumerate(equal)]
    return reduce(DataFrame.unionByName, copies, singles)


def _copies(rows: DataFrame, k: int) -> DataFrame:
    """Rows of finished groups with the row that stays; group numbers are those of one round."""
    best = stage(rows.groupBy("_group").agg(F.max(F.struct("_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("_size")), f"radix-kept-{k}")
    return rows.join(best, "_group").select(
        F.col("_id").alias("doc_id"), F.col("_best._id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = stage(exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")), "radix-stay")
    marked = docs.select(F.struct("*").alias("_whole"), F.col("doc_id").alias("_doc"), F.sha2(normalised(F.col("text")), 256).alias("_norm"))
    joined = marked.join(kept.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_norm") == F.col("_sha")), "left_semi")
    return joined.dropDuplicates(["_doc", "_norm"]).select("_whole.*")
