"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelab.staging import stage

SHARES = 1 << 30


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def with_labels(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """doc_id, label (null: none) of the rows that are not held out. Of labels that disagree the larger counts."""
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(~held_out("doc_id", folds, fold))
    return ids.join(known, "doc_id", "left")


def bounded_sample(rows: DataFrame, groups: dict[str, Column], most: int) -> DataFrame:
    """doc_id, part: about ``most`` rows of each group at most, the same ones in every run; staged.

    A group's rows are taken by a hash of the id, at the share that its count allows.
    """
    counts = rows.agg(*(F.count(F.when(c, 1)).alias(g) for g, c in groups.items())).first()
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(SHARES))
    parts = [rows.filter(c & (place < int(SHARES * min(1.0, most / max(1, counts[g]))))).select("doc_id", F.lit(g).alias("part")) for g, c in groups.items()]
    return stage(reduce(DataFrame.unionByName, parts).dropDuplicates(["doc_id", "part"]), "sample")
