"""Scans of delimited tables, key-value text, event lists and draws."""

from __future__ import annotations

import csv
from contextlib import AbstractContextManager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from choicelab.operators.ranking import col
from choicelab.staging import settings, shuffle_tasks, stage


def read_delimited(spark: SparkSession, path, schema: str | None = None, sep: str = ",") -> DataFrame:
    """One delimited table with a header; all text unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def _few_listing_tasks(spark: SparkSession) -> AbstractContextManager[None]:
    """Files are listed by as many tasks as a shuffle has, not by one task per path."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    return settings(spark, {name: min(int(spark.conf.get(name)), shuffle_tasks(spark))})


def _headers(spark: SparkSession, pattern: str) -> DataFrame:
    """First line of every file as (file, header)."""
    with _few_listing_tasks(spark):
        text = spark.read.text(pattern)
    lines = text.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"))
    numbered = lines.filter(F.col("_at") == 0).withColumn("_line", F.monotonically_increasing_id())
    return numbered.groupBy("file").agg(F.min_by("value", "_line").alias("header"))


def read_subject_tables(spark: SparkSession, pattern: str, cols: list[str], sep: str = "\t",
                        subject_in_path: str | None = None, subject: str = "participant",
                        expected: list[str] | None = None, missing: str = "skip") -> DataFrame:
    """Union of per-subject files, projected by column name.

    One scan over many files matches columns by position, so files are read
    apart per distinct header; with a single header they are read by the pattern
    and no file name reaches the driver. A wanted column that a file lacks
    becomes null; a file that goes away before it is read is an error. ``subject_in_path`` is a pattern whose first group is the
    subject id; with ``missing="stop"`` an ``expected`` subject without a file is
    an error.
    """
    heads = stage(_headers(spark, pattern), "headers")
    if subject_in_path and expected and missing == "stop":
        ids = heads.select(F.regexp_extract("file", subject_in_path, 1).alias("id")).distinct()
        found = {r["id"] for r in ids.filter(F.col("id").isin(list(expected))).collect()}
        absent = sorted(set(expected) - found)
        if absent:
            raise FileNotFoundError(f"no table for {absent}")
    distinct = [r["header"] for r in heads.select("header").distinct().collect()]
    reader = spark.read.option("header", True).option("sep", sep)
    tables = []
    for header in distinct:
        names = next(csv.reader([header], delimiter=sep))
        files = pattern if len(distinct) == 1 else [r["file"] for r in heads.filter(F.col("header") == header).collect()]
        with _few_listing_tasks(spark):
            table = reader.schema(", ".join(f"`{n}` string" for n in names)).csv(files)
        wanted = [col(c) if c in names else F.lit(None).cast("string").alias(c) for c in cols]
        if subject_in_path:
            wanted.append(subject_from_path(subject_in_path).alias(subject))
        tables.append(table.select(*wanted))
    return reduce(DataFrame.unionByName, tables)


def subject_from_path(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def events_for_subject(spark: SparkSession, pattern: str, subject_in_path: str, schema: str,
                       sep: str = "\t", subject: str = "participant") -> DataFrame:
    """Event lists of all subjects with the subject id taken from the path."""
    with _few_listing_tasks(spark):
        table = spark.read.option("header", True).option("sep", sep).schema(schema).csv(pattern)
    return table.select("*", subject_from_path(subject_in_path).alias(subject))


def channel_table(channels: DataFrame, recording: str = "recording", name: str = "name",
                  status: str = "status") -> DataFrame:
    """Bad channels of every recording: sorted names and their number."""
    bad = F.when(col(status) != "good", col(name))
    return channels.groupBy(col(recording)).agg(F.array_sort(F.collect_list(bad)).alias("bads"),
                                                F.count(bad).alias("n_bad"))


def scan_kv_text(spark: SparkSession, pattern: str, key: str, model_in_path: str) -> DataFrame:
    """(model, value) from ``key: value`` text files; the model id comes from the path.

    The first line with the key counts. Text that is not a number gives null.
    """
    lines = spark.read.text(pattern).select(
        F.regexp_extract(F.col("_metadata.file_path"), model_in_path, 1).alias("model"), F.trim("value").alias("line"),
        F.col("_metadata.file_block_start").alias("_block"))
    stem = f"{key}: "
    wanted = lines.filter(F.col("line").startswith(stem)).withColumn("_line", F.monotonically_increasing_id())
    first = wanted.groupBy("model").agg(F.min_by("line", F.struct("_block", "_line")).alias("line"))
    return first.select("model", F.substring("line", len(stem) + 1, 2**31 - 1).try_cast("double").alias("value"))


def read_kv_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Every ``name: value`` line as (name, value)."""
    lines = spark.read.text(pattern)
    return lines.select(F.regexp_extract("value", r"^(.*): ", 1).alias("name"),
                        F.regexp_extract("value", r"^.*: (.*)$", 1).try_cast("double").alias("value"))


def read_draws(spark: SparkSession, path) -> DataFrame:
    """Saved posterior draws; several paths are combined, the chain is a column."""
    return spark.read.parquet(*path) if isinstance(path, (list, tuple)) else spark.read.parquet(path)
