"""Sinks. All write in parallel.

Output that is split by a column is rebalanced on it first: small groups share
tasks and get one file, a group far above the advisory partition size is split
over several tasks and files. The time to create a file does not depend on its
bytes, so tasks are not merged by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelab.operators.ranking import col
from choicelab.staging import settings


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ",",
                partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet or delimited text with a header, optionally split by column values."""
    if partition_by:
        df = df.hint("rebalance", *map(col, partition_by))
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with settings(df.sparkSession, {"spark.sql.adaptive.coalescePartitions.enabled": "false"} if partition_by else {}):
        if fmt == "csv":
            writer.option("header", True).option("sep", sep).csv(path)
        else:
            writer.format(fmt).save(path)


def write_kv_text(df: DataFrame, path: str, key: str, value: str, partition_by: list[str] | None = None) -> None:
    """``key: value`` lines."""
    line = F.concat_ws(": ", col(key).cast("string"), col(value).cast("string")).alias("value")
    writer = df.select(*map(col, partition_by or []), line).write
    (writer.partitionBy(*partition_by) if partition_by else writer).text(path)


def write_stat_maps(df: DataFrame, path: str, regressor: str = "regressor") -> None:
    """Betas, t and p of all regressors as one table, one directory per regressor."""
    write_table(df, path, partition_by=[regressor])
