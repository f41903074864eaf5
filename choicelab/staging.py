"""Intermediate tables in the cluster's shared folder.

A staged table cuts lineage and, being files, carries its true size: a later
join broadcasts it only while it is below ``spark.sql.autoBroadcastJoinThreshold``
and is a shuffle join with adaptive skew handling beyond that.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the warehouse where it is unset.

    Both are folders that the driver and every executor share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/choicelab/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """SQL settings for what is planned or run inside; the session's own come back afterwards."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition collapsed rows by ``keys`` before a step that multiplies them.

    The explicit number keeps adaptive execution from merging the partitions by
    their present, small size. Later grouping by ``keys`` needs no further shuffle.
    """
    return df.repartition(shuffle_tasks(df.sparkSession), *keys)


def widen(df: DataFrame) -> DataFrame:
    """Deal rows evenly to the session's shuffle partitions before heavy work per row.

    How the input is cut into files then does not matter.
    """
    return df.repartition(shuffle_tasks(df.sparkSession))
