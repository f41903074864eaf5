"""Connected components of an edge list by alternating stars.

Every round relinks the neighbours of each node to the smallest one, first the
larger neighbours, then the smaller ones. Both halves are one grouped minimum
with map-side combine and one join, so a hub is never gathered. A forest of
stars is the fixed point; it is reached in a logarithmic number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelab.staging import drop_path, scratch_path, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.select(F.col("v").alias("u"), F.col("u").alias("big")).join(least, "u").select(F.col("big").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v")))


def _fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal edge sets, up to a chance of 2^-64."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """node, component (smallest node reachable) for every node of a link.

    Links may repeat, point either way or to the node itself. Nulls are ignored;
    without links the result is empty.
    """
    spark = links.sparkSession
    path = scratch_path(spark, "stars")
    edges = stage(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), path=path)
    mark = _fingerprint(edges)
    while mark[0]:
        before = path
        half_path, path = scratch_path(spark, "stars"), scratch_path(spark, "stars")
        half = stage(_large_star(edges).filter("u != v").distinct(), path=half_path)
        edges = stage(_small_star(half).distinct(), path=path)
        drop_path(spark, before)
        drop_path(spark, half_path)
        found = _fingerprint(edges)
        if found == mark:
            break
        mark = found
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
