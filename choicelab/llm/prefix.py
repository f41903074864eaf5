"""Running sums within groups of any size, in a random but repeatable order.

The order is that of a hash key, so ranges of the key hold equal shares of a
group. A group gets one range per RANGE_ROWS rows; sums per range are added up
over the few ranges of a group, and only rows of one range are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicelab.staging import stage

RANGE_ROWS = 50_000


def random_key(*parts: Column, seed: int = 0) -> Column:
    """32 hex digits that depend on the parts and the seed only; nulls count as the word null."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))


def running_sums(rows: DataFrame, group: str, rows_in_group: str, key: str, weight: str, ties: list[str]) -> DataFrame:
    """``rows`` with ``before``: the weight of the group's rows that come earlier in key order.

    ``group`` is not null; ``rows_in_group`` holds the size of the row's group.
    """
    share = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    ranges = F.ceil(F.col(rows_in_group) / RANGE_ROWS)
    ranged = rows.withColumn("_range", F.floor(share * ranges / F.lit(2**32)).cast("long"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = (ranged.groupBy(group, "_range").agg(F.sum(weight).alias("_sum"))
            .select(group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier")))
    inside = Window.partitionBy(group, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(stage(sums, "range-sums"), [group, "_range"])
            .withColumn("before", F.col("_earlier") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .drop("_earlier", "_range"))
