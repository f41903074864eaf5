"""Positions, previous values and exact quantiles within groups of any size.

One way for all groups: rows are sorted in ranges of (group, order), each range replays
its own part of every group, and what a group brings along from earlier ranges is
added from a summary of two rows per range. A group with a third of all rows is simply
spread over a third of the ranges. Equal rows are split as well, by their place in the input.

The input is read once for the bounds of the ranges and once for the result, which is
staged, so an expensive input should be staged first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicelab.staging import shuffle_tasks, stage

_HEAD, _TAIL = 1, 2
_ROW_BITS = 33  # of a monotonically increasing id: the place in its partition


def col(name: str) -> Column:
    """Column by its literal name; dots are part of the name."""
    return F.col(f"`{name}`")


def present(value: Column) -> Column:
    """The value as a number, NaN being null."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def sorted_ranges(df: DataFrame, by: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` in ranges that ascend with ``by`` and ``order``, each of them sorted."""
    keys = [*[col(c) for c in (*by, *order)], F.col("_tie")]
    ranges = ranges or shuffle_tasks(df.sparkSession)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    return tied.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("_tie")


def _same(a: tuple, b: tuple | None) -> bool:
    return b is not None and all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _replay(keys: list[int], value: int | None) -> Callable:
    """Task: number of every row in this range's part of its group, the value before, and where the range's first group and ends are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, count, before, opening = None, 0, None, True
        held: tuple | None = None

        def close(columns: list, edge: np.ndarray, names: list[str], tail: bool) -> pa.RecordBatch:
            if tail:
                edge[-1] |= _TAIL
            return pa.RecordBatch.from_arrays([*columns, pa.array(edge, pa.int32())], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held:
                yield close(*held, False)
            new = np.zeros(n, bool)
            for k in keys:
                codes = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = not _same(tuple(batch.column(k)[0].as_py() for k in keys), key)
            starts = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            local = np.where(starts >= 0, np.arange(n) - starts, np.arange(n) + count) + 1
            changes = np.cumsum(new) - (1 if key is None else 0)
            inside = (changes == 0) & opening
            edge = np.zeros(n, np.int32)
            edge[0] = _HEAD if key is None else 0
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(local), pa.array(inside)]
            names = [*batch.schema.names, "_part", "_local", "_opening"]
            if value is not None:
                values = batch.column(value)
                last = before if before is not None else pa.nulls(1, values.type)
                columns.append(pa.concat_arrays([last, values]).take(pa.array(np.arange(n), mask=new)))
                names.append("_before")
                before = values.slice(n - 1, 1)
            held = columns, edge, [*names, "_edge"]
            key, count, opening = tuple(batch.column(k)[n - 1].as_py() for k in keys), int(local[-1]), bool(inside[-1])
        if held:
            yield close(*held, True)
    return run


def _replayed(df: DataFrame, by: list[str], order: list[str], value: str | None, ranges: int | None) -> tuple[DataFrame, DataFrame]:
    """Staged rows with the replay's columns, and what each range's first group brings along: ``_at``, ``_sum``, ``_last``."""
    kind = [T.StructField("_before", df.schema[value].dataType)] if value else []
    extra = [T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType()), T.StructField("_opening", T.BooleanType()), *kind,
             T.StructField("_edge", T.IntegerType())]
    task = _replay([df.columns.index(k) for k in by], df.columns.index(value) if value else None)
    rows = stage(sorted_ranges(df, by, order, ranges).mapInArrow(task, T.StructType([*df.schema, *extra])), "replayed")
    keys = [col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    last = T.StructType([T.StructField("value", df.schema[value].dataType if value else T.IntegerType())])
    end = F.struct(col(value).alias("value")) if value else F.lit(None).cast(last)
    ends = rows.filter("_edge > 0").withColumns({"_head": F.col("_edge").bitwiseAND(_HEAD) > 0, "_tail": F.col("_edge").bitwiseAND(_TAIL) > 0})
    # two rows per range
    heads = ends.filter("_head").select(*keys, F.col("_part").alias("_at"), F.lit(True).alias("_opens"), F.lit(None).cast("long").alias("_sum"), F.lit(None).cast(last).alias("_last"))
    tails = ends.filter("_tail").select(*keys, F.col("_part").alias("_at"), F.lit(False).alias("_opens"), F.col("_local").alias("_sum"), end.alias("_last"))
    earlier = Window.partitionBy(*[F.col(f"_k{i}") for i in range(len(by))]).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    carried = heads.unionByName(tails).select("_opens", "_at", F.sum("_sum").over(earlier).alias("_sum"), F.last("_last", ignorenulls=True).over(earlier).alias("_last"))
    return rows, carried.filter(F.col("_opens") & F.col("_sum").isNotNull()).drop("_opens")


def row_index(df: DataFrame, by: list[str], order: list[str], out: str = "position", ranges: int | None = None) -> DataFrame:
    """Add 1..n within each group in ascending ``order``."""
    rows, carried = _replayed(df, by, order, None, ranges)
    # a row per range at most
    joined = rows.join(F.broadcast(carried), F.col("_opening") & (F.col("_part") == F.col("_at")), "left")
    kept = [col(c) for c in df.columns if c != out]
    return joined.select(*kept, (F.col("_local") + F.coalesce("_sum", F.lit(0))).alias(out))


def previous_value(df: DataFrame, by: list[str], order: list[str], value: str, out: str, ranges: int | None = None) -> DataFrame:
    """Add ``value`` of the row before in ascending ``order``; null on the first row."""
    rows, carried = _replayed(df, by, order, value, ranges)
    head = F.col("_edge").bitwiseAND(_HEAD) > 0
    joined = rows.join(F.broadcast(carried), head & (F.col("_part") == F.col("_at")), "left")
    return joined.select(*map(col, df.columns), F.when(head, F.col("_last.value")).otherwise(F.col("_before")).alias(out))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float],
                    out: str = "quantiles", ranges: int | None = None) -> DataFrame:
    """``by`` plus an array of linearly interpolated quantiles, one per entry of ``probs``.

    Values are sorted in ranges and have a position in the whole table. A group is
    then its first position and its size, and the order statistics are met by their
    position, which is unique, so no group gathers anywhere.
    """
    keys = [col(k) for k in by]
    data = df.select(*keys, present(col(value)).alias("_value")).filter(F.col("_value").isNotNull())
    ids = stage(sorted_ranges(data, by, ["_value"], ranges).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part, place = F.shiftright("_id", _ROW_BITS), F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    # the groups of a range with their first place and size; all but a range's first and last lie in it alone
    stretches = ids.groupBy(*keys, part.alias("_part")).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    stretches = stage(stretches, "stretches")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = stretches.groupBy("_part").agg(F.sum("_n").alias("_held"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_offset"))
    groups = stretches.join(F.broadcast(offsets), "_part").groupBy(*keys).agg(F.min(F.col("_offset") + F.col("_first")).alias("_start"), F.sum("_n").alias("_rows"))
    rank = lambda p: (F.col("_rows") - 1) * F.lit(float(p))
    ends = [f(rank(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]
    wanted = groups.select(*keys, "_start", "_rows", F.explode(F.transform(F.array_distinct(F.array(*ends)), lambda r: r + F.col("_start"))).alias("_at"))
    placed = ids.join(F.broadcast(offsets), part == F.col("_part")).select("_value", (F.col("_offset") + place).alias("_at"))
    found = wanted.join(placed, "_at")
    here = F.col("_at") - F.col("_start")
    picks = [F.min(F.when(here == e, F.col("_value"))).alias(f"_e{i}") for i, e in enumerate(ends)]
    picked = found.groupBy(*keys).agg(F.first("_rows").alias("_rows"), *picks)
    parts = []
    for i, p in enumerate(probs):
        share = rank(p) - F.floor(rank(p))
        parts.append(F.col(f"_e{2 * i}") * (1 - share) + F.col(f"_e{2 * i + 1}") * share)
    return picked.select(*keys, F.array(*parts).alias(out))
