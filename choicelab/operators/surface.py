"""The diffusion likelihood over grids, one grid per group.

Trials are collapsed to counts, dealt out by ranges of (group, reaction time) and sorted
within them, so a group of any size is spread, most groups lie in one task and an Arrow
batch holds few of them. A task sums the tensor of its trials and the grid and sends one
tensor per group, never a row per trial and grid point; sums and weights are taken from
the tensors before they become rows. A coarse grid that all groups share is refined
around each group's own mass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from choicelab.functions import diffusion
from choicelab.operators.grouped import group_codes, group_rows
from choicelab.operators.joins import attach
from choicelab.operators.ranking import col
from choicelab.staging import settings, shuffle_tasks, stage

AXES = ("v", "a", "t", "z")
HELD = 256
PACK = 1024  # trials in a list
FEW = 64  # trials per row below which rows are taken together

# Where a refined axis may reach: boundaries and times are not negative, starting points are shares.
LIMITS = {"v": (-50.0, 50.0), "a": (0.05, 50.0), "t": (0.0, 50.0), "z": (0.02, 0.98)}
SPREAD = 2.5


def collapse_trials(trials: DataFrame, by: list[str], response: str = "accepted", rt: str = "rt") -> DataFrame:
    """by, ``_upper``, ``_rt``, ``_count``: answered trials as counts, those of a group next to each other; staged."""
    rows = trials.filter(col(response).isNotNull() & col(rt).isNotNull()).select(
        *map(col, by), (col(response) == 1).alias("_upper"), col(rt).cast("double").alias("_rt"))
    # ranges of the grouping columns are a grouping, so counting needs no further shuffle
    near = rows.repartitionByRange(shuffle_tasks(rows.sparkSession), *map(col, by), "_rt")
    counted = near.groupBy(*map(col, by), "_upper", "_rt").agg(F.count(F.lit(1)).alias("_count"))
    return stage(counted.sortWithinPartitions(*map(col, by), "_rt"), "collapsed")


def _packed(n_keys: int, schema: pa.Schema) -> Callable:
    """Task: the trials of a group and batch as lists of at most PACK."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = [at[i:i + PACK] for at in group_rows(batch.columns[:n_keys], batch.num_rows).values() for i in range(0, len(at), PACK)]
            first, order = pa.array([piece[0] for piece in pieces]), pa.array(np.concatenate(pieces))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(piece) for piece in pieces])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, batch.column(n_keys + j).take(order)) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*(c.take(first) for c in batch.columns[:n_keys]), *lists], schema=schema)
    return run


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as its values and the place where each row's begin, and the end."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _row_sums(columns: list[pa.Array], terms: int) -> Iterator[np.ndarray]:
    """Tensor of every row: lists of trials and four axes. Few trials per row are taken for many rows at once."""
    (upper, ends), (rt, _), (count, _) = map(_numbers, columns[:3])
    axes, cuts = zip(*map(_numbers, columns[3:]))
    count = count.astype(float)
    rows = len(ends) - 1
    if len(rt) < FEW * rows and all((np.diff(c) == c[1]).all() for c in cuts):
        yield from diffusion.grid_logliks(rt, upper, count, np.diff(ends), *[x.reshape(rows, -1) for x in axes], terms)
        return
    for i in range(rows):
        own = slice(ends[i], ends[i + 1])
        yield diffusion.grid_loglik(rt[own], upper[own], count[own], *[x[c[i]:c[i + 1]] for x, c in zip(axes, cuts)], terms)


def _tensors(n_keys: int, schema: pa.Schema, terms: int) -> Callable:
    """Task: one tensor of sums per group it meets, on the axes that the group's rows carry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*group, *axes, total.ravel()) for group, (axes, total) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for start in range(0, batch.num_rows, HELD):
                part = batch.slice(start, HELD)
                totals = list(_row_sums(part.columns[n_keys:], terms))
                for group, at in group_rows(part.columns[:n_keys], part.num_rows).items():
                    total = sum(totals[i] for i in at)
                    if group in held:
                        held[group] = (held[group][0], total + held[group][1])
                    else:
                        held[group] = ([part.column(n_keys + 3 + j)[int(at[0])].values.to_numpy() for j in range(4)], total)
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()
    return run


def _tensor_rows(collapsed: DataFrame, by: list[str], axes: DataFrame | dict[str, list[float]], terms: int) -> DataFrame:
    """by, ``_v``, ``_a``, ``_t``, ``_z``, ``_sums``: a row per group, with the tensors of the tasks that hold trials of it.

    Axes are joined to lists of trials, not to trials.
    """
    kinds = [collapsed.schema[k] for k in by]
    numbers = T.ArrayType(T.DoubleType())
    lists = T.StructType([*kinds, T.StructField("_upper", T.ArrayType(T.BooleanType())), T.StructField("_rt", numbers), T.StructField("_count", T.ArrayType(T.LongType()))])
    packed = collapsed.select(*map(col, by), "_upper", "_rt", "_count").mapInArrow(_packed(len(by), to_arrow_schema(lists)), lists)
    if isinstance(axes, dict):
        rows = packed.withColumns({f"_{name}": F.array(*[F.lit(float(x)) for x in axes[name]]) for name in AXES})
    else:
        named = axes.select(*map(col, by), *[col(name).alias(f"_{name}") for name in AXES])
        rows = attach(packed, named, by, "inner") if by else packed.join(named)  # one row
    out = T.StructType([*kinds, *[T.StructField(f"_{name}", numbers) for name in AXES], T.StructField("_sums", numbers)])
    placed = rows.select(*map(col, by), "_upper", "_rt", "_count", *[f"_{name}" for name in AXES])
    tensors = placed.mapInArrow(_tensors(len(by), to_arrow_schema(out), terms), out)
    grouped = tensors.groupBy(*map(col, by)).agg(*[F.first(f"_{name}").alias(f"_{name}") for name in AXES], F.collect_list("_sums").alias("_sums"))
    return grouped.filter(F.size("_sums") > 0)


def _weighed(n_keys: int, schema: pa.Schema) -> Callable:
    """Task: the tensors of a group to their sum and the weight of every point."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, weights = [], []
            for sums in batch.column(n_keys + 4):
                total = np.sum([x.values.to_numpy() for x in sums], axis=0)
                weight = np.exp(total - total.max())
                totals.append(total)
                weights.append(weight / weight.sum())
            lists = [pa.array(x, pa.list_(pa.float64())) for x in (totals, weights)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys + 4], *lists], schema=schema)
    return run


def _weighed_rows(collapsed: DataFrame, by: list[str], axes: DataFrame | dict[str, list[float]], terms: int) -> DataFrame:
    """by, ``_v``, ``_a``, ``_t``, ``_z``, ``_total``, ``_weight``: a row per group with the arrays of its grid."""
    tensors = _tensor_rows(collapsed, by, axes, terms)
    numbers = T.ArrayType(T.DoubleType())
    out = T.StructType([*[collapsed.schema[k] for k in by], *[T.StructField(name, numbers) for name in (*[f"_{x}" for x in AXES], "_total", "_weight")]])
    return tensors.mapInArrow(_weighed(len(by), to_arrow_schema(out)), out)


def weighted_surface(collapsed: DataFrame, by: list[str], axes: DataFrame | dict[str, list[float]], terms: int = 7) -> DataFrame:
    """``surface`` with the posterior ``weight`` under a flat prior on the group's grid."""
    grids = _weighed_rows(collapsed, by, axes, terms)
    points = grids.select(*map(col, by), *[F.col(f"_{name}") for name in AXES], F.posexplode(F.arrays_zip("_total", "_weight")).alias("_at", "_p"))
    place, at = {}, F.col("_at")
    for name in reversed(AXES):
        place[name] = F.element_at(f"_{name}", (at % F.size(f"_{name}") + 1).cast("int")).alias(name)
        at = F.floor(at / F.size(f"_{name}"))
    return points.select(*map(col, by), *[place[name] for name in AXES], F.col("_p._total").alias("loglik"), F.col("_p._weight").alias("weight"))


def surface(collapsed: DataFrame, by: list[str], axes: DataFrame | dict[str, list[float]], terms: int = 7) -> DataFrame:
    """by, v, a, t, z, loglik: summed log-likelihood of every group at every point of its grid.

    ``axes`` are four lists for all groups, or a table with a row per group and the
    four lists as arrays.
    """
    return weighted_surface(collapsed, by, axes, terms).drop("weight")


def finer_axis(points: np.ndarray, weight: np.ndarray, size: int, limits: tuple[float, float]) -> np.ndarray:
    """An axis around the mass on ``points``.

    It reaches SPREAD standard deviations to either side, each point standing for a cell
    of one step, and stays within ``limits``.
    """
    mean = float(weight @ points)
    variance = max(float(weight @ (points * points)) - mean * mean, 0.0)
    step = (points.max() - points.min()) / max(len(points) - 1, 1)
    reach = SPREAD * np.sqrt(variance + step * step / 12)
    low, high = max(mean - reach, limits[0]), min(mean + reach, limits[1])
    return low + (high - low) * (np.arange(size) / (size - 1))


def _refined(n_keys: int, schema: pa.Schema, sizes: dict[str, int]) -> Callable:
    """Task: the tensors of a group, one per task that held trials of it, to its next axes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *lists, sums in zip(*batch.columns[n_keys:n_keys + 5]):
                axes = [x.values.to_numpy() for x in lists]
                total = np.sum([x.values.to_numpy() for x in sums], axis=0).reshape([len(x) for x in axes])
                weight = np.exp(total - total.max())
                weight /= weight.sum()
                rows.append([finer_axis(x, weight.sum(axis=tuple(k for k in range(4) if k != j)), sizes[name], LIMITS[name])
                             for j, (name, x) in enumerate(zip(AXES, axes))])
            finer = [pa.array(c, pa.list_(pa.float64())) for c in zip(*rows)] if rows else [pa.array([], pa.list_(pa.float64()))] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *finer], schema=schema)
    return run


def refined_surface(collapsed: DataFrame, by: list[str], coarse: dict[str, list[float]], sizes: dict[str, int], rounds: int,
                    terms: int = 7) -> DataFrame:
    """Grid of the last of ``rounds`` refinements: by, v, a, t, z, loglik, weight; staged.

    A round shuffles one tensor per group and task and keeps a row of axes per group.
    """
    axes: DataFrame | dict[str, list[float]] = coarse
    out = T.StructType([*[collapsed.schema[k] for k in by], *[T.StructField(name, T.ArrayType(T.DoubleType())) for name in AXES]])
    for _ in range(rounds):
        tensors = _tensor_rows(collapsed, by, axes, terms)
        axes = stage(tensors.mapInArrow(_refined(len(by), to_arrow_schema(out), sizes), out), "axes")
    return stage(weighted_surface(collapsed, by, axes, terms), "surface")


def _start_sums(n_keys: int, z: np.ndarray, schema: pa.Schema, terms: int) -> Callable:
    """Task: per group of a batch of trials that carry v, a and t, the summed log-likelihood at every z."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, inverse = group_codes(batch.columns[:n_keys], batch.num_rows)
            order = np.argsort(inverse, kind="stable")
            upper, *numbers = (c.to_numpy(zero_copy_only=False)[order] for c in batch.columns[n_keys:])
            logliks = diffusion.start_logliks(numbers[0], upper, *numbers[1:], z, terms)
            sums = np.add.reduceat(logliks, np.searchsorted(inverse[order], np.arange(len(first))), axis=1)
            keys = [c.take(pa.array(first)) for c in batch.columns[:n_keys]]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, sums)], schema=schema)
    return run


def starting_points(trials: DataFrame, cells: DataFrame, by: list[str], z_grid: list[float], response: str = "accepted",
                    rt: str = "rt", terms: int = 7) -> DataFrame:
    """``cells`` with ``z``: posterior mean of the starting point given the cell's own v, a and t, flat prior on ``z_grid``.

    Cells without v, a or t have none. A trial takes its cell's parameters along, a batch of
    trials is one kernel call whatever the number of cells in it, and a row of sums per
    cell and batch leaves the task. The starting points are staged.
    """
    known = cells.filter(F.col("v").isNotNull() & F.col("a").isNotNull() & F.col("t").isNotNull())
    answered = trials.filter(col(response).isNotNull() & col(rt).isNotNull()).select(
        *map(col, by), (col(response) == 1).alias("_upper"), col(rt).cast("double").alias("_rt"))
    numbers = ["_upper", "_rt", "_v", "_a", "_t"]
    placed = attach(answered, known.select(*map(col, by), *[col(x).cast("double").alias(f"_{x}") for x in "vat"]), by, "inner")
    sums = [f"_{i}" for i in range(len(z_grid))]
    out = T.StructType([*[answered.schema[k] for k in by], *[T.StructField(name, T.DoubleType()) for name in sums]])
    partial = placed.select(*map(col, by), *numbers).mapInArrow(_start_sums(len(by), np.array(z_grid, dtype=float), to_arrow_schema(out), terms), out)
    totals = partial.groupBy(*map(col, by)).agg(*[F.sum(name).alias(name) for name in sums])
    top = F.greatest(*sums) if len(sums) > 1 else F.col(sums[0])
    weighed = totals.select(*map(col, by), F.array(*[F.exp(F.col(name) - top) for name in sums]).alias("_weight"))
    mean = [sum((F.col("_weight")[i] * each for i, each in enumerate(values)), F.lit(0.0)) for values in (map(float, z_grid), [1.0] * len(z_grid))]
    starts = weighed.select(*map(col, by), (mean[0] / mean[1]).alias("z"))
    # rows of a few numbers cannot fill a batch, but measuring it after each of them costs as much as the join
    with settings(trials.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": 2 ** 31 - 1}):
        starts = stage(starts, "starts")
    return attach(cells, starts, by)


def loglik_points(collapsed: DataFrame, params: DataFrame, by: list[str], terms: int = 7) -> DataFrame:
    """by, loglik: summed log-likelihood at one parameter set per group."""
    points = params.select(*map(col, by), *[F.array(col(name).cast("double")).alias(name) for name in AXES])
    return surface(collapsed, by, points, terms).select(*map(col, by), "loglik")
