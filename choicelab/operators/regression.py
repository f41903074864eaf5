"""Least squares from triangular factors that are merged like sums.

A task reduces its rows [X | y] of a group to their triangular QR factor, a few
kilobytes whatever the number of rows. Stacked factors have the factor of all rows,
so factors are merged over a tree of tasks and solved once. Nothing is squared, so
the precision is that of the design and not of its normal equations.

A column that depends on the columns before it is aliased: its coefficient is null and
the others are those of the model without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from choicelab.functions.design import Term, design_cells, design_columns
from choicelab.operators.grouped import group_rows
from choicelab.operators.ranking import col

ALIASED = 1e-9
HELD = 512
FAN = 64
STACK = 8192  # rows of small groups that are orthogonalised together


@dataclass(frozen=True)
class Model:
    """A response and the terms it depends on, under the names that the result carries."""

    name: tuple
    response: str
    terms: tuple[Term, ...]
    intercept: bool = True

    def columns(self) -> dict[str, Column]:
        return design_columns(list(self.terms), self.intercept)

    def names(self) -> list[str]:
        return list(design_cells(list(self.terms), self.intercept))


def factor(rows: np.ndarray) -> np.ndarray:
    """Square triangular factor of a stack of rows or factors."""
    width = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == width else np.vstack([r, np.zeros((width - len(r), width))])


def solution(r: np.ndarray, n: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and standard errors, a row per response, from the factor of [X | responses]."""
    y = list(range(p, r.shape[1]))
    keep = list(range(p))
    while True:
        t = factor(r[:, keep + y])
        size = np.sqrt((t[:, :len(keep)] ** 2).sum(axis=0))
        weak = np.flatnonzero(np.abs(np.diagonal(t)[:len(keep)]) <= ALIASED * size)
        if not len(weak):
            break
        del keep[weak[0]]
    q = len(keep)
    beta, error = np.full((len(y), p), np.nan), np.full((len(y), p), np.nan)
    if q:
        inverse = np.linalg.solve(t[:q, :q], np.eye(q))
        beta[:, keep] = (inverse @ t[:q, q:]).T
        if n > q:
            rest = (t[q:, q:] ** 2).sum(axis=0) / (n - q)
            error[:, keep] = np.sqrt(rest[:, None] * (inverse ** 2).sum(axis=1)[None, :])
    return beta, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of fixed length as a matrix, null entries being NaN."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), width)


def _rows(df: DataFrame, keys: list[str], models: list[Model]) -> tuple[DataFrame, list[list[int]], list[int]]:
    """``df`` as keys, ``_x`` with the distinct design columns and ``_y`` with the responses, and each model's places in them."""
    designs = [m.names() for m in models]
    columns: dict[str, Column] = {}
    for m, d in zip(models, designs):
        if not columns.keys() >= set(d):  # expressions are slow to build, and many models share their design
            columns.update(m.columns())
    names, responses = list(columns), list(dict.fromkeys(m.response for m in models))
    number = lambda c: c.cast("double")
    rows = df.select(*map(col, keys), F.array(*map(number, columns.values())).alias("_x"), F.array(*[number(col(r)) for r in responses]).alias("_y"))
    return rows, [[names.index(n) for n in d] for d in designs], [responses.index(m.response) for m in models]


def _shared(places: list[list[int]]) -> dict[tuple, list[int]]:
    """Design -> the models that use it."""
    shared: dict[tuple, list[int]] = {}
    for m, p in enumerate(places):
        shared.setdefault(tuple(p), []).append(m)
    return shared


def _factors(n_keys: int, keys: pa.Schema, places: list[list[int]], targets: list[int], widths: tuple[int, int]) -> Callable:
    """Task: one factor per group and model of the rows it reads."""
    schema = pa.schema([*keys, pa.field("_model", pa.int32()), pa.field("_n", pa.int64()), pa.field("_r", pa.list_(pa.float64()))])

    shared = _shared(places)

    def flush(held: dict) -> pa.RecordBatch:
        rows = [(*group, m, n, r.ravel()) for group, per in held.items() for m, (n, r) in enumerate(per)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def add(per: list, x: np.ndarray, y: np.ndarray) -> None:
        """Rows of a group to the factors of all models; responses known in the same rows of a design are reduced together."""
        missing = np.isnan(y)
        for design, members in shared.items():
            own = x[:, list(design)]
            complete = ~np.isnan(own).any(axis=1)
            by_rows: dict[bytes, list[int]] = {}
            for m in members:
                by_rows.setdefault((complete & ~missing[:, targets[m]]).tobytes(), []).append(m)
            for mask, same in by_rows.items():
                use = np.frombuffer(mask, bool)
                n, p = int(use.sum()), len(design)
                if n:
                    r = factor(np.column_stack([own[use], y[use][:, [targets[m] for m in same]]]))
                    for k, m in enumerate(same):
                        per[m] = (per[m][0] + n, factor(np.vstack([per[m][1], r[:, [*range(p), p + k]]])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(n_keys), widths[0]), _matrix(batch.column(n_keys + 1), widths[1])
            for group, at in group_rows(batch.columns[:n_keys], batch.num_rows).items():
                add(held.setdefault(group, [(0, np.zeros((len(p) + 1, len(p) + 1))) for p in places]), x[at], y[at])
            if len(held) > HELD:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)
    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collected factors of a group and model to one."""
    for batch in batches:
        merged = []
        for factors in batch.column(batch.num_columns - 1).to_pylist():
            width = int(np.sqrt(len(factors[0])))
            merged.append(factor(np.array(factors, dtype=float).reshape(-1, width)).ravel())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(merged, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "_r"])


def _key_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys])


def merged_factors(df: DataFrame, keys: list[str], models: list[Model]) -> DataFrame:
    """keys, ``_model``, ``_n``, ``_r``: one factor per group and model, for groups of any size.

    A task sends one factor per group it meets (and again after HELD groups). Those of
    a group are merged FAN ways at a time first, so no task gathers those of all tasks.
    """
    rows, places, targets = _rows(df, keys, models)
    kinds = _key_schema(df, keys)
    widths = (len({i for p in places for i in p}), max(targets) + 1)
    out = T.StructType([*kinds, T.StructField("_model", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("_r", T.ArrayType(T.DoubleType()))])
    partial = rows.mapInArrow(_factors(len(keys), to_arrow_schema(kinds), places, targets, widths), out)
    keyed = [*map(col, keys), F.col("_model")]
    for split in ([F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("_part")], []):
        grouped = partial.select("*", *split).groupBy(*keyed, *(["_part"] if split else [])).agg(F.sum("_n").alias("_n"), F.collect_list("_r").alias("_r"))
        partial = grouped.select(*keyed, "_n", "_r").mapInArrow(_merged, out)
    return partial


def _solved(n_keys: int, names: list[list[str]], labels: list[tuple], schema: pa.Schema, aliased: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (m, n, r) in enumerate(zip(*(batch.column(n_keys + j).to_pylist() for j in range(3)))):
                p = len(names[m])
                beta, error = solution(np.array(r).reshape(p + 1, p + 1), n, p)
                if not aliased and np.isnan(beta).any():
                    continue
                at += [i] * p
                out += [(*labels[m], name, b, e, n) for name, b, e in zip(names[m], beta[0], error[0])]
            taken = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(n_keys)]
            values = [pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*out), list(schema)[n_keys:])] if out else [pa.array([], f.type) for f in list(schema)[n_keys:]]
            yield pa.RecordBatch.from_arrays([*taken, *values], schema=schema)
    return run


def _result_schema(kinds: T.StructType, name_fields: str) -> T.StructType:
    rest = T.StructType.fromDDL(f"{name_fields}, term string, beta double, se double, n long" if name_fields else "term string, beta double, se double, n long")
    return T.StructType([*kinds, *rest])


def pooled_regressions(df: DataFrame, keys: list[str], models: list[Model], name_fields: str = "", aliased: bool = True) -> DataFrame:
    """Every model fitted to the rows of every group: keys, names, term, beta, se, n.

    Rows without the response or a regressor of a model are left out of that model.
    Aliased terms have null beta and se, and se is null without residual degrees of
    freedom. Groups without rows for a model give no rows of it, and with ``aliased``
    false neither do groups in which a term is aliased.
    """
    kinds = _key_schema(df, keys)
    schema = _result_schema(kinds, name_fields)
    names = [m.names() for m in models]
    fit = _solved(len(keys), names, [m.name for m in models], to_arrow_schema(schema), aliased)
    return merged_factors(df, keys, models).filter("_n > 0").mapInArrow(fit, schema)


def _flat_matrix(column: pa.Array, width: int) -> np.ndarray:
    """List entries of all rows, ``width`` to a row of the matrix, null entries being NaN."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, width)


def _stacks(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of similar size, at most STACK rows together or one group: their numbers, and each one's rows, padded with -1."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    low = 0
    while low < len(order):
        longest = int(sizes[order[low]])
        some = order[low:low + max(1, STACK // max(longest, 1))]
        place = np.arange(longest)
        yield some, np.where(place < sizes[some][:, None], starts[some][:, None] + place, -1)
        low += len(some)


def stacked_solutions(columns: np.ndarray, n: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """``solution`` of many groups at once: coefficients and standard errors as (responses, p, groups).

    ``columns`` is [X | responses] as (p + responses, rows, groups), with 0 in rows that a group does
    not have; it is overwritten. Columns are orthogonalised one after the other, which
    leaves the residuals of an aliased column out of all later ones.
    """
    width, _, groups = columns.shape
    size = np.sqrt((columns[:p] ** 2).sum(axis=1))
    r = np.zeros((p, width, groups))
    weak = np.zeros((p, groups), bool)
    for j in range(p):
        length = np.sqrt((columns[j] ** 2).sum(axis=0))
        weak[j] = length <= ALIASED * size[j]
        q = columns[j] * np.where(weak[j], 0.0, 1 / np.where(weak[j], 1.0, length))
        r[j, j + 1:] = (columns[j + 1:] * q).sum(axis=1)
        columns[j + 1:] -= r[j, j + 1:, None] * q
        r[j, j] = np.where(weak[j], 1.0, length)
        r[:j, j][:, weak[j]] = 0.0
    inverse = np.linalg.inv(r[:, :p].transpose(2, 0, 1))
    beta = (inverse @ r[:, p:].transpose(2, 0, 1)).transpose(2, 1, 0)
    free = n - (p - weak.sum(axis=0))
    rest = (columns[p:] ** 2).sum(axis=1) / np.where(free > 0, free, np.nan)
    error = np.sqrt(rest[:, None] * (inverse ** 2).sum(axis=2).T)
    return np.where(weak, np.nan, beta), np.where(weak, np.nan, error)


def _stack_fits(x: np.ndarray, y: np.ndarray, at: np.ndarray, shared: dict[tuple, list[int]], targets: list[int]) -> Iterator[tuple]:
    """Every model of a stack of groups: model, the groups with rows for it, beta and se as (groups, terms), rows."""
    there = (at >= 0).T
    x, y = (np.ascontiguousarray(table[at].transpose(2, 1, 0)) for table in (x, y))  # column, row, group
    x_known, y_known = ~np.isnan(x) & there, ~np.isnan(y) & there
    for design, members in shared.items():
        own, p = list(design), len(design)
        complete = x_known[own].all(axis=0) & there
        wanted = list(dict.fromkeys(targets[m] for m in members))
        rows = np.stack([complete & y_known[k] for k in wanted])
        # responses known in the same rows of a group are fitted together
        first = np.stack([(rows == row).all(axis=1).argmax(axis=0) for row in rows])
        kinds, kind = np.unique(first, axis=1, return_inverse=True)
        for c, alike in enumerate(kinds.T):
            for k in np.unique(alike):
                who = np.flatnonzero((kind.ravel() == c) & rows[k].any(axis=0))
                if not len(who):
                    continue
                together = [wanted[i] for i in np.flatnonzero(alike == k)]
                use = rows[k][:, who]
                beta, error = stacked_solutions(np.concatenate([np.where(use, table[part][:, :, who], 0.0) for table, part in ((x, own), (y, together))]), use.sum(axis=0), p)
                for m in members:
                    if targets[m] in together:
                        i = together.index(targets[m])
                        yield m, who, beta[i].T, error[i].T, use.sum(axis=0)


def cell_regressions(cells: DataFrame, key: str, models: list[Model], name_fields: str = "") -> DataFrame:
    """``pooled_regressions`` for many small groups and many models at once.

    ``cells`` is an aggregated table whose rows per group are bounded, such as a row per
    subject and offer: a group is one row of arrays here, and only coefficients leave
    the task. Groups are fitted in stacks, and models with the same design and the same
    rows share its orthogonalised columns.
    """
    rows, places, targets = _rows(cells, [key], models)
    widths = (len({i for p in places for i in p}), max(targets) + 1)
    grouped = rows.groupBy(col(key)).agg(F.flatten(F.collect_list("_x")).alias("_x"), F.flatten(F.collect_list("_y")).alias("_y"))
    shared = _shared(places)
    names = [m.names() for m in models]
    schema = _result_schema(_key_schema(cells, [key]), name_fields)
    arrow = to_arrow_schema(schema)

    params = list(arrow)[1:-4]  # of the models' names
    terms = [pa.array(own, pa.string()) for own in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_flat_matrix(batch.column(j), widths[j - 1]) for j in (1, 2))
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False) // widths[1]
            for some, at in _stacks(sizes):
                out = []
                for m, who, beta, error, n in _stack_fits(x, y, at, shared, targets):
                    count = beta.shape[1]
                    label = [pa.array([value], f.type).take(pa.array(np.zeros(len(who) * count, np.int64))) for value, f in zip(models[m].name, params)]
                    term = terms[m].take(pa.array(np.tile(np.arange(count), len(who))))
                    numbers = [pa.array(c.ravel(), pa.float64(), from_pandas=True) for c in (beta, error)]
                    group = batch.column(0).take(pa.array(np.repeat(some[who], count)))
                    out.append(pa.RecordBatch.from_arrays([group, *label, term, *numbers, pa.array(np.repeat(n, count), pa.int64())], schema=arrow))
                if out:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return grouped.mapInArrow(run, schema)
