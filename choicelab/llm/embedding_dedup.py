"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated and split into BLOCKS blocks. Two vectors at squared
distance t or less are within t / BLOCKS in one block at least, so each block is
joined by that range and the union of the candidates is verified with all
components; a pair counts in the first block that finds it. Within a block rows
are cut into cells as wide as the block's range along its first coordinate: partners are
in the same or the next cell. A cell is cut into chunks, and two chunks meet in
one task as matrices, so no pair becomes a row: per row its number of partners
and a spanning forest of the links go out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelab.llm.batches import bound_batches, starts_of, whole_groups
from choicelab.llm.components import components
from choicelab.llm.near_dedup import forest
from choicelab.staging import stage

BLOCKS = 4
CHUNK = 8192
STRIP = 256
SEED = 20_240_607
#: Room for single-precision distances in the candidate search; the verification is exact.
SLACK = 1e-3


def rotation(dims: int) -> np.ndarray:
    """The same random rotation everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the class of their components (null: links with nothing), and the classes; staged."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    norm = F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)
    good = F.coalesce((F.size("embedding") > 0) & finite & (norm > 0), F.lit(False))
    rows = stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.col("embedding").cast("array<float>")).alias("embedding")), "vectors")
    classes = stage(rows.filter("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    return rows, classes


def _cells(classes: DataFrame, budget: float) -> DataFrame:
    """block, cell, id, copies, embedding: every row in its cell of each block, and as a visitor in the cell below."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                part = batch.take(pa.array(at))
                units = _units(part.column("embedding").flatten().to_numpy(zero_copy_only=False), int(dims)) @ rotation(int(dims))
                splits = _splits(int(dims))
                for block, first in enumerate(splits[:-1]):
                    cell = np.floor(units[:, first] / np.sqrt(_share(budget, splits, block) + SLACK)).astype(np.int32)
                    for back in (0, 1):
                        rows = [pa.array(np.full(len(at), dims, np.int32)), pa.array(np.full(len(at), block, np.int32)), pa.array(cell - back), pa.array(np.full(len(at), back == 1))]
                        yield pa.RecordBatch.from_arrays([*rows, part.column("id")], names=["dims", "block", "cell", "visits", "id"])

    return classes.select("id", "embedding").mapInArrow(run, "dims int, block int, cell int, visits boolean, id long")


def _splits(dims: int) -> np.ndarray:
    return np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int)


def _share(budget: float, splits: np.ndarray, block: int) -> float:
    """The part of the budget that a block's dimensions have."""
    return budget * (splits[block + 1] - splits[block]) / splits[-1]


def _units(values: np.ndarray, dims: int) -> np.ndarray:
    rows = values.astype(np.float64).reshape(-1, dims)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _found(x: np.ndarray, y: np.ndarray, block: int, splits: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the block's budget and in no earlier block's, in bounded portions."""
    def side(rows: np.ndarray, factor: float, last: bool) -> np.ndarray:
        own = rows[:, splits[block]:splits[block + 1]]
        square, one = (own * own).sum(axis=1, keepdims=True), np.ones((len(own), 1))
        return np.hstack([factor * own, *((one, square) if last else (square, one))]).astype(np.float32)

    right = side(y, -2.0, True).T.copy()
    left = side(x, 1.0, False)
    for at in range(0, len(x), STRIP):
        near = np.flatnonzero(left[at:at + STRIP] @ right <= np.float32(_share(budget, splits, block) + SLACK))
        for k in range(0, len(near), 20_000):
            i, j = np.divmod(near[k:k + 20_000], len(y))
            i = i + at
            for of in range(block + 1):  # without the search's slack, so that no pair counts in two blocks
                a, b = splits[of], splits[of + 1]
                within = ((x[i, a:b] - y[j, a:b]) ** 2).sum(axis=1) <= _share(budget, splits, of)
                good = within if of == block else ~within
                i, j = i[good], j[good]
            yield i, j


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Rows link at cosine >= ``cosine`` in double precision; n_links counts the others
    linked directly, component_id is the smallest vec_id reachable. Null, empty and zero
    vectors and those with null or non-finite components link with nothing; vectors of
    different length do not link. Equal vectors are one class, whose rows link to each
    other. An empty table gives an empty result. Other columns are ignored.
    """
    bound_batches(vectors.sparkSession)
    budget = 2 - 2 * cosine
    rows, classes = _classes(vectors)
    placed = stage(_cells(classes, budget), "cells")
    keys = ["dims", "block", "cell"]
    sizes = stage(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.sum((~F.col("visits")).cast("int")).alias("own")).filter("own > 0 and size > 1"), "cell-sizes")
    chunked = placed.join(sizes, keys).withColumn("_n", F.ceil(F.col("size") / CHUNK).cast("int")).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    paired = chunked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(
        *keys, "visits", "id", "_own", F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [*keys, "a", "b"], rows=CHUNK):
            cols = [table[k].to_numpy() for k in (*keys, "a", "b")]
            own, visits, ids, copies = (table[k].to_numpy() for k in ("_own", "visits", "id", "copies"))
            first = starts_of(*cols)
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(ids)]):
                out = _block(table.slice(s, e - s), int(cols[0][s]), int(cols[1][s]), cols[3][s], cols[4][s], own[s:e], visits[s:e], ids[s:e], copies[s:e])
                if out is not None:
                    yield out

    def _block(table, dims, block, a, b, own, visits, ids, copies):
        units = _units(np.frombuffer(b"".join(table["vector"].to_pylist()), np.float32), dims)
        turned = units @ rotation(dims)
        splits = _splits(dims)
        links_i, links_j = [], []
        for one, two in ((a, b),) if a == b else ((a, b), (b, a)):
            left, right = np.flatnonzero((own == one) & ~visits), np.flatnonzero(own == two)
            if one != two:  # own rows of both chunks meet once; visitors meet in their own cell
                right = right[visits[right] | (one < two)]
            if not len(left) or not len(right):
                continue
            for i, j in _found(turned[left], turned[right], block, splits, budget):
                i, j = left[i], right[j]
                if one == two:
                    once = visits[j] | (i < j)
                    i, j = i[once], j[once]
                close = (units[i] * units[j]).sum(axis=1) >= cosine
                links_i.append(i[close])
                links_j.append(j[close])
        i, j = np.concatenate([*links_i, np.zeros(0, np.int64)]), np.concatenate([*links_j, np.zeros(0, np.int64)])
        if not len(i):
            return None
        n = len(ids)
        count = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
        hit = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[forest(n, i, j)[hit]]), pa.array(count[hit].astype(np.int64))], names=["u", "v", "links"])

    dealt = [*keys, "a", "b"]
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors_ = [np.array(v, np.float32).tobytes() for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), pa.array(vectors_, pa.binary())], names=["id", "copies", "vector"])

    packed = stage(classes.mapInArrow(pack, "id long, copies long, vector binary"), "packed-vectors")
    found = stage(paired.join(packed, "id").select(*dealt, "visits", "id", "_own", "copies", "vector").repartition(*dealt)
                  .sortWithinPartitions(*dealt).mapInArrow(link, "u long, v long, links long"), "vector-links")
    comps = components(found)
    counts = stage(found.groupBy("u").agg(F.sum("links").alias("links")), "link-counts")
    of_class = stage(classes.join(counts.withColumnRenamed("u", "id"), "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
                     .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vector-result")
    return rows.join(of_class, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
