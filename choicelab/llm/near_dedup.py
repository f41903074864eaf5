"""Near duplicates by SetSketch registers.

1. Every document becomes its set of word shingles and a sketch: register ``j``
   is the minimum over the set of exponential variates, kept as
   ``floor(1 - log_b(minimum))`` within ``[0, LIMIT]``. Registers merge by maximum, and two
   sets agree in a register with about their Jaccard similarity.
2. Sets that are identical become one class. Classes that share a band of
   registers are compared there by the likelihood estimate of their similarity,
   and a spanning forest of the pairs that may pass goes out, not the pairs.
3. Components of that forest hold every link. Their full sets meet once, in
   blocks of bounded size, where intersections are counted exactly; again a
   spanning forest of the confirmed links goes out.

A bucket or component of any size is cut into chunks, and every two chunks meet
in a task of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelab.llm.batches import bound_batches, starts_of, whole_groups
from choicelab.llm.components import components
from choicelab.llm.text import mix, shingles, slices
from choicelab.staging import stage

REGISTERS = 128
BAND_ROWS = 4
BASE = 1.001
RATE = 20.0
LIMIT = 65_535
#: A pair is verified unless its estimate lies this many standard deviations below the threshold.
SAFETY = 5.0
CHUNK = 512
COLUMNS = 8192
_STEP = np.arange(1, REGISTERS + 1, dtype=np.uint64)
_FACTORS = (mix(_STEP) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_OFFSETS = (mix(_STEP << np.uint64(20)) >> np.uint64(32)).astype(np.uint32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes."""
    seeds = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(seeds), 1024):
        spread = (seeds[at:at + 1024] ^ _OFFSETS[:, None]) * _FACTORS[:, None]
        np.minimum(least, spread.min(axis=1), out=least)
    variates = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variates) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(one, other)


def joint_estimate(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows) with known set sizes.

    With u and v the shares of the sizes, a register of the first is larger with
    u - v J, smaller with v - u J, equal with J (base near 1); the likelihood of the
    three counts has its maximum at the smaller root of a quadratic.
    """
    larger = (one > other).sum(axis=1)
    smaller = (one < other).sum(axis=1)
    equal = one.shape[1] - larger - smaller
    u = n_one / (n_one + n_other)
    v = 1 - u
    a = u * v * one.shape[1]
    b = equal * (u * u + v * v) + v * v * larger + u * u * smaller
    c = equal * u * v
    return (b - np.sqrt(np.maximum(0, b * b - 4 * a * c))) / (2 * a)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Per node 0..n-1 the smallest node of its component."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            break
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """``k1``, ``k2``: 128 bits of a row's id and text, so that null and repeated ids tell their texts apart."""
    return [F.xxhash64(F.col(text_col), F.col(id_col)).alias("k1"), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("k2")]


def sketch_table(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2, n_shingles, digest of the set, sketch (null for an empty set); staged."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for part in slices(batch.column(3)):
                for own in shingles(part.lowered(), width):
                    sizes.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sketches.append(sketch(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "k1", "k2", "n_shingles", "digest", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_row_key(id_col, text_col), F.col(text_col).alias("text"))
    return stage(rows.mapInArrow(run, "doc_id long, k1 long, k2 long, n_shingles long, digest binary, sketch binary"), "sketches")


def _chunked(rows: DataFrame, size: str) -> DataFrame:
    """Rows per pair of chunks (a <= b) of their group of ``size`` rows, chunks having about CHUNK rows."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col(size) / CHUNK)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int")
    rows = rows.withColumn("_chunks", chunks).withColumn("_own", own)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    return rows.select("*", F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b")).drop("_chunks", "_other")


def _pairs(first: np.ndarray, a: np.ndarray, b: np.ndarray, own: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within each run of rows, in portions; a pair within one chunk counts in the block (a, a) only."""
    ends = np.append(first[1:], len(own))
    lefts, rights, held = [], [], 0
    for s, e in zip(first, ends):
        if e - s < 2:
            continue
        if a[s] == b[s]:
            i, j = np.triu_indices(e - s, 1)
            i, j = i + s, j + s
        else:
            here = np.arange(s, e)
            x, y = here[own[s:e] == a[s]], here[own[s:e] == b[s]]
            i, j = np.repeat(x, len(y)), np.tile(y, len(x))
        lefts.append(i)
        rights.append(j)
        held += len(i)
        if held >= most:
            yield np.concatenate(lefts), np.concatenate(rights)
            lefts, rights, held = [], [], 0
    if held:
        yield np.concatenate(lefts), np.concatenate(rights)


def _edges(ids: np.ndarray, root: np.ndarray) -> pa.RecordBatch | None:
    """Links of each row to the smallest of its tree."""
    linked = root != np.arange(len(root))
    u, v = ids[linked], ids[root[linked]]
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _stacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def candidate_forest(classes: DataFrame, threshold: float) -> DataFrame:
    """u, v: spanning forests of the pairs that share a band and may reach ``threshold``."""
    bands = REGISTERS // BAND_ROWS
    floor = threshold - SAFETY * np.sqrt(threshold * (1 - threshold) / REGISTERS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _stacked(batch.column(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(bands, dtype=np.int16), len(keys))), pa.array(keys.ravel()),
                 pa.array(np.repeat(batch.column(0).to_numpy(), bands))], names=["band", "key", "id"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["band", "key", "a", "b"]):
            band, key, a, b, own, ids, sizes = (table[k].to_numpy() for k in ("band", "key", "a", "b", "_own", "id", "n"))
            registers = _stacked(table["sketch"])
            good_i, good_j = [], []
            for i, j in _pairs(starts_of(band, key, a, b), a, b, own):
                for at in range(0, len(i), 50_000):
                    x, y = i[at:at + 50_000], j[at:at + 50_000]
                    near = joint_estimate(registers[x], registers[y], sizes[x], sizes[y]) >= floor
                    good_i.append(x[near])
                    good_j.append(y[near])
            if good_i:
                yield _edges(ids, forest(len(ids), np.concatenate(good_i), np.concatenate(good_j)))

    banded = stage(classes.select("id", "sketch").mapInArrow(cut, "band short, key long, id long"), "bands")
    full = stage(banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = _chunked(banded.join(full, ["band", "key"]), "size").drop("size")
    keys = ["band", "key", "a", "b"]
    return (members.join(classes.select("id", "n", "sketch"), "id").repartition(*keys).sortWithinPartitions(*keys, "id")
            .mapInArrow(link, "u long, v long"))


def _intersections(rows: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted distinct arrays, by products of incidence blocks."""
    n = len(rows)
    if n == 2:
        return np.array([[0, len(np.intersect1d(rows[0], rows[1], assume_unique=True))]] * 2)
    values = np.concatenate(rows)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    place, of = place[shared], of[shared]
    order = np.argsort(place, kind="stable")
    place, of = place[order], of[order]
    place = np.cumsum(np.concatenate(([0], place[1:] != place[:-1]))) if len(place) else place
    total = np.zeros((n, n), np.float64)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [low, low + COLUMNS])
        block = np.zeros((n, COLUMNS), np.float32)
        block[of[a:b], place[a:b] - low] = 1
        total += block @ block.T
    return total.astype(np.int64)


def link_forest(members: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """u, v: spanning forests of the pairs within a component whose full sets reach the threshold.

    ``members``: id, component, size (rows of the component), k1, k2 of the row whose text stands for the class.
    """
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [own.tobytes() for part in slices(batch.column("text")) for own in shingles(part.lowered(), width)]
            keep = [batch.column(k) for k in ("component", "a", "b", "_own", "id")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(full, pa.binary())], names=["component", "a", "b", "_own", "id", "hashes"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["component", "a", "b"], rows=2000):
            comp, a, b, own, ids = (table[k].to_numpy() for k in ("component", "a", "b", "_own", "id"))
            rows = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
            sizes = np.array([len(r) for r in rows])
            first = starts_of(comp, a, b)
            lefts, rights = [], []
            for s, e in zip(first, np.append(first[1:], len(ids))):
                common = _intersections(rows[s:e]) if e - s > 1 else np.zeros((1, 1), np.int64)
                union = sizes[s:e, None] + sizes[None, s:e] - common
                i, j = np.nonzero(np.triu(100 * common >= percent * union, 1))
                lefts.append(i + s)
                rights.append(j + s)
            yield _edges(ids, forest(len(ids), np.concatenate(lefts), np.concatenate(rights)))

    texts = docs.select(*_row_key(id_col, text_col), F.col(text_col).alias("text"))
    keys = ["component", "a", "b"]
    # rows that repeat id and text are one again: the join has sorted them together
    wanted = texts.join(stage(members, "members").hint("merge"), ["k1", "k2"]).groupBy("k1", "k2", "id", "component", "size").agg(F.first("text").alias("text"))
    with_sets = _chunk_sets(wanted, sets)
    return with_sets.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(link, "u long, v long")


def _chunk_sets(wanted: DataFrame, sets) -> DataFrame:
    """Hash the texts once, then deal the sets to the pairs of chunks."""
    schema = "component long, a long, b long, _own long, id long, hashes binary"
    plain = wanted.select("component", F.col("size").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("_own"), "id", "text")
    hashed = plain.mapInArrow(sets, schema).select("component", F.col("a").alias("size"), "id", "hashes")
    return _chunked(hashed, "size").drop("size")


def _grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k1, k2, n_shingles, component_id, stands: every row with its component and whether it stands for it."""
    bound_batches(docs.sparkSession)
    rows = sketch_table(docs, width, id_col, text_col)
    # Classes of equal sets are numbered; ids, which may be null or repeat, come in at the end only.
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "k1", "k2")
    classes = stage(rows.filter("n_shingles > 0").groupBy("digest")
                    .agg(F.min(row).alias("row"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
                    .withColumn("id", F.monotonically_increasing_id()), "classes")
    near = components(stage(candidate_forest(classes, percent / 100), "near"))
    sizes = near.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    standing = classes.select("id", "row.k1", "row.k2")
    members = near.withColumnRenamed("node", "id").join(stage(sizes, "sizes"), "component").join(standing, "id")
    linked = components(stage(link_forest(members, docs, width, percent, id_col, text_col), "links"))
    placed = classes.select("digest", "id", "row").join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = stage(placed, "class-components")
    least = placed.groupBy("component").agg(F.min("row").alias("least"))
    of_class = placed.join(least, "component").select("digest", F.lit(True).alias("_known"), "least")
    joined = rows.join(of_class, "digest", "left")
    own = (F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2"))
    return joined.select("doc_id", "k1", "k2", "n_shingles", F.when(F.col("_known"), F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                         F.when(F.col("_known"), own).otherwise(True).alias("stands"))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of other than ASCII white space after lower-casing A-Z; a document
    with fewer than ``width`` words is one shingle, one without words (null, empty)
    links with nothing. Documents link at ``100 * intersection >= percent * union``;
    component_id is the smallest doc_id reachable. Copies of a set share its class.
    The chance to miss a link is that of sharing no band: 6e-11 at 0.85, 5e-8 at 0.8.
    A null id comes after all others: it names a component only where all its ids are
    null, and then the row that stands for it is kept. Rows that repeat an id may be in
    different components by their texts. An empty table gives an empty result. Texts of
    any length are whole sets. Other columns are ignored.
    """
    rows = _grouped(docs, width, percent, id_col, text_col)
    return rows.select("doc_id", "n_shingles", "component_id", F.when(F.col("component_id").isNull(), F.col("stands"))
                       .otherwise(F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("kept"))


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns.

    The row with the smallest id stands for a group, of several texts with that id the one
    with the smallest hash; rows that repeat id and text stay or go together.
    """
    stays = stage(_grouped(docs, width, percent, "doc_id", "text").filter("stands").select(F.col("k1").alias("_s1"), F.col("k2").alias("_s2")).distinct(), "near-stay")
    whole = docs.select(F.struct("*").alias("_whole"), *_row_key("doc_id", "text"))
    return whole.join(stays.hint("merge"), (F.col("k1") == F.col("_s1")) & (F.col("k2") == F.col("_s2")), "left_semi").select("_whole.*")
