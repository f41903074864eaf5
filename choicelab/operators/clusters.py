"""Cluster-based permutation test over channel x time maps.

Signs of the subjects are a hash of (seed, permutation, subject), so every
executor, and any other engine, derives the same permutation. Flipping signs leaves the
sum of squares as it is, so a block of permutations is one matrix product of signs and
slopes per channel, added up subject by subject. Only points above the threshold leave
that task, as one row per permutation and channel; the clusters of a permutation are
then joined on the lattice of channels and samples inside one task.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from choicelab.operators.joins import attach
from choicelab.operators.ranking import col
from choicelab.staging import stage

BLOCK = 256
FLAT = 1e-12  # share of the mean square below which subjects do not differ


def sign_of(seed: int, perm: Column, subject: Column) -> Column:
    """+1 or -1 by the first digit of an MD5; permutation 0 is the observed data."""
    digit = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), perm.cast("string"), subject.cast("string"))), 1, 1)
    return F.when(perm == 0, 1.0).when(digit < "8", 1.0).otherwise(-1.0)


def sign_blocks(subjects: DataFrame, n_perm: int, seed: int, subject: str = "participant", block: int = BLOCK) -> DataFrame:
    """subject, ``_block``, ``_signs``: the signs of a block of permutations as a text of + and -."""
    blocks = F.sequence(F.lit(0), F.lit((n_perm - 1) // block))
    numbered = subjects.select(col(subject)).distinct().withColumn("_block", F.explode(blocks))
    perms = F.sequence(F.col("_block") * block, F.least((F.col("_block") + 1) * block, F.lit(n_perm)) - 1)
    signs = F.transform(perms, lambda perm: F.when(sign_of(seed, perm, col(subject)) > 0, "+").otherwise("-"))
    return numbered.withColumn("_signs", F.array_join(signs, ""))


class _Maps:
    """Sums of signed slopes of one channel and block, grown subject by subject and sample by sample."""

    def __init__(self, perms: int):
        self.places: dict[int, int] = {}
        self.sums, self.count, self.squares = np.zeros((perms, 0)), np.zeros(0), np.zeros(0)

    def add(self, signs: np.ndarray, times: list[np.ndarray], values: list[np.ndarray]) -> None:
        new = [t for t in dict.fromkeys(np.concatenate(times).tolist()) if t not in self.places]
        if new:
            self.places.update({t: len(self.places) + i for i, t in enumerate(new)})
            self.sums = np.pad(self.sums, ((0, 0), (0, len(new))))
            self.count, self.squares = np.pad(self.count, (0, len(new))), np.pad(self.squares, (0, len(new)))
        rows = np.zeros((len(times), len(self.places)))
        for i, (t, v) in enumerate(zip(times, values)):
            at = [self.places[x] for x in t.tolist()]
            rows[i, at] = v
            self.count[at] += 1
        self.sums += signs.T @ rows
        self.squares += (rows ** 2).sum(axis=0)

    def t_values(self) -> tuple[np.ndarray, np.ndarray]:
        """Samples in order and t per permutation and sample; NaN where subjects do not differ."""
        times = np.array(list(self.places), dtype=np.int64)
        order = np.argsort(times)
        n, squares = self.count[order], self.squares[order]
        with np.errstate(all="ignore"):
            mean = self.sums[:, order] / n
            spread = squares - n * mean * mean
            t = mean / np.sqrt(spread / (n - 1) / n)
        return times[order], np.where((n > 1) & (spread > FLAT * squares), t, np.nan)


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Stretches of equal keys of sorted batches, and whether the key begins there."""
    last: tuple | None = None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
        at = 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            yield keys[at], batch.slice(at, to - at), keys[at] != last
            last = keys[at]
            at = to


def _strong(n_by: int, schema: pa.Schema, block: int, threshold: float) -> Callable:
    """Task: per permutation and channel the samples above the threshold, and the observed map."""
    def rows_of(key: tuple, maps: _Maps) -> pa.RecordBatch | None:
        times, t = maps.t_values()
        *by, channel, number = key
        rows = []
        if number == 0:
            known = ~np.isnan(t[0])
            rows.append((*by, channel, 0, True, times[known], t[0][known]))
        with np.errstate(invalid="ignore"):
            strong = np.abs(t) > threshold
        rows += [(*by, channel, number * block + p, False, times[strong[p]], t[p][strong[p]]) for p in np.flatnonzero(strong.any(axis=1)).tolist()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple, _Maps] | None = None
        for key, part, begins in _runs(batches, n_by + 2):
            if begins:
                if held and (done := rows_of(*held)):
                    yield done
                held = key, _Maps(len(part.column(n_by + 2)[0].as_py()))
            signs = np.array([np.frombuffer(s.encode(), np.uint8) for s in part.column(n_by + 2).to_pylist()]) == ord("+")
            times = [np.asarray(x, dtype=np.int64) for x in part.column(n_by + 3).to_pylist()]
            values = [np.asarray(x, dtype=float) for x in part.column(n_by + 4).to_pylist()]
            held[1].add(np.where(signs, 1.0, -1.0), times, values)
        if held and (done := rows_of(*held)):
            yield done
    return run


def strong_points(betas: DataFrame, n_perm: int, seed: int, threshold: float, by: list[str], subject: str, channel: str,
                  time: str, value: str, block: int = BLOCK) -> DataFrame:
    """by, channel, ``perm``, ``observed``, ``times``, ``ts``: a row per permutation and channel with points above the
    threshold, and one ``observed`` row per channel with the whole map; staged.

    A task reads the subjects of one channel and block of permutations as a stream and
    holds one matrix of permutations x samples.
    """
    known = betas.filter(col(value).isNotNull())
    course = F.sort_array(F.collect_list(F.struct(col(time).cast("long").alias("t"), col(value).cast("double").alias("b"))))
    rows = known.groupBy(*map(col, by), col(channel), col(subject)).agg(course.alias("_course"))  # one epoch long
    signed = attach(rows, sign_blocks(known, n_perm, seed, subject, block), [subject], "inner")
    keys = [*map(col, by), col(channel), F.col("_block")]
    dealt = signed.select(*keys, "_signs", F.col("_course.t").alias("_t"), F.col("_course.b").alias("_b")).repartition(*keys).sortWithinPartitions(*keys)
    out = T.StructType([*[betas.schema[k] for k in by], betas.schema[channel], *T.StructType.fromDDL(
        "perm int, observed boolean, times array<bigint>, ts array<double>")])
    return stage(dealt.mapInArrow(_strong(len(by), to_arrow_schema(out), block, threshold), out), "strong")


def lattice_clusters(points: list[tuple[Hashable, int, float]], near: dict[Hashable, list]) -> list[int]:
    """Cluster number of every (channel, sample, t): neighbouring samples of a channel and equal
    samples of adjacent channels belong together where t has the same sign."""
    place = {(channel, time, t > 0): i for i, (channel, time, t) in enumerate(points)}
    root = list(range(len(points)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (channel, time, sign), i in place.items():
        for other in ((channel, time + 1, sign), *((c, time, sign) for c in near.get(channel, ()))):
            j = place.get(other)
            if j is not None:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def _clustered(n_by: int, schema: pa.Schema) -> Callable:
    """Task: the largest mass of every permutation, and the clusters of the observed map."""
    def row_of(key: tuple, points: list, near: dict) -> tuple:
        points = sorted(points, key=lambda p: (str(p[0]), p[1]))
        labels = lattice_clusters(points, near)
        masses: dict[int, float] = {}
        for label, (_, _, t) in zip(labels, points):
            masses[label] = masses.get(label, 0.0) + t
        # rounded, so that equal permutations compare as equal whatever the order of summation
        masses = {label: round(m, 9) for label, m in masses.items()}
        found = [{"channel": c, "time": t, "cluster": label, "mass": masses[label]} for label, (c, t, _) in zip(labels, points)]
        return (*key, max(map(abs, masses.values())), found if key[-1] == 0 else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, points, near, rows = None, [], {}, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for now, part, begins in _runs(batches, n_by + 1):
            if begins:
                if points:
                    rows.append(row_of(key, points, near))
                if len(rows) >= 1000:
                    yield batch_of(rows)
                    rows = []
                key, points, near = now, [], {}
            for channel, times, ts, others in zip(*(part.column(n_by + 1 + j).to_pylist() for j in range(4))):
                points += [(channel, time, t) for time, t in zip(times, ts)]
                near[channel] = others or []
        if points:
            rows.append(row_of(key, points, near))
        if rows:
            yield batch_of(rows)
    return run


def cluster_permutation(betas: DataFrame, edges: DataFrame, n_perm: int, seed: int, threshold: float,
                        subject: str = "participant", channel: str = "channel", time: str = "t_idx",
                        value: str = "beta", by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """t and cluster p-value of every point, for every group of ``by`` (such as the regressor).

    ``edges`` lists adjacent channels once, ``threshold`` is a t value (see
    ``t_critical``). The mass of a cluster is the sum of its t. p is the share of
    permutations, the observed one included, whose largest absolute mass reaches
    that of the cluster; points outside clusters get 1.
    """
    by = list(by)
    maps = strong_points(betas, n_perm, seed, threshold, by, subject, channel, time, value, block)
    both = edges.select(F.col("channel_a").alias(channel), F.col("channel_b").alias("_other"))
    both = both.unionByName(edges.select(F.col("channel_b").alias(channel), F.col("channel_a").alias("_other")))
    near = both.groupBy(col(channel)).agg(F.collect_set("_other").alias("_near"))
    keys = [*map(col, by), F.col("perm")]
    strong = attach(maps.filter(~F.col("observed")), near, [channel]).select(*keys, col(channel), "times", "ts", "_near")
    kind = T.StructType([betas.schema[channel]])[0].dataType
    point = T.StructType([T.StructField("channel", kind), *T.StructType.fromDDL("time bigint, cluster int, mass double")])
    out = T.StructType([*[betas.schema[k] for k in by], *T.StructType.fromDDL("perm int, largest double"), T.StructField("points", T.ArrayType(point))])
    # the points of one permutation: at most one lattice
    clustered = stage(strong.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_clustered(len(by), to_arrow_schema(out)), out), "clusters")
    # one number per permutation
    largest = clustered.groupBy(*map(col, by)).agg(F.collect_list("largest").alias("_largest"))
    observed = clustered.filter("perm = 0").select(*map(col, by), F.inline("points"))
    masses = observed.select(*map(col, by), "cluster", "mass").distinct()
    joined = attach(masses, largest, by) if by else masses.join(largest)  # one row
    tested = joined.withColumn("p", F.size(F.filter("_largest", lambda x: x >= F.abs("mass"))) / F.lit(n_perm))
    found = observed.join(tested.select(*map(col, by), "cluster", "p"), [*by, "cluster"]).select(
        *map(col, by), F.col("channel").alias(channel), F.col("time").cast(betas.schema[time].dataType).alias(time), "p", "mass")
    course = maps.filter("observed").select(*map(col, by), col(channel), F.inline(F.arrays_zip(F.col("times").alias("_t"), F.col("ts").alias("t"))))
    course = course.select(*map(col, by), col(channel), F.col("_t").cast(betas.schema[time].dataType).alias(time), "t")
    return attach(course, found, [*by, channel, time]).withColumn("p", F.coalesce("p", F.lit(1.0)))
