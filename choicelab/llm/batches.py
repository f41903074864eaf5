"""Arrow batches: bounded input, and whole groups of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Let Spark hand texts to Python in batches of bounded bytes, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by ``keys``.

    Callers bound the size of a group; a table holds about ``rows`` rows and one group more.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(starts_of(*(table[k].to_numpy() for k in keys))[-1])
        if cut:
            yield table.slice(0, cut)
        held, count = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()
