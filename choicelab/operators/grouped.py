"""Groups within Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def group_codes(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of each group of a batch, and the number of each row's group; null is a key like any other."""
    codes = np.zeros(rows, np.int64)
    for column in columns:
        named = pc.dictionary_encode(column, null_encoding="encode")
        codes = codes * max(1, len(named.dictionary)) + named.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]  # small again, so that products cannot overflow
    _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    return first, inverse


def group_rows(columns: list[pa.Array], rows: int) -> dict[tuple, np.ndarray]:
    """Key -> row numbers of a batch; null is a key like any other, and without columns all rows are one group."""
    if not columns:
        return {(): np.arange(rows)}
    first, inverse = group_codes(columns, rows)
    order = np.argsort(inverse, kind="stable")
    ends = np.searchsorted(inverse[order], np.arange(len(first) + 1))
    keys = zip(*(column.take(pa.array(first)).to_pylist() for column in columns))
    return {key: order[ends[i]:ends[i + 1]] for i, key in enumerate(keys)}
