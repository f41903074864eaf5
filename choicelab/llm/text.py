"""Words and hashes of whole texts, computed on the UTF-8 bytes of an Arrow column.

A batch is cut into slices of a few megabytes, so memory does not depend on the
batch; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit words over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        factor = np.full(n, base, np.uint64)
        factor[0] = 1
        _powers[base] = np.cumprod(factor, dtype=np.uint64)
    return _powers[base]


@dataclass
class Slice:
    """Bytes of some texts: text ``t`` of the slice is ``data[offsets[t]:offsets[t + 1]]``."""

    first: int
    offsets: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())]

    def lowered(self) -> Slice:
        """With A-Z in lower case and nothing else changed."""
        return Slice(self.first, self.offsets, _LOWER[self.data])


@dataclass
class Words:
    """Byte ranges of the words of a slice and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column (null: empty), whole, in slices of about ``most`` bytes."""
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    _, where, values = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(where, width)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield Slice(at, offsets[at:to + 1] - offsets[at], data[offsets[at]:offsets[to]])
        at = to


def words(part: Slice) -> Words:
    """Runs of bytes other than space and \\t \\n \\v \\f \\r."""
    solid = ~_SPACE[part.data]
    n = len(solid)
    edge = part.offsets[:-1][part.offsets[:-1] < n]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    before[edge] = False
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    inner = edge[edge > 0] - 1
    after[inner] = False
    starts = np.flatnonzero(solid & ~before)
    return Words(starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, part.offsets))


class RangeHasher:
    """64-bit hashes of byte ranges from one prefix sum over the slice; other odd bases give independent ones."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        n = len(data)
        self._down = _power(pow(base, -1, 1 << 64), n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(base, n + 1)[:n], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inside = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(inside + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(part: Slice, width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A text with fewer words is one shingle; without words the array is empty.
    """
    found = words(part)
    hashed = RangeHasher(part.data)(found.starts, found.ends)
    n = len(hashed)
    salts = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    joined = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        joined += hashed[k:k + len(joined)] * salts[k]
    joined = mix(joined)
    for a, b in zip(found.first[:-1], found.first[1:]):
        if b - a >= width:
            own = np.sort(joined[a:b - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            few = np.cumsum(hashed[a:b] * salts[:b - a])[-1:]
            yield mix(few + np.full(1, (b - a) * 0x24BAED4963EE407, np.uint64))
        else:
            yield np.zeros(0, np.uint64)
