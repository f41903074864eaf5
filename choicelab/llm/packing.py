"""Best-fit packing of tokenised documents into sequences of fixed capacity.

The number of pieces of each length is all a packing depends on, so the plan is
made from that histogram: at most ``capacity`` counts, whatever the size of the
corpus. Pieces above a third of the capacity are matched greedily, two in a bin
at most, each with the fullest bin that takes it; smaller ones then fill the
tightest gaps. The plan says which ranks of a length go to which bins, and
pieces find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelab.llm.batches import bound_batches
from choicelab.llm.prefix import random_key, running_sums
from choicelab.llm.text import RangeHasher, Slice, slices
from choicelab.staging import stage

CAPACITY = 2048
END = 0
#: Slots for kept words; half of them are filled at most.
SLOTS = 1 << 21
LINE_WORDS = 50
CHECK_BASE = 0xC2B2AE3D27D4EB4F
_BLANK, _MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[10, 32]] = _MARK[[44, 46]] = _PLAIN[48:58] = _PLAIN[97:123] = True
_encoders: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts for a tokenizer whose tokens never span white space.

    It lower-cases, and a run of letters or of marks is tokenised by itself. So distinct
    words, without a last full stop or comma, are encoded once and kept while they fit. Words
    are told apart by two 64-bit hashes. This changes nothing but the time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        [self._stop] = self._tokenizer.encode(".", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self._keys, self._checks = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self._word = np.zeros(SLOTS, np.int32)
        self._first, self._size, self._pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; those of letters only go as lines with a full stop after each word."""
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        lines = [" . ".join(words[k] for k in plain[at:at + LINE_WORDS]) + " ." for at in range(0, len(plain), LINE_WORDS)]
        out: list[np.ndarray] = [None] * len(words)
        if lines:
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            for k, part in zip(plain, np.split(ids, np.flatnonzero(ids == self._stop) + 1)):
                out[k] = part[:-1]
        odd = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(odd, self._tokenizer.encode_batch_fast([words[k] for k in odd], add_special_tokens=False)):
            out[k] = np.array(e.ids, np.uint32)
        return out

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Numbers of known words, -1 for others: open addressing, all words at a time."""
        found = np.full(len(keys), -1, np.int64)
        open_, slot = np.arange(len(keys)), (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(open_):
            held = self._keys[slot]
            hit = (held == keys[open_]) & (self._checks[slot] == checks[open_])
            found[open_[hit]] = self._word[slot[hit]]
            on = ~hit & (held != 0)
            open_, slot = open_[on], (slot[on] + 1) & (SLOTS - 1)
        return found

    def _learn(self, keys: np.ndarray, checks: np.ndarray, words: list[str]) -> None:
        ids = self._encode_words(words)
        sizes = np.array([len(x) for x in ids], np.int64)
        number = len(self._first) + np.arange(len(words))
        self._first = np.concatenate([self._first, len(self._pool) + np.cumsum(sizes) - sizes])
        self._size = np.concatenate([self._size, sizes])
        self._pool = np.concatenate([self._pool, *ids])
        open_, slot = np.arange(len(keys)), (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(open_):
            free = self._keys[slot] == 0
            self._word[slot[free]] = -1 - number[open_[free]]  # of those that want one slot the last stays
            mine = free & (self._word[slot] == -1 - number[open_])
            at, own = slot[mine], open_[mine]
            self._keys[at], self._checks[at], self._word[at] = keys[own], checks[own], number[own]
            open_, slot = open_[~mine], (slot[~mine] + 1) & (SLOTS - 1)

    def encode(self, part: Slice) -> list[np.ndarray]:
        """Ids of each text of a slice."""
        data = part.lowered().data
        starts, ends, text = self._words(data, part.offsets)
        keys = RangeHasher(data)(starts, ends) | np.uint64(1 << 63)  # no key is 0
        checks = RangeHasher(data, CHECK_BASE)(starts, ends)
        found = self._find(keys, checks)
        new = np.flatnonzero(found < 0)
        if len(new):
            if 2 * (len(self._first) + len(new)) > SLOTS:
                self._forget()
                new = np.arange(len(keys))
            _, one = np.unique(keys[new] + checks[new] * np.uint64(CHECK_BASE), return_index=True)
            one = new[one]
            raw = data.tobytes()
            self._learn(keys[one], checks[one], [raw[a:b].decode() for a, b in zip(starts[one].tolist(), ends[one].tolist())])
            found[new] = self._find(keys[new], checks[new])
        sizes = self._size[found]
        upto = np.cumsum(sizes)
        ids = self._pool[np.repeat(self._first[found] - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]
        cuts = np.concatenate([[0], upto])[np.searchsorted(text, np.arange(len(part) + 1))]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for k, raw in enumerate(part.texts()):
            if b"<|" in raw:  # special tokens are spelled in lower case only, so the text is encoded as it is
                out[k] = np.array(self._tokenizer.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)
        return out

    @staticmethod
    def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of runs between blanks and line ends.

        A full stop or comma that ends a run after an ASCII letter or digit is a word by itself.
        """
        solid = ~_BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
        ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
        cut = _MARK[data[ends - 1]] & (ends - starts > 1) & _PLAIN[data[np.maximum(ends - 2, 0)]]
        marks = ends[cut] - 1
        ends = ends - cut
        order = np.argsort(np.concatenate([starts, marks]), kind="stable")
        starts, ends = np.concatenate([starts, marks])[order], np.concatenate([ends, marks + 1])[order]
        return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with the end id."""
    end = np.array([END], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(tokenizer)
        encoder = _encoders[tokenizer]
        for batch in batches:
            of, nth, sizes, sums = [], [], [], []
            for part in slices(batch.column(1)):
                for k, ids in enumerate(encoder.encode(part), part.first):
                    ids = np.concatenate([ids, end]).astype("<u4", copy=False)
                    for at in range(0, len(ids), capacity):
                        piece = ids[at:at + capacity]
                        of.append(k)
                        nth.append(at // capacity)
                        sizes.append(len(piece))
                        sums.append(zlib.crc32(piece.tobytes()))
            nth = np.array(nth, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(nth), pa.array(nth.astype(np.int64) * capacity),
                 pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins as runs of consecutive numbers, by the room left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self._runs: dict[int, deque[tuple[int, int]]] = {}
        self._gaps: list[int] = []

    def _open(self, gap: int, first: int, bins: int) -> None:
        if bins and gap:
            if gap not in self._runs:
                insort(self._gaps, gap)
                self._runs[gap] = deque()
            self._runs[gap].append((first, bins))

    def _take(self, length: int) -> tuple[int, int, int] | None:
        """A run of bins with the smallest room that suffices."""
        at = bisect_left(self._gaps, length)
        if at == len(self._gaps):
            return None
        gap = self._gaps[at]
        first, bins = self._runs[gap].popleft()
        if not self._runs[gap]:
            del self._runs[gap], self._gaps[at]
        return gap, first, bins

    def place(self, length: int, items: int) -> Iterator[tuple[int, int, int, int]]:
        """(first rank, ranks, first bin, offset) for ``items`` pieces of one length: each to the tightest bin."""
        rank = 0
        while rank < items:
            found = self._take(length)
            if found is None:
                fresh = -(-(items - rank) // (self.capacity // length))
                found = (self.capacity, self.count, fresh)
                self.count += fresh
            gap, first, bins = found
            each = gap // length  # a bin stays the tightest until it is full for this length
            whole = min(bins, (items - rank) // each)
            for k in range(each if whole else 0):
                yield rank, whole, first, self.capacity - gap + k * length
                rank += whole
            self._open(gap - each * length, first, whole)
            over = items - rank
            if whole < bins and over < each:
                for k in range(over):
                    yield rank, 1, first + whole, self.capacity - gap + k * length
                    rank += 1
                self._open(gap - over * length, first + whole, 1 if over else 0)
                self._open(gap, first + whole + (1 if over else 0), bins - whole - (1 if over else 0))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, np.ndarray], int]:
    """Per length its (first rank, first bin, offset) rows by rank, and the number of bins."""
    bins = Bins(capacity)
    large = [n for n in histogram if 3 * n > capacity]
    small = [n for n in histogram if 3 * n <= capacity]
    placed = {}
    for lengths in (large, small):  # the matching of large pieces comes first, then the gaps
        for length in sorted(lengths, reverse=True):
            placed[length] = np.array([(r, b, o) for r, _, b, o in bins.place(length, histogram[length])], np.int64)
    return placed, bins.count


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A document is its ids and the end id; null text is empty and gives the end id
    alone. Longer ones are cut at multiples of the capacity. Every piece is in one
    sequence, and a sequence's pieces follow each other without a gap. Rows that
    repeat a document are packed each. An empty table gives an empty result. Other
    columns are ignored. The tokenizer must not join tokens over white space.
    """
    rows = stage(pieces(docs, tokenizer or default_tokenizer(), capacity, id_col, text_col)
                 .withColumn("_key", random_key(F.col("doc_id"), F.col("piece"), F.monotonically_increasing_id())), "pieces")
    counts = stage(rows.groupBy("length").agg(F.count(F.lit(1)).alias("rows")), "piece-lengths")
    placed, _ = plan({r["length"]: r["rows"] for r in counts.collect()}, capacity)  # at most ``capacity`` rows
    ranked = running_sums(rows.join(counts, "length").withColumn("_one", F.lit(1)), "length", "rows", "_key", "_one", ["doc_id", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                rules = placed[int(length)]
                rule = rules[np.searchsorted(rules[:, 0], ranks[here], "right") - 1]
                sequence[here] = rule[:, 1] + ranks[here] - rule[:, 0]
                offset[here] = rule[:, 2]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return (ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("before").cast("long").alias("before"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
