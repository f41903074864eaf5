"""How filters interact, for every order in which they could run.

A document is judged once: a mask tells which of five filters it fails. Documents
are counted per (part, mask), 32 cells whatever the size of a part. A Gray code
then walks through all subsets of filters, toggling one filter a step. Every cell
keeps the number of active filters it fails, so a step adds or takes the cells
that the toggled filter alone decides. The 32 survivor counts give each step of
each order as a difference of two states.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelab.llm.batches import bound_batches
from choicelab.llm.text import slices
from choicelab.staging import stage

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
MARKS = b"#$%&*|"

_COPY = 1 << FILTERS.index("E")
_UPPER = bytes(range(65, 91))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_PIECE = 1 << 20
_PARTS = 64
_ORDERS = list(permutations(range(len(FILTERS))))


def word_counts(raw: bytes) -> tuple[int, int]:
    """Words and distinct words; of a long text only the distinct words are held."""
    if len(raw) <= _PIECE:
        found = raw.split()
        return len(found), len(set(found))
    count, seen = 0, set()
    for match in _WORD.finditer(raw):
        count += 1
        seen.add(match.group())
    return count, len(seen)


def failures(raw: bytes, points: int) -> int:
    """Mask of the filters that look at one text only: bit 0 is A, bit 3 is D."""
    words, distinct = word_counts(raw)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    marked = len(raw) != len(raw.translate(None, MARKS))
    return ((words < MIN_WORDS) | (100 * distinct < MIN_DISTINCT_PERCENT * words) << 1
            | (100 * upper > MAX_UPPER_PERCENT * points) << 2 | marked << 3)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
        for piece in slices(batch.column(2)):
            texts = piece.texts()
            last = piece.first + len(texts)
            masks = [failures(raw, n) for raw, n in zip(texts, points[piece.first:last])]
            digests = [hashlib.sha256(raw).digest() for raw in texts]
            yield pa.record_batch([batch.column(0).slice(piece.first, len(texts)), batch.column(1).slice(piece.first, len(texts)),
                                   pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents of every part and failure mask that occurs.

    Whole texts are read once; from then on a row is an id, a part, a mask and a
    digest. Equal rows are counted together before any join, so neither a large
    group of copies nor a repeated id gathers in one task.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    judged = rows.mapInArrow(_judged, "doc_id long, part string, mask int, digest binary")
    counted = judged.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = stage(counted.join(known, F.col("doc_id") == F.col("_labelled"), "left")
                 .select("digest", "doc_id", "part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")), "audit-rows")
    # A text's rows are matched by digest and id, so its copies are spread over all tasks.
    first = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"))
    marked = rows.join(first, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_first")), "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("_first").isNull(), _COPY).otherwise(0)
    return marked.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def gray_states(cells: np.ndarray) -> np.ndarray:
    """``states[part, subset]`` from ``cells[part, mask]``: what no filter of the subset removes.

    One filter is toggled a step, the one that the reflected Gray code changes.
    """
    masks = np.arange(SUBSETS)
    failed = np.zeros(SUBSETS, int)  # active filters that a cell fails
    alive = cells.sum(axis=1)
    states = np.zeros_like(cells)
    states[:, 0] = alive
    active = 0
    for step in range(1, SUBSETS):
        toggled = step & -step
        hit = masks & toggled != 0
        if active & toggled:
            failed[hit] -= 1
            alive = alive + cells[:, hit & (failed == 0)].sum(axis=1)
        else:
            alive = alive - cells[:, hit & (failed == 0)].sum(axis=1)
            failed[hit] += 1
        active ^= toggled
        states[:, active] = alive
    return states


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = np.array(_ORDERS)
    steps = orders.shape[1]
    after = np.cumsum(1 << orders, axis=1)
    before = after - (1 << orders)
    names = np.array(["".join(FILTERS[f] for f in order) for order in _ORDERS])
    everything = SUBSETS - 1
    for batch in batches:
        for at in range(0, batch.num_rows, _PARTS):
            some = batch.slice(at, _PARTS)
            cells = np.zeros((some.num_rows, SUBSETS, 3), np.int64)
            for p, listed in enumerate(some.column(1).to_pylist()):
                for cell in listed:
                    cells[p, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
            states = gray_states(cells)
            lost = states[:, before] - states[:, after]  # part, order, step, count
            removed = lost[..., 0]
            fails = np.stack([states[:, 0, 0] - states[:, 1 << f, 0] for f in range(steps)], axis=1)
            only = np.stack([states[:, everything ^ (1 << f), 0] - states[:, everything, 0] for f in range(steps)], axis=1)
            by_filter = np.stack([(removed * (orders == f)).sum(axis=(1, 2)) for f in range(steps)], axis=1)
            rows = removed.size
            columns = {
                "part": pa.array(np.repeat(some.column(0).to_numpy(zero_copy_only=False), orders.size), pa.string()),
                "filter_order": pa.array(np.tile(np.repeat(names, steps), some.num_rows), pa.string()),
                "step": pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), rows // steps)),
                "kept": states[:, after, 0], "removed": removed, "redundant": fails[:, orders] - removed, "unique_fails": only[:, orders],
                "good_lost": lost[..., 1], "toxic_lost": lost[..., 2], "shapley": by_filter[:, orders]}
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c.reshape(-1)) for c in columns.values()], list(columns))


_REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
           "good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step of that order.

    Filters: A under 50 words, B few distinct words, C many capitals, D special
    marks, E equal to the text of a smaller id. Null text is empty, a null source is
    the part ''. A null id is neither smaller nor larger than another, so its row
    never fails E and has no labels; rows that repeat the smallest id of a text all
    pass E. A document counts as good or toxic when any of its label rows says so. An
    empty table has no parts and gives no rows. Other columns are ignored. Texts are
    equal when their SHA-256 digests are.
    """
    cells = mask_cells(docs, labels, id_col, text_col, source_col)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 cells at most
    return parts.mapInArrow(_reports, _REPORT)


_BITS = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(FILTERS))
_LETTERS = ", ".join(f"l{i}" for i in range(len(FILTERS)))
_DIFFERENT = " AND ".join(f"l{i}.bit <> l{j}.bit" for i in range(len(FILTERS)) for j in range(i))

SQL = f"""
    WITH letters(letter, bit) AS (VALUES {_BITS}),
    steps AS (SELECT {' || '.join(f'l{i}.letter' for i in range(len(FILTERS)))} AS filter_order, unnest(range(1, {len(FILTERS) + 1})) AS step,
                     [{', '.join(f'l{i}.bit' for i in range(len(FILTERS)))}] AS bits
              FROM {', '.join(f'letters l{i}' for i in range(len(FILTERS)))} WHERE {_DIFFERENT}),
    staged AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM steps),
    texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    masks AS (SELECT doc_id, part, (len(words) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words))::INT
                     + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > {MAX_UPPER_PERCENT} * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
                     + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM texts),
    known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask),
    counts AS (SELECT part, filter_order, step, bit,
                      coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
                      coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
                      coalesce(sum(n) FILTER (mask & earlier <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
                      coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                      coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
                      coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
               FROM cells, staged GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counts"""
