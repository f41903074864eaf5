"""Repeated passages by content-defined chunks.

A gear hash rolls over the bytes, and a chunk ends where the hash is smallest
among REACH bytes on either side; in text that repeats itself, once in a period
at most. Ends depend on the bytes around them only, so
inserted text moves no other end and a passage is cut alike wherever it stands.
Chunks are compared by digest. Runs of chunks that occur in other documents are
then grown word by word as far as any other document with the same chunk agrees, and
passages with more than ``most_words`` words are reported, in parts by the document
that has them first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelab.llm.batches import bound_batches, starts_of, whole_groups
from choicelab.llm.text import RangeHasher, Slice, mix, slices
from choicelab.staging import drop_path, scratch_path, stage

#: Bytes that the hash rolls over, and bytes on either side that an end is compared with.
WINDOW = 16
REACH = 24
PAD = 32
SPACING = 16
#: Bytes beside a run in text that repeats itself; elsewhere the neighbouring chunk tells how many are compared.
AROUND = 512
#: Reach is kept in units of so many bytes: few different values, which compress well in the largest table.
UNIT = 16
REACH_BITS = 24
#: Words in reach from this number on are not told apart; the run counts as long enough.
MANY = 127
#: Words after which fewer occurrences go on; further rounds are each this many times as long.
WORD_STEPS = (0, 1, 4, 16, 256)
GROWTH = 16
#: Whole chunks with this share of ``most_words`` tell a part's source: a passage cuts some of its words off at its ends.
WINDOW_SHARE = 0.6
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CONTINUED = bytes(range(0x80, 0xC0))


def _brief(df: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """A staged table and the call that deletes it, for when all that reads it is staged itself."""
    path = scratch_path(df.sparkSession, label)
    return stage(df, label, path), lambda: drop_path(df.sparkSession, path)


def _least(values: np.ndarray, length: int) -> np.ndarray:
    """Minimum of the ``length`` values from each position on, the end counting as the largest value."""
    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([x[by:], np.full(min(by, len(x)), np.iinfo(x.dtype).max, x.dtype)])

    out, have = values, 1
    while have < length:
        by = min(have, length - have)
        out = np.minimum(out, ahead(out, by))
        have += by
    return out


def _spaced(ends: np.ndarray) -> np.ndarray:
    """Without ends closer than SPACING to the one kept before; only text that repeats itself has such."""
    if not len(ends) or np.diff(ends).min(initial=SPACING) >= SPACING:
        return ends
    kept = [ends[0]]
    for end in ends.tolist():
        if end - kept[-1] >= SPACING:
            kept.append(end)
    return np.array(kept)


def _fringe(size: np.ndarray, words: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How far a run may grow over a neighbour of ``size`` bytes, in units, and in the upper bits the words that begin there (MANY: or more).

    A longer gain would hold the neighbouring chunk, of any length; in text that repeats itself ends are less certain.
    """
    units = np.where(size < 2 * SPACING, AROUND // UNIT, -(-(size + 2 * PAD) // UNIT))
    return units + (np.minimum(words(units * UNIT), MANY) << REACH_BITS)


def chunks(part: Slice) -> tuple[np.ndarray, ...]:
    """text, number, start, end (bytes), words that begin inside, digest, continuation bytes before start and end, fringes before and after, of each chunk of a slice."""
    texts = part.texts()
    raw = np.frombuffer(b" " * PAD + (b" " * PAD).join(texts) + b" " * PAD, np.uint8)
    sizes = np.diff(part.offsets)
    begin = part.offsets[:-1] + PAD * np.arange(1, len(texts) + 1)
    rolled = _GEAR[raw]
    for k in (1, 2, 4, 8):
        longer = rolled.copy()
        longer[k:] += rolled[:-k] << np.uint16(k)
        rolled = longer
    outside = np.concatenate([begin - PAD, [len(raw) - PAD]])
    rolled[(outside[:, None] + np.arange(PAD)).ravel()] = np.iinfo(np.uint16).max
    ahead = _least(rolled, REACH)
    low = np.zeros(len(raw), bool)
    low[REACH:-1] = (rolled[REACH:-1] <= ahead[:-REACH - 1]) & (rolled[REACH:-1] <= ahead[REACH + 1:])
    low[(outside[:, None] + np.arange(PAD)).ravel()] = False
    ends = _spaced(np.flatnonzero(low) + 1)
    text = np.searchsorted(begin, ends, "right") - 1
    inner = ends < (begin + sizes)[text]
    filled = np.flatnonzero(sizes)
    cut = np.unique(np.concatenate([ends[inner], (begin + sizes)[filled]]))
    text = np.searchsorted(begin, cut, "left") - 1
    first = starts_of(text) if len(text) else np.zeros(0, np.int64)
    start = np.concatenate([[0], cut[:-1]])[:len(cut)]
    start[first] = begin[text[first]]
    solid = ~_BLANK[raw]
    opening = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    words = np.searchsorted(opening, cut) - np.searchsorted(opening, start)
    number = np.arange(len(cut)) - np.repeat(first, np.diff(np.append(first, len(cut))))
    after = np.concatenate([[0], np.cumsum((raw & 0xC0) == 0x80)])
    wide, wide_end = after[start] - after[begin[text]], after[cut] - after[begin[text]]
    sizes_, inside = cut - start, number > 0
    earlier = np.where(inside, np.concatenate([[0], sizes_[:-1]])[:len(cut)], 0)
    later = np.where(np.append(inside[1:], False)[:len(cut)], np.append(sizes_[1:], 0)[:len(cut)], 0)
    stop = (begin + sizes)[text]
    before = _fringe(earlier, lambda reach: np.searchsorted(opening, start) - np.searchsorted(opening, np.maximum(begin[text], start - reach)))
    after_ = _fringe(later, lambda reach: np.searchsorted(opening, np.minimum(stop, cut + reach)) - np.searchsorted(opening, cut))
    return text, number, start - begin[text], cut - begin[text], words, RangeHasher(raw)(start, cut), wide, wide_end, before, after_


def chunk_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, number, start, end, words, wide, wide_end, before, after, digest of every chunk, see ``chunks``."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                text, number, start, end, words, digest, *more = chunks(part)
                at = pa.array(text + part.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x.astype(np.int32)) for x in (number, start, end, words, *more)), pa.array(digest.view(np.int64))],
                    names=["doc_id", "text_key", "number", "start", "end", "words", "wide", "wide_end", "before", "after", "digest"])

    return docs.mapInArrow(run, "doc_id long, text_key long, number int, start int, end int, words int, wide int, wide_end int, before int, after int, digest long")


def _runs(marked: DataFrame, window: int, most_words: int) -> tuple[DataFrame, Callable[[], None]]:
    """Repeated chunks of every text with their run, and the windows of chunks that begin and end at each.

    Consecutive repeated chunks are a run, named by its first chunk's number; runs that cannot have more than
    ``most_words`` words, with all that begin in the reach of their ends, have none. A window is the shortest row of a run's chunks from its begin, or to its end, with
    ``window`` words, or the whole run if it has fewer: digest and number of chunks, null where there is none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["doc_id", "text_key"]):
            doc, key, number = (table[k].to_numpy() for k in ("doc_id", "text_key", "number"))
            again = np.zeros(len(doc), bool)  # rows of ``docs`` that repeat id and text
            again[1:] = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (number[1:] == number[:-1])
            table = table.filter(pa.array(~again)).combine_chunks()
            doc, key, number = (table[k].to_numpy() for k in ("doc_id", "text_key", "number"))
            at = np.arange(len(doc))
            first = starts_of(doc, key, number - at)
            stop = np.append(first[1:], len(doc))
            sums = np.concatenate([[0], np.cumsum(table["words"].to_numpy(), dtype=np.int64)])
            words = sums[stop] - sums[first]
            of = np.repeat(np.arange(len(first)), stop - first)
            end = np.searchsorted(sums, sums[at] + window)  # first end with enough words
            whole = (at == first[of]) & (words[of] < window)
            end = np.where(whole, stop[of], end)
            left, right = table["before"].to_numpy()[first] >> REACH_BITS, table["after"].to_numpy()[stop - 1] >> REACH_BITS
            long_ = ((words + left + right > most_words) | (left == MANY) | (right == MANY))[of]
            begun = (end <= stop[of]) & long_
            begin = np.searchsorted(sums, sums[1:] - window, "right") - 1  # last begin with enough words
            ended = (begin >= first[of]) & long_
            ended[ended] = end[begin[ended]] != at[ended] + 1  # others are listed at their begin
            hasher = RangeHasher(table["digest"].to_numpy().view(np.uint64))
            ahead = hasher(at, np.where(begun, end, at)).view(np.int64)
            behind = hasher(np.where(ended, begin, at), at + 1).view(np.int64)
            columns = {"run": pa.array(number[first][of].astype(np.int32), mask=~long_), "head": pa.array(long_ & (at == first[of])), "tail": pa.array(long_ & (at == stop[of] - 1)),
                       "ahead": pa.array(ahead, mask=~begun), "n_ahead": pa.array((end - at).astype(np.int32), mask=~begun),
                       "behind": pa.array(behind, mask=~ended), "n_behind": pa.array((at + 1 - begin).astype(np.int32), mask=~ended)}
            for name, column in columns.items():
                table = table.append_column(name, column)
            yield from table.combine_chunks().to_batches()

    keys = ["doc_id", "text_key", "number"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema), "run int, head boolean, tail boolean, ahead long, n_ahead int, behind long, n_behind int"])
    return _brief(marked.repartition("doc_id", "text_key").sortWithinPartitions(*keys).mapInArrow(run, schema), "runs")


def _sourced(chunks_: DataFrame) -> DataFrame:
    """Runs with their parts: the sources and the code points where they begin; staged.

    A chunk's source is the smallest id with a window that covers it, consecutive chunks of one source are a part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["doc_id", "text_key", "run"]):
            behind, span, low = (table[k].to_numpy() for k in ("behind", "span", "low"))
            left = np.cumsum(~behind) - 1
            left = np.where(behind, left - span + 1, left)
            table = table.filter(pa.array(~behind))
            doc, key, name, start, end, wide, wide_end, words = (table[k].to_numpy() for k in ("doc_id", "text_key", "run", "start", "end", "wide", "wide_end", "words"))
            source = doc.copy()
            for k in range(int(span.max(initial=0))):
                more = span > k
                left, span, low = left[more], span[more], low[more]
                np.minimum.at(source, left + k, low)
            first = starts_of(doc, key, name)
            last = np.append(first[1:], len(doc)) - 1
            part = starts_of(doc, key, name, source)
            cuts = np.searchsorted(part, np.append(first, len(doc))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (doc[first], key[first], name[first], start[first], end[last], np.add.reduceat(words, first).astype(np.int64), (end - wide_end)[last].astype(np.int64))]
                + [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[part].astype(np.int64))) for x in (source, start - wide)],
                names=["doc_id", "text_key", "run", "start", "end", "words", "stop", "sources", "points"])

    keys = ["doc_id", "text_key", "run"]
    def windows(behind: bool, digest: str, span: str) -> Column:
        return F.struct(F.lit(behind).alias("behind"), F.col(digest).alias("window"), F.coalesce(span, F.lit(0)).alias("span"))

    either = F.filter(F.array(windows(False, "ahead", "n_ahead"), windows(True, "behind", "n_behind")), lambda w: ~w["behind"] | w["window"].isNotNull())
    listed = chunks_.filter("run is not null").select(*keys, "number", "start", "end", "wide", "wide_end", "words", F.explode(either).alias("w")).select("*", "w.*").drop("w")
    lows, drop_lows = _brief(listed.filter("window is not null").groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("_high")).filter("low < _high").drop("_high"), "windows")
    rows = listed.join(lows.hint("merge"), "window", "left").drop("window").withColumn("low", F.coalesce("low", "doc_id"))
    schema = "doc_id long, text_key long, run int, start int, end int, words long, stop long, sources array<long>, points array<long>"
    parts = stage(rows.repartition("doc_id", "text_key").sortWithinPartitions(*keys, "number", "behind").mapInArrow(run, schema), "parts")
    drop_lows()
    return parts


def _contexts(places: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text_key, place, side, digest, asks, bytes: the ``reach`` bytes before (L) or after (R) places of texts; staged.

    A text has a blank before and after it. What is after a place begins with the byte before it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                lists = batch.column("places").slice(part.first, len(part))
                of = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                place, side, digest, asks, reach = lists.flatten().flatten()
                raw = b" " + b"  ".join(part.texts()) + b" "
                first, size = (part.offsets[:-1] + 2 * np.arange(len(part)))[of], (np.diff(part.offsets) + 2)[of]
                p, far, left = place.to_numpy().astype(np.int64) + 1, reach.to_numpy().astype(np.int64), pc.equal(side, "L").to_numpy(zero_copy_only=False)
                begin = first + np.where(left, np.maximum(p - far, 0), p - 1)
                end = first + np.where(left, p, np.minimum(p + far, size))
                around = pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
                at = pa.array(of + part.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("text_key").take(at), place, side, digest, asks, around],
                    names=["doc_id", "text_key", "place", "side", "digest", "asks", "bytes"])

    asked = F.collect_list(F.struct("place", "side", "digest", "asks", "reach"))
    wanted, drop_wanted = _brief(places.groupBy("doc_id", "text_key").agg(asked.alias("places")), "places")  # bounded by the text's length
    schema = "doc_id long, text_key long, place int, side string, digest long, asks boolean, bytes binary"
    contexts = stage(wanted.join(docs, ["doc_id", "text_key"]).mapInArrow(run, schema), "contexts")
    drop_wanted()
    return contexts


def word_steps(side: str, around: bytes) -> list[int]:
    """Bytes up to the first, second, ... begin of a word to the left or end of a word to the right."""
    solid = ~_BLANK[np.frombuffer(around, np.uint8)]
    if side == "L":
        return (len(around) - 1 - np.flatnonzero(solid[1:] & ~solid[:-1]))[::-1].tolist()
    return (np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1).tolist()


def word_ranges(part: Slice, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context, number from 1, and range of bytes of every step of ``word_steps``, for a slice of contexts of either side."""
    solid = ~_BLANK[part.data]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    of = np.repeat(np.arange(len(part)), np.diff(np.searchsorted(edge, part.offsets)))
    first, stop = part.offsets[of], part.offsets[of + 1]
    opens = solid[edge]
    kept = np.where(left[of], opens, ~opens & (edge > first + 1)) & (edge > first)
    of, edge, first, stop = of[kept], edge[kept], first[kept], stop[kept]
    at, to_left, bound = np.arange(len(of)), left[of], np.searchsorted(of, np.arange(len(part) + 1))
    number = np.where(to_left, bound[of + 1] - at, at - bound[of] + 1)
    return of, number, np.where(to_left, edge, first + 1), np.where(to_left, stop, edge)


def _shared_steps(contexts: DataFrame) -> DataFrame:
    """side, digest, bytes, steps: per context of a run's end and number of words, the smallest id that shares them.

    Only words that documents of two ids share are listed. All occurrences of the chunk take part: they are grouped by
    the next word, those that share it with a run of another document by the next ones, and so on.
    """
    fringes = stage(contexts.groupBy("side", "digest", "bytes").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("asks").alias("asks"))
                    .withColumn("fringe", F.monotonically_increasing_id()), "fringes")

    def cut(begin: int, end: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left = pc.equal(batch.column("side"), "L").to_numpy(zero_copy_only=False)
                for part in slices(batch.column("bytes")):
                    of, number, start, stop = word_ranges(part, left[part.first:part.first + len(part)])
                    now = (number > begin) & (number <= end)
                    keys = RangeHasher(part.data)(start[now], stop[now]).view(np.int64)
                    at = pa.array(of[now] + part.first)
                    names = ["fringe", "side", "digest", "lo", "hi", "asks"]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(number[now].astype(np.int32)), pa.array(keys)], names=[*names, "n", "key"])
        return run

    live, steps, keys = fringes, None, ["side", "digest", "key"]
    ends = chain(WORD_STEPS[1:], (WORD_STEPS[-1] * GROWTH**k for k in count(1)))
    for begin, end in pairwise(chain(WORD_STEPS[:1], ends)):
        if begin >= WORD_STEPS[-1] and live.isEmpty():
            break
        rows, drop_rows = _brief(live.mapInArrow(cut(begin, end), "fringe long, side string, digest long, lo long, hi long, asks boolean, n int, key long"), "prefixes")
        both = rows.groupBy(*keys).agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.max("asks").alias("wanted")).filter("wanted and least < most")
        shared, drop_shared = _brief(both.select(*keys, "least"), "shared-prefixes")
        found = stage(rows.join(shared.hint("merge"), keys).select("fringe", "n", "least", "asks"), "found-prefixes")
        drop_rows()
        drop_shared()
        own = found.filter("asks").select("fringe", "n", "least")
        steps = own if steps is None else steps.unionByName(own)
        live = stage(live.join(found.filter(F.col("n") == end).select("fringe"), "fringe"), "live-fringes")
    listed = steps.groupBy("fringe").agg(F.collect_list(F.struct("n", "least")).alias("steps"))  # bounded by the bytes of a context
    return stage(fringes.filter("asks").join(listed, "fringe").select("side", "digest", "bytes", "steps"), "steps")


def _grown(own: int, source: int, side: str, around: bytes, steps: list[dict]) -> tuple[int, int, int]:
    """Words that a run gains, code points, and those of them that stay with the run's part.

    What the part's document keeps is its own; of a part that goes, words stay that no document before it has.
    """
    lengths = word_steps(side, around)
    shared = {s["n"]: s["least"] for s in steps}
    most = max(shared, default=0)
    along = most if source == own else max((n for n, least in shared.items() if least != own), default=0)

    def points(n: int) -> int:
        part = around[len(around) - lengths[n - 1]:] if side == "L" else around[1:lengths[n - 1] + 1]
        return len(part.translate(None, _CONTINUED))

    inside = side == "R" and len(around) > 1 and not _BLANK[around[0]] and not _BLANK[around[1]]  # its last word is counted
    return max(0, most - inside), points(most) if most else 0, points(along) if along else 0


def repeated_passages(docs: DataFrame, most_words: int = 50) -> DataFrame:
    """doc_id, start, end (code points), n_words, first_doc_id, kept, passage_start, passage_end: passages that other documents share.

    A passage has more than ``most_words`` words, and its chunks all occur in a document of
    another id. It has one row per part from one source, with the words and place of the
    whole passage: ``first_doc_id`` is the smallest id that shares about WINDOW_SHARE of
    ``most_words`` words there, and a part stays where it is the document's own. So is
    what no single document shares. Parts may meet inside a word. White space takes no part
    in counting. Null and empty texts and rows with a null id have no passages; rows that
    repeat id and text count once; an empty table gives an empty result. Other columns are
    ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").filter("doc_id is not null and text is not null")
    table, drop_table = _brief(chunk_table(texts), "chunks")
    repeated, drop_repeated = _brief(table.groupBy("digest").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).filter("_low < _high").select("digest"), "repeated")
    chunks_, drop_chunks = _runs(table.join(repeated.hint("merge"), "digest"), max(1, int(most_words * WINDOW_SHARE)), most_words)
    drop_table()
    drop_repeated()
    runs = _sourced(chunks_)

    def places(flag: str, side: str, place: str, neighbour: str) -> DataFrame:
        wanted = stage(chunks_.filter(flag).select("digest").distinct(), "end-digests")
        return chunks_.join(wanted.hint("merge"), "digest").select(
            "doc_id", "text_key", F.col(place).alias("place"), F.lit(side).alias("side"), "digest", F.col(flag).alias("asks"), (F.col(neighbour).bitwiseAND((1 << REACH_BITS) - 1) * UNIT).alias("reach"))

    contexts = _contexts(places("head", "L", "start", "before").unionByName(places("tail", "R", "end", "after")), texts)
    drop_chunks()
    keys = ["doc_id", "text_key", "place", "side"]
    gains = contexts.filter("asks").join(_shared_steps(contexts).hint("merge"), ["side", "digest", "bytes"]).select(*keys, "bytes", "steps").dropDuplicates(keys)
    ends = runs.select("doc_id", "text_key", "run", F.explode(F.array(*(F.struct(F.col(c).alias("place"), F.lit(s).alias("side")) for c, s in (("start", "L"), ("end", "R"))))).alias("p"))
    gained = (ends.select("doc_id", "text_key", "run", "p.*").join(gains, keys).groupBy("doc_id", "text_key", "run")
              .agg(F.collect_list(F.struct("side", "bytes", "steps")).alias("gains")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                doc, sources, points = r["doc_id"], r["sources"], [*r["points"], r["stop"]]
                gain = {g["side"]: g for g in r["gains"] or []}
                (more_l, left, along_l), (more_r, right, along_r) = (
                    _grown(doc, source, side, gain[side]["bytes"], gain[side]["steps"]) if side in gain else (0, 0, 0) for side, source in (("L", sources[0]), ("R", sources[-1])))
                n, begin, end = r["words"] + more_l + more_r, points[0] - left, points[-1] + right
                if n <= most_words:
                    continue
                points[0] -= along_l
                points[-1] += along_r
                parts = [(begin, points[0], doc)] * (begin < points[0]) + list(zip(points, points[1:], sources)) + [(points[-1], end, doc)] * (points[-1] < end)
                out += [(doc, a, b, n, source, begin, end) for a, b, source in parts]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 7)], names=names)

    names = ["doc_id", "start", "end", "n_words", "first_doc_id", "passage_start", "passage_end"]
    found = runs.drop("start", "end").join(gained, ["doc_id", "text_key", "run"], "left").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return found.select(*names[:5], (F.col("doc_id") == F.col("first_doc_id")).alias("kept"), *names[5:])
