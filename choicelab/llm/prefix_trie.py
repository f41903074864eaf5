"""Trie of the conversations' common prefixes, found block by block.

Turns are cut into blocks of a fixed number. A block is named by the digest of all
blocks up to its end, so conversations that share it share everything before. Most
of the trie is found by grouping blocks; only where a group goes on with more than
one block are turn boundaries looked at, and there a node is the digest of the
turns up to it. Elsewhere all turns of a block have the members of the block.

Members that differ further down are never gathered: a group is a count and a
smallest id. What lies below a block is summed along one conversation per node, the
smallest member, which owns its path from the node where it is the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicelab.llm.batches import bound_batches
from choicelab.llm.sharding import CRC_TABLE, crc32_sql
from choicelab.staging import shuffle_tasks, stage

BLOCK = 4
SEGMENT = 256
FAMILY = 20
HEADS = 4

ROOT = hashlib.sha256(b"").digest()
_WORD = r"[^\x20\x09-\x0D]+"
_BLOB = 1 << 16


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words: role and text by digest, the role's length keeping them apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation with their number within this task's stretch of it."""
    part, conv, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        numbers = []
        for c in batch.column(0).to_pylist():
            count = count + 1 if c == conv else 0
            conv = c
            numbers.append(count)
        n = batch.num_rows
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array([part] * n, pa.int32()), pa.array(numbers, pa.int64())],
                              ["conv_id", "digest", "words", "part", "place"])


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, digest, words, pos: turns from 0 by turn (null first), then digest; staged.

    Ranges of (conversation, turn) are sorted, so a conversation of any length is
    split. Only the first conversation of a range began in an earlier one: the
    corrections are one row per range at most, which is the bound of the broadcast.
    """
    rows = stage(turn_digests(conversations).withColumn("_row", F.monotonically_increasing_id()), "trie-turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("_row")]
    ranges = rows.repartitionByRange(shuffle_tasks(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = stage(ranges.select("conv_id", "digest", "words").mapInArrow(_numbered, "conv_id long, digest binary, words long, part int, place long"), "trie-places")
    held = placed.groupBy("conv_id", "part").agg((F.max("place") + 1).alias("_held"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.withColumn("_carried", F.sum("_held").over(earlier)).filter("_carried > 0").drop("_held")
    joined = placed.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return joined.select("conv_id", "digest", "words", (F.col("place") + F.coalesce("_carried", F.lit(0))).alias("pos"))


def family_head(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, digest, words, depth from 0, length) and conversations (conv_id, length), as rebuilt."""
    turns = stage(turns_in_order(conversations), "trie-order")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_own"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    # three turns at most for every twentieth conversation
    heads = (turns.filter((F.col("pos") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0))
             .groupBy(F.col("conv_id").alias("_base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("_turns")))
    head = family_head(F.col("conv_id"))
    convs = (sizes.withColumn("_base", base).join(heads, "_base", "left").withColumn("_head", head)
             .withColumn("_taken", F.coalesce(F.slice("_turns", F.lit(1), F.col("_head").cast("int")), F.array())))
    given = F.size("_taken").cast("long")
    convs = stage(convs.select("conv_id", "_head", "_taken", given.alias("_given"), (given + F.greatest(F.col("_own") - F.col("_head"), F.lit(0))).alias("length")), "trie-convs")
    first = convs.select("conv_id", "length", F.posexplode("_taken").alias("depth", "_turn")).select(
        "conv_id", "_turn.digest", "_turn.words", F.col("depth").cast("long").alias("depth"), "length")
    rest = turns.filter(F.col("pos") >= head).join(convs.drop("_taken"), "conv_id").select(
        "conv_id", "digest", "words", (F.col("pos") - F.col("_head") + F.col("_given")).alias("depth"), "length")
    return first.unionByName(rest), convs.select("conv_id", "length")


def _joined(before: bytes, content: bytes) -> bytes:
    return hashlib.sha256(before + content).digest()


def _chained(block: int, segment: int):
    """Blocks of segments: every block's name follows from the name before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                before, turns = r["start"], r["turns"]
                whole = hashlib.sha256(b"".join(t["digest"] for t in turns)).digest()
                for at in range(0, len(turns), block):
                    own = turns[at:at + block]
                    digests = [t["digest"] for t in own]
                    # the last block of a full segment has the name that the next segment starts from
                    full = at + len(own) == block * segment
                    name = _joined(r["start"], whole) if full else _joined(before, b"".join(digests))
                    depth = r["segment"] * segment * block + at
                    rows.append((r["conv_id"], r["segment"], depth, before, name, digests, [t["words"] for t in own], depth + len(own) == r["length"]))
                    before = name
                if len(rows) >= 2000:
                    yield _block_batch(rows)
                    rows = []
            if rows:
                yield _block_batch(rows)
    return run


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.bool_()]
    names = ["conv_id", "segment", "depth", "before", "name", "digests", "words", "last"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _segment_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names before the second and later segments of conversations, from the digests of full segments."""
    for batch in batches:
        conv, numbers, starts = [], [], []
        for c, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            name = ROOT
            for s in segments:
                name = _joined(name, s["content"])
                conv.append(c)
                numbers.append(s["segment"] + 1)
                starts.append(name)
        yield pa.record_batch([pa.array(conv, pa.int64()), pa.array(numbers, pa.int64()), pa.array(starts, pa.binary())], ["conv_id", "segment", "start"])


def conversation_blocks(turns: DataFrame, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment, depth, before, name, digests, words, last: the blocks of every conversation; staged.

    A task chains the blocks of one segment of ``segment`` blocks. Segments of a
    conversation are chained by their digests, one per ``block * segment`` turns.
    """
    size = block * segment
    whole = stage(turns.groupBy("conv_id", F.floor(F.col("depth") / size).alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))).alias("turns"), F.max("length").alias("length")), "trie-segments")
    contents = F.unhex(F.sha2(F.aggregate(F.col("turns.digest"), F.lit(b""), lambda a, b: F.concat(a, b)), 256))
    full = whole.filter(F.size("turns") == size).select("conv_id", F.struct("segment", contents.alias("content")).alias("_segment"))
    starts = full.groupBy("conv_id").agg(F.sort_array(F.collect_list("_segment")).alias("_segments")).mapInArrow(_segment_starts, "conv_id long, segment long, start binary")
    begun = whole.join(starts, ["conv_id", "segment"], "left").withColumn("start", F.coalesce("start", F.lit(ROOT)))
    return stage(begun.select("conv_id", "segment", "start", "length", "turns").mapInArrow(
        _chained(block, segment), "conv_id long, segment long, depth long, before binary, name binary, digests array<binary>, words array<long>, last boolean"), "trie-blocks")


def block_edges(blocks: DataFrame) -> DataFrame:
    """Distinct blocks with their members: before, name, conv_id, n_convs, depth, digests, words, and whether siblings diverge; staged."""
    edges = blocks.groupBy("name").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
                                       F.first(F.struct("before", "depth", "digests", "words")).alias("_block")).select("name", "n_convs", "conv_id", "_block.*")
    edges = stage(edges, "trie-edges")
    # the one block after a name, where there is just one: matched by its own name, so no group meets in a task
    only = edges.groupBy("before").agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias("_only")).filter("_n = 1").select("_only")
    return edges.join(only, F.col("name") == F.col("_only"), "left").withColumn("diverging", F.col("_only").isNull()).drop("_only")


def _turn_nodes(edges: DataFrame) -> DataFrame:
    """A row per block and turn of it: id, parent, depth, n_convs, conv_id, words, and the block it is of."""
    def at(turn: Column) -> Column:
        upto = F.aggregate(F.slice("digests", F.lit(1), turn), F.lit(b""), lambda a, b: F.concat(a, b))
        refined = F.unhex(F.sha2(F.concat("before", upto), 256))
        # inside a block without siblings the place within it is enough
        inner = F.when(F.col("diverging"), refined).otherwise(F.concat("name", F.encode(turn.cast("string"), "UTF-8")))
        return F.when(turn == F.size("digests"), F.col("name")).when(turn == 0, F.col("before")).otherwise(inner)

    turns = F.transform(F.sequence(F.lit(1), F.size("digests")), lambda t: F.struct(
        at(t).alias("id"), at(t - 1).alias("parent"), (F.col("depth") + t).alias("depth"), F.element_at("words", t).alias("words"), t.alias("turn")))
    return edges.select("name", "conv_id", "n_convs", "diverging", F.inline(turns))


def trie_nodes(edges: DataFrame, convs: DataFrame) -> DataFrame:
    """id, parent, depth, conv_id, n_convs, words: the nodes, the root included; staged."""
    turns = _turn_nodes(edges)
    plain = turns.filter(~F.col("diverging"))
    shared = turns.filter("diverging").groupBy("id").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("words").alias("words"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    columns = ["id", "parent", "depth", "conv_id", "n_convs", "words"]
    return stage(plain.select(columns).unionByName(shared.select(columns)).unionByName(root), "trie-nodes")


def _below(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """name, leaves, saved: sums of the blocks strictly below a block.

    ``weights`` holds (name, conv_id, leaves, saved), the conversation being the one
    that owns the nodes. Its blocks get what it owns further down; positions within a
    conversation are dense, so a window holds one segment or the segments of one conversation.
    """
    path = blocks.select("conv_id", "segment", "depth", "name").join(weights, ["name", "conv_id"], "left").fillna(0, ["leaves", "saved"])
    path = stage(path, "trie-path")
    later = Window.partitionBy("conv_id").orderBy(F.col("segment").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = path.groupBy("conv_id", "segment").agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    beyond = totals.select("conv_id", "segment", *[F.coalesce(F.sum(f"_{c}").over(later), F.lit(0)).alias(f"_{c}") for c in ("leaves", "saved")]).filter("_leaves > 0 or _saved > 0")
    inside = Window.partitionBy("conv_id", "segment").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summed = path.join(beyond, ["conv_id", "segment"], "left").select(
        "name", *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
    return summed.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_sums(blocks: DataFrame, edges: DataFrame, nodes: DataFrame, children: DataFrame) -> DataFrame:
    """id, n_leaves, saved_tokens: sums over the subtree of every node but the root."""
    weighted = nodes.join(children, "id", "left").select(
        "id", F.col("conv_id").alias("_owner"), F.col("n_children").isNull().cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    # in a block the nodes of its smallest member are its own; others belong to a sibling
    owned = _turn_nodes(edges).select("name", "id", "turn", "conv_id").join(weighted, "id")
    mine = F.col("conv_id") == F.col("_owner")
    owned = stage(owned.select("name", "id", "turn", "conv_id", *[F.when(mine, F.col(c)).otherwise(0).alias(c) for c in ("leaves", "saved")]), "trie-owned")
    weights = owned.groupBy("name", "conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = _below(blocks, weights).withColumnsRenamed({"leaves": "_leaves", "saved": "_saved"})
    further = Window.partitionBy("name").orderBy(F.col("turn").desc())  # one block
    summed = owned.join(below, "name").select("id", *[(F.sum(c).over(further) + F.col(f"_{c}")).alias(c) for c in ("leaves", "saved")])
    return summed.groupBy("id").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, conv_id) rows as stretches of comma-joined numbers of bounded bytes."""
    for batch in batches:
        ids, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[tuple] = []
        held, size = [], 0
        for i, (node, conv) in enumerate(zip(ids, convs)):
            text = str(conv).encode()
            held.append(text)
            size += len(text) + 1
            if i + 1 == len(ids) or ids[i + 1] != node or size >= _BLOB:
                out.append((node, convs[i - len(held) + 1], b",".join(held)))
                held, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))], ["id", "first", "listed"])


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node of stretches sorted by (id, first), read as a stream."""
    node, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for i, listed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if i == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = i, hashlib.sha256()
            digest.update(listed)
        if done:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), (pa.binary(), pa.string()))], ["id", "ends_sha256"])
    if node is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["id", "ends_sha256"])


def end_digests(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """id, ends_sha256: digest of the numbers of the conversations that end at a node.

    Numbers are sorted in ranges over all tasks and joined to stretches there; a
    digest of bytes is sequential, so a node's stretches are then read in order as a
    stream, and a task never holds more than one batch of them.
    """
    ends = blocks.filter("last").select(F.col("name").alias("id"), "conv_id").unionByName(convs.filter("length = 0").select(F.lit(ROOT).alias("id"), "conv_id"))
    ends = stage(ends, "trie-ends")
    ranged = ends.repartitionByRange(shuffle_tasks(ends.sparkSession), "id", "conv_id").sortWithinPartitions("id", "conv_id")
    lists = ranged.mapInArrow(_id_lists, "id binary, first long, listed binary")
    return lists.repartition("id").sortWithinPartitions("id", "first").mapInArrow(_list_digests, "id binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the empty one included.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Turns are in the order of ``turn``, null first, ties by the digest of
    role and text; a repeated row is a turn of its own. Null role and text are empty. A
    row without conv_id belongs to no conversation and is ignored. An empty table has no
    conversations and no root. Texts of any length are read whole and are a digest from
    then on. Other columns are ignored.
    """
    bound_batches(conversations.sparkSession)
    turns, convs = rebuilt_turns(conversations.select("conv_id", "turn", "role", "text"))
    blocks = conversation_blocks(turns, block, segment)
    edges = stage(block_edges(blocks), "trie-siblings")
    nodes = trie_nodes(edges, convs)
    children = stage(nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children")), "trie-children")
    sums = stage(subtree_sums(blocks, edges, nodes, children), "trie-sums")
    # the root's subtree is all of it
    top = sums.join(nodes.filter("depth = 1").select("id"), "id").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    top = top.select(F.lit(ROOT).alias("id"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(parents, "parent", "left").join(children, "id", "left").join(sums.unionByName(top), "id", "left")
            .join(end_digests(blocks, convs), "id", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))


SQL = f"""
    WITH {CRC_TABLE},
    own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos, digest, words
            FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
    convs AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % {HEADS} AS h
              FROM (SELECT DISTINCT conv_id FROM own), crc_table),
    placed AS (SELECT c.conv_id, 0 AS part, o.pos, o.digest, o.words FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
               UNION ALL SELECT c.conv_id, 1, o.pos, o.digest, o.words FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h),
    paths AS (SELECT conv_id, row_number() OVER same AS depth, string_agg(digest, ',') OVER same AS path, words FROM placed
              WINDOW same AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
              UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
    lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
    nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
              FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth),
    linked AS (SELECT n.*, p.conv_id AS parent_conv_id, p.path AS above FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, greatest(65 * (n.depth - 1) - 1, 0))),
    families AS (SELECT above, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY above),
    counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN families f ON f.above = l.path),
    sums AS (SELECT left(path, greatest(65 * up - 1, 0)) AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
             FROM (SELECT *, unnest(range(depth + 1)) AS up FROM counted) GROUP BY 1)
    SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM counted JOIN sums USING (path)"""
