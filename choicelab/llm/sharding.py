"""Shards by jump consistent hashing, in DataFrame functions only.

The hash of Lamping and Veach (2014) needs no ring table: a key jumps from shard to
shard with a pseudo-random step each, and the last shard below the shard count is
its own. With one shard more, a key either stays or jumps to the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelab.llm.prefix import random_key, running_sums
from choicelab.staging import spread, stage

SHARDS = 40
OVERHEAD = 16
COPIES = 50_000

# Fixed value: multiplier of the published generator, whose state is 64 bits.
MULTIPLIER = 2862933555777941757

_LOW = 0xFFFFFFFF
_HALF = 0xFFFF


def _times(x: Column, factor: int) -> tuple[Column, Column]:
    """Products of the upper and lower 16 bits of a 32-bit number; neither leaves 48 bits."""
    return F.shiftright(x, 16) * F.lit(factor), x.bitwiseAND(_HALF) * F.lit(factor)


def _low_product(x: Column, factor: int) -> Column:
    """``x * factor`` modulo 2^32."""
    upper, lower = _times(x, factor)
    return (lower + F.shiftleft(upper.bitwiseAND(_HALF), 16)).bitwiseAND(_LOW)


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, as two 32-bit halves: state * MULTIPLIER + 1 modulo 2^64, without overflow."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW
    upper, lower = _times(lo, m_lo)
    low = lower + 1 + F.shiftleft(upper.bitwiseAND(_HALF), 16)
    high = F.shiftright(low, 32) + F.shiftright(upper, 16) + _low_product(hi, m_lo) + _low_product(lo, m_hi)
    return high.bitwiseAND(_LOW), low.bitwiseAND(_LOW)


def jump_shards(hi: Column, lo: Column, shards: int) -> Column:
    """Struct of ``shard`` among ``shards`` and ``grown`` among one more, for a key of two 32-bit halves.

    Every step jumps ahead by one shard at least, so ``shards`` steps always do; after
    the last jump a step costs one comparison.
    """
    def jump(state: Column) -> Column:
        # the upper 31 bits of the state are the random number
        share = F.lit(float(1 << 31)) / (F.shiftright(state["hi"], 1) + 1).cast("double")
        return ((state["at"] + 1) * share).cast("long")

    def state(at: Column, hi: Column, lo: Column) -> Column:
        hi, lo = _next(hi, lo)
        return F.struct(at.cast("long").alias("at"), hi.alias("hi"), lo.alias("lo"))

    def step(held: Column, _: Column) -> Column:
        return F.when(jump(held) >= shards, held).otherwise(state(jump(held), held["hi"], held["lo"]))

    def done(held: Column) -> Column:
        return F.struct(held["at"].cast("int").alias("shard"), F.when(jump(held) == shards, shards).otherwise(held["at"]).cast("int").alias("grown"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state(F.lit(0), hi, lo), step, done)


def key_shards(key: Column, shards: int, seed: int = 0) -> Column:
    """``jump_shards`` of any key: its digest's last 64 bits. A null key is a key of its own."""
    digest = random_key(key, seed=seed)
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return jump_shards(half(17), half(25), shards)


def with_shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", out: str = "shard", seed: int = 0) -> DataFrame:
    """``docs`` with the shard of every row, for ``write.partitionBy``; needs no shuffle."""
    return docs.withColumn(out, key_shards(F.col(id_col), shards, seed)["shard"])


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs``.

    The law is ``key``: the id and the shard count decide, rows that repeat an id share
    its shard, a null id is an id. ``size`` is the text's UTF-8 bytes plus 16, null text
    has none. ``slot`` numbers the rows of a shard from 0 in a random but repeatable
    order; rows that repeat id, size and checksum are interchangeable. They are counted
    together and dealt out again in portions, so no id gathers in one task. An empty
    table gives an empty result. Other columns are ignored.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies"))
    portions = (same.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES).cast("long"))))
                .withColumn("_n", F.least(F.col("_copies") - F.col("_from"), F.lit(COPIES))))
    keyed = stage(portions.withColumn("_jump", key_shards(F.col("doc_id"), shards, seed))
                  .select("doc_id", "size", "text_crc32", "_from", "_n", F.col("_jump.shard").alias("shard"), F.col("_jump.grown").alias("grown_shard"),
                          random_key(F.col("doc_id"), F.col("size"), F.col("text_crc32"), seed=seed).alias("_key")), "shard-rows")
    totals = keyed.groupBy("shard").agg(F.sum("_n").alias("_rows"))  # a row per shard
    placed = running_sums(keyed.join(totals, "shard"), "shard", "_rows", "_key", "_n", ["doc_id", "size", "text_crc32", "_from"])
    dealt = spread(placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "before", "_from", "_n"), "doc_id", "size", "_from")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard", "before",
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_at")).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("_at")).cast("long").alias("slot"), "grown_shard")


_POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected


# DuckDB table: ``crc``, the checksum's step for every byte value, as one list.
CRC_TABLE = f"""crc_table AS (SELECT list(x ORDER BY byte) AS crc FROM (
        SELECT byte, list_reduce(list_prepend(byte, range(8)), lambda x, bit: xor(x >> 1, {_POLYNOMIAL} * (x & 1))) AS x FROM range(256) bytes(byte)))"""


def crc32_sql(bytes_list: str) -> str:
    """DuckDB expression: CRC-32 of a list of byte values, where ``crc`` of CRC_TABLE is in scope."""
    return f"xor(list_reduce(list_prepend({_LOW}::BIGINT, {bytes_list}), lambda x, byte: xor(x >> 8, crc[(xor(x, byte) & 255) + 1])), {_LOW})"


def sql(shards: int = SHARDS) -> str:
    """The same result in DuckDB."""
    values = "list_transform(range(strlen(text)), lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT)"
    key = "coalesce(doc_id::VARCHAR, 'null')"
    return f"""
    WITH RECURSIVE {CRC_TABLE},
    texts AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hexed FROM documents),
    sized AS (SELECT doc_id, strlen(text) + {OVERHEAD} AS size, {crc32_sql(values)} AS text_crc32, ('0x' || substr(md5('0:' || {key}), 17, 16))::HUGEINT AS state FROM texts, crc_table),
    jumps(doc_id, state, shard, ahead) AS (SELECT DISTINCT doc_id, state, -1::BIGINT, 0::BIGINT FROM sized
        UNION ALL SELECT doc_id, following, ahead, trunc((ahead + 1) * (2147483648::DOUBLE / ((following // 8589934592) + 1)::DOUBLE))::BIGINT
        FROM (SELECT doc_id, ahead, (state * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS following FROM jumps WHERE ahead < {shards})),
    places AS (SELECT doc_id, shard::INT AS shard, (CASE WHEN ahead = {shards} THEN {shards} ELSE shard END)::INT AS grown_shard FROM jumps WHERE ahead >= {shards})
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
           row_number() OVER (PARTITION BY shard ORDER BY md5('0:' || {key} || ':' || size || ':' || text_crc32), doc_id, size, text_crc32) - 1 AS slot
    FROM sized JOIN places USING (doc_id)"""
