"""Sharding by jump consistent hashing, in SQL functions only.

A key's shard follows from the key and the number of shards alone. No ring is stored, and
one more shard takes about 1/(n+1) of the keys, all of them into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Fixed value: the multiplier of the published algorithm's generator.
MULTIPLIER = 2862933555777941757
SHARDS = 24
#: Slots are counted up in this many runs per shard, so that no task numbers a whole shard.
RUNS = 1024
#: Repeated rows are restored in pieces of at most this many.
PIECE = 1 << 16

_C = [(MULTIPLIER >> shift) & 0xFFFF for shift in (0, 16, 32, 48)]
_LOW32 = 0xFFFFFFFF


def _low16(c: Column) -> Column:
    return c.bitwiseAND(0xFFFF)


def _next(state: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, from 32-bit halves: no product leaves 63 bits."""
    hi, lo = state["hi"], state["lo"]
    upper = lo * _C[1]
    low = lo * _C[0] + 1 + F.shiftleft(_low16(upper), 16)
    high = (
        F.shiftright(low, 32) + F.shiftright(upper, 16)
        + lo * _C[2] + F.shiftleft(_low16(lo) * _C[3], 16)
        + hi * _C[0] + F.shiftleft(_low16(hi) * _C[1], 16)
    ).bitwiseAND(_LOW32)
    jump = (state["j"] + 1).cast("double") * (F.lit(2.0**31) / (F.shiftright(high, 1) + 1).cast("double"))
    return F.struct(
        state["j"].alias("b"), jump.cast("long").alias("j"), high.alias("hi"),
        low.bitwiseAND(_LOW32).alias("lo"),
    )


def jump_shard(key: Column, shards: int, first_rounds: int = 64) -> Column:
    """Shard of a long key, 0 to shards - 1. A null key goes where key 0 goes.

    A jump always moves forward, so `shards` rounds are enough for any key; nearly all keys
    are done after ln(shards), and only those that are not go on after `first_rounds`.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_LOW32)).alias("lo"),
    )

    def walk(rounds: Column, state: Column) -> Column:
        return F.aggregate(rounds, state, lambda s, _: F.when(s["j"] >= shards, s).otherwise(_next(s)))

    state = walk(F.sequence(F.lit(1), F.lit(min(shards, first_rounds))), start)
    if shards > first_rounds:
        rest = F.when(state["j"] < shards, F.sequence(F.lit(1), F.lit(shards)))
        state = walk(F.coalesce(rest, F.array().cast("array<int>")), state)
    return state["b"].cast("int")


def assign(df: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """Add `shard` and `grown_shard` (with one shard more), replacing columns of these names.

    Keys that are not integers are hashed first. Rows stay where they are: no shuffle.
    """
    kind = dict(df.dtypes)[key]
    value = F.col(key) if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    return df.withColumns({"shard": jump_shard(value, shards), "grown_shard": jump_shard(value, shards + 1)})


def number(df: DataFrame, order: list[str], runs: int = RUNS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps; `df` must hold narrow columns only.

    The order is (order[0] mod runs, then `order`, null first). Equal rows are counted before
    anything is shuffled and restored at the end, so a key with a third of all rows is one
    row on the way. A shard is numbered in `runs` pieces whose sizes are added up first.
    """
    columns = df.columns
    run = F.coalesce(F.pmod(F.col(order[0]), F.lit(runs)), F.lit(0)).alias("__run")
    counted = df.groupBy(*columns).agg(F.count("*").alias("__n")).withColumn("__run", run)
    before = Window.partitionBy("shard").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy("shard", "__run").agg(F.sum("__n").alias("__size"))
    offsets = sizes.select(  # at most shards * runs rows
        F.col("shard").alias("__s"), F.col("__run").alias("__r"),
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"),
    )
    inside = (
        Window.partitionBy("shard", "__run")
        .orderBy(*(F.col(c).asc_nulls_first() for c in order))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        counted.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
        .join(offsets, (F.col("shard") == F.col("__s")) & (F.col("__run") == F.col("__r")))
        .withColumn("__first", F.col("__before") + F.col("__inside"))
    )
    pieces = placed.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / PIECE))))
    inner = F.sequence(
        F.col("__piece") * PIECE, F.least(F.col("__n"), (F.col("__piece") + 1) * PIECE) - 1
    )
    return pieces.withColumn("__i", F.explode(inner)).select(
        *columns, (F.col("__first") + F.col("__i")).alias("slot")
    )


def write_shards(df: DataFrame, key: str, path: str, shards: int = SHARDS, salts: int = 16) -> None:
    """Write whole rows as one folder per shard; each shard is written by up to `salts` tasks."""
    dealt = assign(df, key, shards).withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    dealt.repartition("shard", "__salt").drop("__salt").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, size and slot.

    Null text: size 8, crc null. Null doc_id: as key 0. Repeated rows get slots of their own.
    """
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    numbered = number(assign(docs, "doc_id"), ["doc_id", "text_crc32", "size"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


SQL = f"""
WITH RECURSIVE digit AS (SELECT range AS i, range::UBIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1
  FROM digit WHERE k < 8),
lookup AS (SELECT list(c ORDER BY i) AS t FROM digit WHERE k = 8),
walk AS (
  SELECT n, doc_id AS id, coalesce(doc_id, 0)::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j
  FROM (SELECT DISTINCT doc_id FROM documents), (VALUES ({SHARDS}), ({SHARDS + 1})) AS s(n)
  UNION ALL
  SELECT n, id, nk, j, floor((j + 1) * (2147483648.0::DOUBLE / ((nk >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT n, id, j, ((((k & 4294967295) * {MULTIPLIER}::HUGEINT)
      + ((((k >> 32) * {MULTIPLIER}::HUGEINT) & 4294967295) << 32) + 1) & 18446744073709551615) AS nk
    FROM walk WHERE j < n)),
shards AS (SELECT id, max(b) FILTER (WHERE n = {SHARDS}) AS shard,
    max(b) FILTER (WHERE n = {SHARDS + 1}) AS grown_shard FROM walk GROUP BY id),
sums AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size,
    CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
        regexp_extract_all(hex(encode(text)), '..'),
        lambda h: (16 * (strpos('0123456789ABCDEF', substr(h, 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2, 1)) - 1)::UBIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c & 255, x) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT END AS text_crc32
  FROM documents, lookup)
SELECT d.doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard
    ORDER BY coalesce(((d.doc_id % {RUNS}) + {RUNS}) % {RUNS}, 0), d.doc_id NULLS FIRST,
      text_crc32 NULLS FIRST, size) - 1 AS slot,
  grown_shard::INT AS grown_shard
FROM sums d JOIN shards s ON d.doc_id IS NOT DISTINCT FROM s.id
"""
