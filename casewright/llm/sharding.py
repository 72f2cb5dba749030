"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The key and the number of shards alone decide a row's shard; there is no ring
table, and with one more shard only the rows that move into it change place.
Everything is built-in functions. Rows within a shard get gapless slots by
counts of small buckets, so that no task ever holds a whole shard; rows that are
alike in what decides them are one row with a count until they have their slots.

Defined cases: a null key hashes as key 0; a null text has size 8 and the CRC
of the empty text; repeated rows stay, each with a slot of its own; an empty
table gives no rows; only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, repeated, staged

#: Of the 64-bit linear congruential generator of the published algorithm.
LCG_MULTIPLIER = 2862933555777941757
#: Rows that one task numbers.
SLOT_ROWS = 50_000
_LOW, _HIGH = LCG_MULTIPLIER & 0xFFFFFFFF, LCG_MULTIPLIER >> 32
_MASK32, _MASK16 = 0xFFFFFFFF, 0xFFFF


def _and(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("bigint"))


def _step(hi: Column, lo: Column) -> Column:
    """key * multiplier + 1 modulo 2**64 in halves of 32 bits, without overflow."""
    part = lambda x: (_and(x, _MASK16), F.shiftright(x, 16))
    (l0, l1), (h0, h1) = part(lo), part(hi)
    first = l0 * F.lit(_LOW) + 1
    second = l1 * F.lit(_LOW) + F.shiftright(first, 16)
    low = F.shiftleft(_and(second, _MASK16), 16).bitwiseOR(_and(first, _MASK16))
    from_high = _and(h0 * F.lit(_LOW) + F.shiftleft(_and(h1 * F.lit(_LOW), _MASK16), 16), _MASK32)
    high = _and(F.shiftright(second, 16) + _and(lo * F.lit(_HIGH), _MASK32) + from_high, _MASK32)
    return F.struct(high.alias("hi"), low.alias("lo"))


def jump_hash(key: Column, shards: int, more: int = 0) -> Column:
    """A struct of `shard` among `shards` and `grown` among `shards + more`.

    `key` is a 64-bit integer. One walk serves both counts, as the walk for
    fewer shards is the beginning of that for more.
    """
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    total = shards + more
    start = F.struct(
        F.lit(0).cast("bigint").alias("j"), F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("grown"),
        _and(F.shiftright(key, 32), _MASK32).alias("hi"), _and(key, _MASK32).alias("lo"),
    )

    def walk(s: Column, _: Column) -> Column:
        return F.when(s["j"] < total, let(_step(s["hi"], s["lo"]), lambda k: on(s, k["hi"], k["lo"]))).otherwise(s)

    def on(s: Column, hi: Column, lo: Column) -> Column:
        drawn = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        return F.struct(drawn.alias("j"), F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"), s["j"].alias("grown"), hi.alias("hi"), lo.alias("lo"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(total)), start, walk)
    return let(end, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24) -> DataFrame:
    """The key, size, text_crc32, law, shard, slot and grown_shard of every row.

    Slots number the rows of a shard from 0 without gaps, in the order of
    (bucket, key, size, CRC), where buckets are hashes of the key and the CRC.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    at = jump_hash(F.col(key), shards, 1)
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("crc"), at.alias("at"))
    each = ["k", "size", "crc", "shard", "grown"]
    rows = rows.select("k", "size", "crc", F.col("at.shard").alias("shard"), F.col("at.grown").alias("grown"))
    rows = staged(rows.groupBy(*each).agg(F.count(F.lit(1)).alias("rows")))
    n, most = rows.agg(F.count(F.lit(1)), F.max("rows")).first()
    buckets = max(1, min(1 << 16, -(-n // (shards * SLOT_ROWS))))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("k", "crc"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.sum("rows").alias("count"))
    before = F.expr("sum(count) over (partition by shard order by bucket rows between unbounded preceding and current row) - count")
    offsets = counts.select("shard", "bucket", before.alias("before"))
    if shards * buckets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    local = F.expr("sum(rows) over (partition by shard, bucket order by k, size, crc rows between unbounded preceding and current row) - rows")
    placed = repeated(rows.withColumn("local", local).join(offsets, ["shard", "bucket"]), "rows", most=most or 0)
    return placed.select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("local") + F.col("n")).cast("bigint").alias("slot"), F.col("grown").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = 24) -> None:
    """All rows and columns of `docs` as Parquet, one folder `shard=N` a shard.

    Rows are dealt by (shard, hash), so a shard is written by many tasks.
    """
    at = jump_hash(F.col(key), shards)
    (docs.withColumn("shard", at["shard"]).repartition(F.col("shard"), F.pmod(F.xxhash64(F.col(key)), F.lit(64))).write.partitionBy("shard").parquet(path))
