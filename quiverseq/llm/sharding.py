"""Sharding by jump consistent hashing, and gapless slots within shards, with built-in functions alone.

The published jump hash (Lamping and Veach) steps a 64-bit linear congruential generator and jumps forward
through bucket numbers; it needs no ring table, and when a shard is appended only the keys that belong in the
new shard move. Spark's long multiplication raises on overflow, so the generator runs on two 32-bit halves. Empty tables
give empty results; the query reads doc_id and text alone, and shard_by_key and with_slots replace shard, grown_shard
and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: the multiplier 2862933555777941757 in two 32-bit halves.
MULTIPLIER = 2862933555777941757
C_HI, C_LO = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF


def stable_key(column: str) -> Column:
    """60 bits of the MD5 of the value as text; null counts as the empty string. Independent of engine and run."""
    digest = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a non-negative long key.

    The bucket number grows by at least one per step, so shards steps always suffice; a state whose next bucket
    lies at or beyond the shard count stays as it is.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(s: Column, _: Column) -> Column:
        hi, lo = s["hi"], s["lo"]
        low = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(C_LO)
        high = F.shiftright(lo, 16) * F.lit(C_LO)
        mid = low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
        carry = F.shiftright(mid, 32) + F.shiftright(high, 16)
        cross = (hi.bitwiseAND(F.lit(0xFFFF)) * F.lit(C_LO)) + F.shiftleft((F.shiftright(hi, 16) * F.lit(C_LO)).bitwiseAND(F.lit(0xFFFF)), 16)
        new_hi = (carry + (lo * F.lit(C_HI)).bitwiseAND(F.lit(0xFFFFFFFF)) + cross).bitwiseAND(F.lit(0xFFFFFFFF))
        new_lo = mid.bitwiseAND(F.lit(0xFFFFFFFF))
        jump = F.floor((s["next"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftright(new_hi, 1) + F.lit(1)).cast("double")))
        moved = F.struct(new_hi.alias("hi"), new_lo.alias("lo"), s["next"].alias("bucket"), jump.cast("long").alias("next"))
        return F.when(s["next"] >= F.lit(shards), s).otherwise(moved)

    start = F.struct(F.shiftright(key, 32).alias("hi"), key.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"), F.lit(-1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["bucket"].cast("int"))


def shard_by_key(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Adds shard and grown_shard (the shard if there were one more). Null keys share the shard of the empty string."""
    hashed = stable_key(key)
    return df.withColumns({"shard": jump_hash(hashed, shards), "grown_shard": jump_hash(hashed, shards + 1)})


def with_slots(df: DataFrame, key: str, order: list[str], buckets: int = 1024) -> DataFrame:
    """Adds slot: rows of a shard are numbered from 0 without gaps.

    A window over a whole shard would put a sixteenth of all rows into one task. Instead the rows of a shard fall
    into hash buckets of the key; bucket sizes (shards x buckets rows at most, so a bounded table) give each bucket's
    first slot, and rows are numbered within buckets only. Equal keys share a bucket; ties in order number arbitrarily
    but still without gaps.
    """
    from pyspark.sql import Window

    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)))
    sizes = bucketed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_row", F.row_number().over(within))
    return numbered.join(F.broadcast(firsts), ["shard", "_bucket"]).withColumn("slot", F.col("_first") + F.col("_row") - 1).drop("_bucket", "_row", "_first")


def op5_sharding(spark, sf_dir: str, shards: int = 16) -> DataFrame:
    """Every document in one of 16 shards by the key law: doc_id and the shard count alone decide.

    size is the text's UTF-8 bytes plus 1 (1 for null text), text_crc32 the unsigned CRC-32 of those bytes (0 for null
    or empty text). Repeated rows share a shard and take one slot each.
    """
    from .common import table, text_or_empty

    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    placed = with_slots(shard_by_key(rows, "doc_id", shards), "doc_id", ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
