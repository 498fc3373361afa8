"""Sharding by rendezvous hashing over weighted shards (DataFrame functions only).

Every record key gets one draw per shard, ``-weight / ln(u)`` with ``u`` from
an MD5 of key and shard number, and goes to the shard with the highest draw.
The draws of the old shards stay when a shard is added, so a key either stays
where it was or moves into the new shard. The assignment needs no shuffle.

Slots are numbered in two levels, so that no task has to sort a whole shard:
equal rows are counted first, (shard, bucket) groups get running sums, and the
small table of group sizes (shards x buckets rows) gives each group its start.

Defined results: a null key hashes as the empty string; a null text has size 8
and a null checksum; repeated rows get one slot each; an empty table gives an
empty result. Only the key and text columns are read, so extra columns of the
input cannot clash with the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the MD5 that make up a bucket within a shard.
BUCKET_DIGITS = 2


def _bucket() -> Column:
    """The part of a shard that a row is numbered in; rows without a key are dealt by what else is known of them."""
    other = F.concat_ws(":", "size", "text_crc32")
    return F.substring(F.md5(F.coalesce(F.col("key").cast("string"), other)), 1, BUCKET_DIGITS)


def _draw(key: Column, shard: int, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")
    return -F.lit(float(weight)) / F.log((bits + F.lit(0.5)) / F.lit(float(2**52)))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0-based) with the highest draw; the smaller number wins a tie."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    draws = [F.struct(_draw(key, i, w).alias("draw"), F.lit(-i).alias("turned")) for i, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*draws))["turned"]).cast("int")


def assign_shards(rows: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard) of every row.

    ``grown_shard`` is the shard after one more, of ``grown_weight``, is added.
    """
    weights = weights or [1.0] * 24
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = rows.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
    )
    grown = [*weights, grown_weight]
    old = slim.withColumn("shard", rendezvous(F.col("key"), weights))
    word = F.coalesce(F.col("key").cast("string"), F.lit(""))
    added = F.struct(_draw(word, len(weights), grown_weight).alias("draw"), F.lit(-len(weights)).alias("turned"))
    # Only the winner of the old shards can lose to the new one.
    chosen = F.lit(None)
    for i, w in reversed(list(enumerate(weights))):
        chosen = F.when(F.col("shard") == i, F.struct(_draw(word, i, w).alias("draw"), F.lit(-i).alias("turned"))).otherwise(chosen)
    return old.withColumn("grown_shard", (-F.greatest(chosen, added)["turned"]).cast("int")) if grown else old


def number_slots(assigned: DataFrame) -> DataFrame:
    """Add gapless ``slot`` numbers from 0 within each shard."""
    counted = assigned.groupBy("key", "size", "text_crc32", "shard", "grown_shard").agg(F.count(F.lit(1)).alias("copies"))
    counted = counted.withColumn("bucket", _bucket())
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    numbered = counted.withColumn("upto", F.sum("copies").over(inside))
    groups = assigned.withColumn("bucket", _bucket()).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    # At most shards x 16**BUCKET_DIGITS rows, whatever the input: safe to broadcast.
    placed = numbered.join(F.broadcast(starts), ["shard", "bucket"])
    last = F.col("start") + F.col("upto") - 1
    return placed.withColumn("slot", F.explode(F.sequence(last - F.col("copies") + 1, last))).select("key", "size", "text_crc32", "shard", "slot", "grown_shard")
