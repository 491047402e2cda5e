"""Sharding by jump consistent hashing, in built-in functions only.

The published walk: a 64-bit linear congruential generator seeded with the key
proposes rising shard numbers; the last one below the shard count is the shard.
A key's walk does not depend on the count, so one more shard takes rows only into
itself, about one row in ``n + 1``, and no ring table is kept.

Rules for odd input: a NULL key counts as key 0; a NULL text has size 8 and the
checksum of the empty text; repeated rows get slots of their own; an empty table
gives an empty result. Other columns of the input are not carried along, so
clashing names cannot occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.numbering import running_total
from surveyloom.sources.staging import stage

# Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
# Copies of one document that a row stands for at most when they get their slots.
ROWS_PER_PIECE = 1 << 12
LOW_32 = 0xFFFFFFFF


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """Halves of ``(state * MULTIPLIER + 1) mod 2^64``, in whole numbers that stay below 2^63.

    The multiplier is taken as one upper part and two parts of 16 bits.
    """
    upper, middle, lower = MULTIPLIER >> 32, MULTIPLIER >> 16 & 0xFFFF, MULTIPLIER & 0xFFFF
    by_middle = low * middle
    below = low * lower + F.shiftleft(by_middle.bitwiseAND(0xFFFF), 16) + 1
    above = F.shiftright(below, 32) + F.shiftright(by_middle, 16) + low * upper
    from_high = high * lower + F.shiftleft((high * middle).bitwiseAND(0xFFFF), 16)
    return (above + from_high).bitwiseAND(LOW_32), below.bitwiseAND(LOW_32)


def jumps(key: Column, n_shards: int) -> Column:
    """All shard numbers below ``n_shards`` that the walk of ``key`` stops at, rising, from 0.

    The state of a negative key is its two's complement, as in the published code.
    """
    start = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.struct(
        F.shiftrightunsigned(start, 32).alias("high"),
        start.bitwiseAND(LOW_32).alias("low"),
        F.lit(0).cast("long").alias("at"),
        F.array(F.lit(0).cast("long")).alias("stops"),
    )

    def step(walk: Column, _: Column) -> Column:
        high, low = _next_state(walk["high"], walk["low"])
        # The draw is the upper 31 bits of the state.
        draw = (F.shiftright(high, 1) + 1).cast("double")
        at = F.floor((walk["at"] + 1).cast("double") * (F.lit(float(2**31)) / draw)).cast("long")
        stops = F.when(at < n_shards, F.concat(walk["stops"], F.array(at))).otherwise(walk["stops"])
        moved = F.struct(high.alias("high"), low.alias("low"), at.alias("at"), stops.alias("stops"))
        return F.when(walk["at"] < n_shards, moved).otherwise(walk)

    # Every jump rises by one at least, so n_shards steps always end the walk.
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), zero, step, lambda walk: walk["stops"])


def shard_of(stops: Column, n_shards: int) -> Column:
    return F.array_max(F.filter(stops, lambda s: s < n_shards)).cast("int")


def shard_documents(docs: DataFrame, n_shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row for each document.

    Slots of a shard are gapless from 0 in the order of key, checksum and size. Documents equal in
    all three are one row with a number of copies until they have their slots; the others are cut into
    ranges at points taken from the data, so neither an outlying key nor a frequent one fills a task.
    """
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    known = docs.select("doc_id", (F.octet_length(bytes_).cast("long") + 8).alias("size"), F.crc32(bytes_).alias("text_crc32"))
    rows = (
        known.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("_copies"))
        .withColumn("_stops", jumps(F.col("doc_id"), n_shards + 1))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "_copies",
            shard_of(F.col("_stops"), n_shards).alias("shard"),
            shard_of(F.col("_stops"), n_shards + 1).alias("grown_shard"),
        )
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranges = stage(rows.repartitionByRange("shard", *order).withColumn("_range", F.spark_partition_id()), "shards")
    slots = running_total(ranges, "shard", "_range", order, F.col("_copies"), "_first")
    # Copies are dealt out in pieces, so that no task writes all copies of a document. The number of
    # partitions is named, else they would be merged by the size they have before the copies are written.
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = slots.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(ROWS_PER_PIECE).cast("long"))))
    dealt = pieces.repartition(partitions, "doc_id", "text_crc32", "_from")
    last = F.least(F.col("_from") + ROWS_PER_PIECE, F.col("_copies")) - 1
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("_first") + F.col("_from"), F.col("_first") + last)).alias("slot"),
        "grown_shard",
    )
