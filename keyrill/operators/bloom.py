"""Membership filters: bit positions, filters as bitmaps of 4 KiB, and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyrill.functions.keys import bloom_position


def positions(keys: DataFrame, mb: float, hashes: int) -> DataFrame:
    """key, byte_index, bit: one row per key and hash."""
    if hashes < 1:
        raise ValueError("a filter needs one hash or more")
    rows = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(min(hashes, 3) - 1))).alias("__n"))
    return rows.select("key", bloom_position(F.col("key"), F.col("__n"), mb).alias("__p")).select("key", "__p.byte_index", "__p.bit")


def bits(keys: DataFrame, mb: float = 1, hashes: int = 3) -> DataFrame:
    """byte_index, bit of every set bit."""
    return positions(keys, mb, hashes).select("byte_index", "bit").distinct()


def build(keys: DataFrame, mb: float = 1, hashes: int = 3) -> DataFrame:
    """bucket, bitmap: the filter as bitmaps of 32,768 bits.

    Bits are set before the shuffle, so it moves bitmaps and not keys; the
    table has at most 256 rows for each megabyte of the filter. Null keys set
    no bit.
    """
    at = (F.col("byte_index") * 8 + F.col("bit")).cast("long")
    rows = positions(keys.where(F.col("key").isNotNull()), mb, hashes).select(at.alias("at"))
    # the built-in functions count from 1
    return rows.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bitmap"))


def probe(bitmaps: DataFrame, keys: DataFrame, mb: float = 1, hashes: int = 3) -> DataFrame:
    """key, maybe_present of each different key; false is certain. A null key may be present."""
    at = (F.col("byte_index") * 8 + F.col("bit")).cast("long") + 1
    wanted = positions(keys.select("key").distinct(), mb, hashes).select("key", F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).cast("int").alias("at"))
    byte = F.conv(F.hex(F.substr(F.col("bitmap"), F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # not F.shiftright, which takes no column for the number of places
    is_set = F.expr("shiftright(byte, at % 8) & 1") == 1
    hits = wanted.join(bitmaps, "bucket", "left").withColumn("byte", byte).withColumn("set", F.coalesce(is_set, F.col("key").isNull()))
    return hits.groupBy("key").agg(F.min("set").alias("maybe_present"))


def filtered_get(probes: DataFrame, state: DataFrame, bitmaps: DataFrame, mb: float = 1, hashes: int = 3) -> DataFrame:
    """probe (probe_id, key) -> probe_id, key, maybe_present, found, value.

    Only keys that the filter may hold meet the state; for the others, the
    filter's answer is the lookup's.
    """
    told = probes.join(probe(bitmaps, probes, mb, hashes), "key", "left")
    told = told.withColumn("maybe_present", F.coalesce("maybe_present", F.lit(True)))
    wanted = told.where("maybe_present").join(state.select("key", "value", F.lit(True).alias("found")), "key", "left")
    rest = told.where("NOT maybe_present").withColumn("value", F.lit(None).cast(dict(state.dtypes)["value"])).withColumn("found", F.lit(False))
    return wanted.unionByName(rest).select("probe_id", "key", "maybe_present", F.coalesce("found", F.lit(False)).alias("found"), "value")
