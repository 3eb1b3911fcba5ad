"""Compaction: what it would free, and the layout it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyrill.functions.keys import shard_dir, shard_of
from keyrill.operators.log import value_offsets
from keyrill.operators.store import latest


def reclaimable(log: DataFrame) -> DataFrame:
    """shard, live_bytes, garbage_bytes of value files."""
    shard = shard_of(F.col("key")).alias("shard")
    rows = log.groupBy("key").agg(F.sum("length").alias("__all"), F.max(F.struct("seq", "length")).alias("__last"))
    rows = rows.groupBy(shard).agg(F.sum("__last.length").alias("live_bytes"), F.sum("__all").alias("__all"))
    return rows.select("shard", "live_bytes", (F.col("__all") - F.col("live_bytes")).alias("garbage_bytes"))


def compressed(log: DataFrame) -> DataFrame:
    """shard, key, new_offset, length after a rewrite that keeps live values in seq order."""
    live = latest(log).withColumn("shard", shard_of(F.col("key")))
    return value_offsets(live, ["shard"]).select("shard", "key", F.col("offset").alias("new_offset"), "length")


def content_copies(log: DataFrame) -> DataFrame:
    """key, copies of content-addressed values."""
    return log.groupBy("key").agg(F.count("*").alias("copies"))


def shard_stats(log: DataFrame) -> DataFrame:
    """shard, dir, keys, bytes of live values."""
    rows = latest(log).groupBy(shard_of(F.col("key")).alias("shard")).agg(F.count("*").alias("keys"), F.sum("length").alias("bytes"))
    return rows.select("shard", shard_dir(F.col("shard")).alias("dir"), "keys", "bytes")
