"""Deterministic put logs for tests and load runs, made where they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, name: str, n: Column, below: int) -> Column:
    """A number under `below`, fixed by seed, name and n."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), n), F.lit(below))


def printable(seed: int, n: Column, low: int, high: int) -> Column:
    """Text of low to high - 1 hex digits (low, if they are equal), fixed by seed and n."""
    size = F.lit(low) + (draw(seed, "size", n, high - low) if high > low else F.lit(0))
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(size / 64)), lambda i: F.sha2(F.concat_ws(":", F.lit(str(seed)), n, i), 256)), "")
    return F.substring(digits, F.lit(1), size.cast("int"))


def put_log(spark: SparkSession, puts: int, keys: int, seed: int = 1, low: int = 100, high: int = 200, repeat: float = 0.0) -> DataFrame:
    """seq, key, value, length: puts to `keys` keys; a share `repeat` of them gives a key its first value again."""
    rows = spark.range(puts).withColumnRenamed("id", "seq").withColumn("k", draw(seed, "key", F.col("seq"), keys))
    again = draw(seed, "again", F.col("seq"), 1_000_000) < int(repeat * 1_000_000)
    value = printable(seed, F.when(again, -1 - F.col("k")).otherwise(F.col("seq")), low, high)
    return rows.select("seq", F.sha2(F.concat_ws(":", F.lit(str(seed)), "k"), 256).alias("key"), value.alias("value")).withColumn("length", F.octet_length("value").cast("long"))
