"""The key index: bins, offset tables, generations and history segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyrill.functions import keys as K
from keyrill.operators.scan import running_total
from keyrill.operators.store import accepted_keys, first, latest


def key_list(log: DataFrame, bins: int) -> DataFrame:
    """bin, key of every live key."""
    return live_keys(log).select(K.bin_of(F.col("key"), bins).alias("bin"), "key")


def live_keys(log: DataFrame) -> DataFrame:
    """key: the different keys alone, without values, so that little is shuffled."""
    return accepted_keys(log).select("key").distinct()


def offset_table(spark: SparkSession, state: DataFrame, bins: int) -> DataFrame:
    """bin, offset, n: where each bin's entries start in the key file, and how many there are.

    state: one row per key. The table has `bins` rows, a parameter; its window runs over them alone.
    """
    counts = accepted_keys(state).groupBy(K.bin_of(F.col("key"), bins).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    table = spark.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left")
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(w), F.lit(0))
    return table.select("bin", (F.lit(8 * bins + 16) + before * K.ENTRY_BYTES).cast("long").alias("offset"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bin_header(table: DataFrame, bins: int) -> DataFrame:
    """One row: header_hex of an offset table."""
    one = table.agg(F.array_sort(F.collect_list(F.struct("bin", "offset"))).alias("t"), F.sum("n").alias("n"))
    return one.select(K.encode_bin_header(F.col("t.offset"), F.lit(8 * bins + 16) + F.col("n") * K.ENTRY_BYTES).alias("header_hex"))


def generations(log: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Add `generation`: puts of a file counted off in runs of limit + 1."""
    rows = running_total(log, by, "seq", F.lit(1), "__n")
    return rows.withColumn("generation", F.floor(F.col("__n") / F.lit(limit + 1)).cast("long")).drop("__n")


def pushed(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The rows of full generations: those a file has pushed to its history."""
    full = rows.groupBy(*by, "generation").agg(F.count("*").alias("__n")).where(F.col("__n") == limit + 1).drop("__n")
    return rows.join(full, [*by, "generation"], "left_semi")


def history_segments(spark: SparkSession, rows: DataFrame, bins: int) -> DataFrame:
    """bin, entries, size_bytes, span_hex of a history file in bin order."""
    counts = rows.groupBy(K.bin_of(F.col("key"), bins).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    table = spark.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("entries"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    end = F.lit(4 + 16 * bins) + F.sum("entries").over(w) * K.ENTRY_BYTES
    size = F.col("entries") * K.ENTRY_BYTES
    return table.withColumn("__end", end).select("bin", "entries", size.alias("size_bytes"), K.encode_span(F.col("__end") - size, F.col("__end")).alias("span_hex"))


def history_get(rows: DataFrame) -> DataFrame:
    """key, value: of all generations the oldest entry wins."""
    top = rows.groupBy("key").agg(F.min(F.struct("generation", "seq", "value")).alias("t"))
    return top.select("key", F.col("t.value").alias("value"))


def visible_generation(log: DataFrame, by: list[str], limit: int) -> DataFrame:
    """key, value left in mutable files that drop all keys at each push."""
    rows = running_total(log, by, "seq", F.lit(1), "__n", total="__all")
    generation = lambda n: F.floor(F.col(n) / F.lit(limit + 1))
    return latest(rows.where(generation("__n") == generation("__all"))).select("key", "value")


def write_once(log: DataFrame) -> DataFrame:
    """The puts a write-once file accepts: each key's first."""
    return first(log)
