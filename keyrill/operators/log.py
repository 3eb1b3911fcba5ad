"""The value log: offsets, block flushes, range reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyrill.functions.keys import BLOCK_BYTES
from keyrill.operators.scan import running_total


def value_offsets(log: DataFrame, by: list[str], share: list[str] | None = None) -> DataFrame:
    """Add `offset`: where each value starts in its file, in seq order; share as in running_total()."""
    return running_total(log, by, "seq", F.col("length"), "offset", share=share)


def flush_events(log: DataFrame, by: list[str], block: int = BLOCK_BYTES, flush: str | None = None) -> DataFrame:
    """Add `flush_count` after each append and whether the append `updated` the file.

    A block is written once more bytes come than it has room for, so after C
    bytes there were ceil(C / block) - 1 writes. flush: a boolean column, true
    where the file was flushed right after the append; that is one write more,
    and the next block begins there. `updated` tells of the append alone.
    """
    writes = lambda c: F.when(c > 0, F.ceil(c / F.lit(block)) - 1).otherwise(F.lit(0)).cast("long")
    rows = value_offsets(log, by, share=["length"] if flush is None else None)
    if flush is None:
        rows = rows.withColumn("flush_count", writes(F.col("offset") + F.coalesce("length", F.lit(0))))
        return rows.withColumn("updated", F.col("flush_count") > writes(F.col("offset")))
    flushed = F.coalesce(F.col(flush), F.lit(False))
    # stretches between flushes: their numbers, the bytes before each append in its own, and the writes of those before
    rows = running_total(rows, by, "seq", flushed.cast("long"), "__stretch")
    rows = running_total(rows, [*by, "__stretch"], "seq", F.col("length"), "__at")
    ends = rows.where(flushed).select(*by, "__stretch", (writes(F.col("__at") + F.coalesce("length", F.lit(0))) + 1).alias("__writes"))
    ends = running_total(ends, by, "__stretch", F.col("__writes"), "__before")
    done = ends.select(F.struct(*by, (F.col("__stretch") + 1).alias("s")).alias("__part"), (F.col("__before") + F.col("__writes")).alias("__done"))
    rows = rows.withColumn("__part", F.struct(*by, F.col("__stretch").alias("s"))).join(done, "__part", "left")
    now = writes(F.col("__at") + F.coalesce("length", F.lit(0)))
    rows = rows.withColumn("updated", now > writes(F.col("__at")))
    count = F.coalesce("__done", F.lit(0)) + now + F.when(flushed, 1).otherwise(0)
    return rows.withColumn("flush_count", count.cast("long")).drop("__part", "__stretch", "__at", "__done")


def range_reads(requests: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Add `in_bounds` and `bytes_read` (0 past the end) for (offset, length) requests."""
    rows = requests.join(totals, by, "left")
    return bounded(rows, F.coalesce(F.col("total_bytes"), F.lit(0)))


def bounded(requests: DataFrame, total: Column) -> DataFrame:
    """Add `in_bounds` and `bytes_read` for requests that know their file's bytes."""
    inside = F.col("offset") + F.col("length") <= total
    return requests.withColumn("in_bounds", inside).withColumn("bytes_read", F.when(inside, F.col("length")).otherwise(F.lit(0)).cast("long"))


def range_bytes(requests: DataFrame, values: DataFrame, by: list[str], block: int = BLOCK_BYTES) -> DataFrame:
    """request_id, data: the bytes of each (offset, length) request, null past the file's end.

    values: by, offset, data binary, as value_offsets() places them. Values and
    requests meet in blocks of the file, and a pair counts in the block where
    what they share begins, so a long value or request is cut at no border and
    a large file is spread over its blocks.
    """
    touched = lambda at, n: F.sequence(F.floor(at / F.lit(block)), F.floor(F.greatest(at, at + n - 1) / F.lit(block)))
    size = F.octet_length("data").cast("long")
    held = values.where(size > 0).select(*by, F.col("offset").alias("__at"), size.alias("__size"), "data")
    spread = held.withColumn("__block", F.explode(touched(F.col("__at"), F.col("__size"))))
    asked = requests.select("request_id", *by, "offset", "length").withColumn("__block", F.explode(touched(F.col("offset"), F.col("length"))))
    begin, end = F.greatest("offset", "__at"), F.least(F.col("offset") + F.col("length"), F.col("__at") + F.col("__size"))
    met = asked.join(spread, [*by, "__block"]).where((begin < end) & (F.floor(begin / F.lit(block)) == F.col("__block")))
    piece = F.substr(F.col("data"), (begin - F.col("__at") + 1).cast("int"), (end - begin).cast("int"))
    read = met.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(begin.alias("at"), piece.alias("piece")))).alias("pieces"))
    joined = F.aggregate(F.col("pieces"), F.lit(b""), lambda whole, p: F.concat(whole, p["piece"]))
    rows = requests.select("request_id", "length").join(read.select("request_id", joined.alias("data")), "request_id", "left")
    found = F.coalesce("data", F.lit(b""))
    return rows.select("request_id", F.when(F.octet_length(found) == F.col("length"), found).alias("data"))
