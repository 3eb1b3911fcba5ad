"""Stored state: Parquet in hash buckets, and readers of binary key files."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyrill.functions.keys import ENTRY_BYTES, bin_of, shard_of

#: Directories of a store; shards share them, since 512 directories of small files cost more than they prune.
BUCKETS = 16
#: Entries of a key file that one read takes, 12 MB.
READ_ENTRIES = 1 << 18
#: A key file's entry.
ENTRY = np.dtype([("key", "V32"), ("offset", ">u8"), ("length", ">u8")])


def write_store(state: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write (key, value, ...) rows clustered by bucket and sorted by shard and key.

    Key filters then skip row groups by their statistics and Bloom filters.
    """
    rows = state.withColumn("shard", shard_of(F.col("key"))).withColumn("bucket", F.col("shard") % buckets)
    rows = rows.repartition("bucket", F.col("shard")).sortWithinPartitions("bucket", "shard", "key")
    rows.write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert(spark: SparkSession, path: str, to: str, puts: DataFrame) -> None:
    """Merge a put log into the store at `path`; the new store is written at `to`.

    The old one stays whole until the caller swaps the paths.
    """
    old = open_store(spark, path).select("key", "value", F.lit(-1).cast("long").alias("seq"))
    merged = old.unionByName(puts.select("key", "value", "seq")).groupBy("key").agg(F.max(F.struct("seq", "value")).alias("t"))
    write_store(merged.select("key", F.col("t.value").alias("value")), to)


def get_one(store: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The row of one key: filters on bucket, shard and key all reach the scan."""
    shard = int(key[8:16], 16) % 512
    return store.where((F.col("bucket") == shard % buckets) & (F.col("shard") == shard) & (F.col("key") == key))


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, at in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist(), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as file:
                skip = int.from_bytes(file.read_at(4, 4), "big")
                data = file.read_at(READ_ENTRIES * ENTRY_BYTES, skip + at * ENTRY_BYTES) if skip + at * ENTRY_BYTES < file.size() else b""
            rows = np.frombuffer(data, ENTRY, len(data) // ENTRY_BYTES)
            columns = [pa.array([path] * len(rows), pa.string()), pa.array([k.hex() for k in map(bytes, rows["key"])], pa.string()), pa.array(rows["offset"].astype(np.int64)), pa.array(rows["length"].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "key", "offset", "length"])


def read_key_files(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """path, key, offset, length of binary key files (a header, then 48-byte entries).

    A file is read in ranges of READ_ENTRIES entries, each by one task, so its
    size is no limit; bytes after the last whole entry are passed over.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    last = F.floor(F.col("length") / F.lit(ENTRY_BYTES)).cast("long")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(READ_ENTRIES).cast("long"))).alias("at"))
    return ranges.repartition("path", "at").mapInArrow(_entries, "path string, key string, offset long, length long")


def key_file_bytes(header_hex: str, entries_hex: list[str]) -> bytes:
    """A small key file's bytes, for tools that read that form."""
    return bytes.fromhex(header_hex + "".join(entries_hex))


def write_key_files(entries: DataFrame, folder: str, bins: int) -> DataFrame:
    """Write (shard, key, offset, length) as one binary key file a shard; returns path, shard, entries.

    A file has a header with the offset of each of `bins` bins, then its
    entries by bin and key. Bins are counted by aggregation and a shard's
    counts (`bins` numbers) precede its entries in the one task that writes
    it, so entries stream through. An attempt writes files of its own name; the
    returned table, stored beside them, lists those that count.
    """
    spark = entries.sparkSession
    rows = entries.select(F.col("shard").cast("int"), bin_of(F.col("key"), bins).alias("bin"), "key", F.col("offset").cast("long"), F.col("length").cast("long"))
    counts = rows.groupBy("shard", "bin").agg(F.count("*").alias("n")).groupBy("shard").agg(F.collect_list(F.struct("bin", "n")).alias("counts"))
    nothing = F.lit(None)
    heads = counts.select("shard", F.lit(-1).alias("bin"), nothing.cast("string").alias("key"), nothing.cast("long").alias("offset"), nothing.cast("long").alias("length"), "counts")
    both = rows.withColumn("counts", F.lit(None).cast(dict(heads.dtypes)["counts"])).unionByName(heads)
    both = both.repartition("shard").sortWithinPartitions("shard", "bin", "key")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done, now = None, [], []
        for batch in batches:
            for shard, at, key, offset, length, counted in zip(*(batch.column(c).to_pylist() for c in ("shard", "bin", "key", "offset", "length", "counts")), strict=True):
                if at < 0:
                    if out is not None:
                        out.close()
                    name, n = f"Shard{shard:04d}-{uuid.uuid4().hex}.dat", np.zeros(bins, np.int64)
                    for c in counted:
                        n[c["bin"]] = c["n"]
                    ends = 8 * bins + 16 + np.cumsum(n) * ENTRY_BYTES
                    now = [f"{folder}/{name}", shard, int(n.sum())]
                    done.append(now)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(bins.to_bytes(4, "big") + (8 * bins + 16).to_bytes(4, "big") + (ends - n * ENTRY_BYTES).astype(">u8").tobytes() + int(ends[-1]).to_bytes(8, "big"))
                else:
                    out.write(bytes.fromhex(key) + offset.to_bytes(8, "big") + length.to_bytes(8, "big"))
        if out is not None:
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)], ["path", "shard", "entries"])

    listed = f"{folder}/files-{uuid.uuid4().hex}"
    both.mapInArrow(write, "path string, shard int, entries long").write.parquet(listed)
    return spark.read.schema("path string, shard int, entries long").parquet(listed)
