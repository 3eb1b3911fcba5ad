"""Column functions on 32-byte keys, held as 64 lower-case hex digits.

Every function maps Columns to a Column and stays inside Spark's generated
code. Null in, null out, except where a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the storage format.
ENTRY_BYTES = 48
SHARDS = 512
BLOCK_BYTES = 32768
COMPACT_AFTER = 5000
NIL_KEY = "00" * 32


def key_of(value: Column) -> Column:
    """The key of any value: SHA-256 of its text form."""
    return F.sha2(value.cast("string"), 256)


def word32(key: Column, byte: int) -> Column:
    """The unsigned big-endian 32-bit word of the key that starts at a byte."""
    return F.conv(F.substring(key, 1 + 2 * byte, 8), 16, 10).cast("long")


def bin_of(key: Column, bins: int) -> Column:
    return (word32(key, 0) % F.lit(bins)).cast("int")


def shard_of(key: Column, shards: int = SHARDS) -> Column:
    return (word32(key, 4) % F.lit(shards)).cast("int")


def shard_dir(shard: Column) -> Column:
    return F.format_string("Shard%04d", shard)


def u64_hex(value: Column) -> Column:
    """16 hex digits, big-endian."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def u32_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def hex_u64(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def encode_entry(key: Column, offset: Column, length: Column) -> Column:
    """An index entry: key, offset and length as 96 hex digits."""
    return F.concat(key, u64_hex(offset), u64_hex(length))


def decode_entry(entry: Column) -> Column:
    """struct(key, offset, length, error); a short entry has only its error."""
    size = F.length(entry).cast("long") / 2
    fits = F.length(entry) >= 2 * ENTRY_BYTES
    return F.struct(
        F.when(fits, F.substring(entry, 1, 64)).alias("key"),
        F.when(fits, hex_u64(F.substring(entry, 65, 16))).alias("offset"),
        F.when(fits, hex_u64(F.substring(entry, 81, 16))).alias("length"),
        F.when(~fits, F.format_string("entry cut off after %d bytes", size.cast("long"))).alias("error"),
    )


def describe_entry(key: Column, offset: Column, length: Column) -> Column:
    """The three-line text form of an entry, for people."""
    return F.format_string(" Key %s\n Off %d\n Len %d\n", key, offset, length)


def encode_span(start: Column, end: Column) -> Column:
    """A history segment's byte range as 32 hex digits."""
    return F.concat(u64_hex(start), u64_hex(end))


def decode_span(digits: Column) -> Column:
    return F.struct(hex_u64(F.substring(digits, 1, 16)).alias("start"), hex_u64(F.substring(digits, 17, 16)).alias("end"))


def encode_bin_header(offsets: Column, end: Column) -> Column:
    """Count, header size, the offset of each bin, and the end of the list.

    offsets: array<long> in bin order.
    """
    n = F.size(offsets)
    return F.concat(u32_hex(n), u32_hex(n * 8 + 16), F.array_join(F.transform(offsets, u64_hex), ""), u64_hex(end))


def decode_bin_header(digits: Column) -> Column:
    """struct(bins, header_size, offsets, end)."""
    n = hex_u64(F.substring(digits, 1, 8)).cast("int")
    at = lambda i: hex_u64(digits.substr(F.lit(17) + i * 16, F.lit(16)))
    return F.struct(
        n.alias("bins"),
        hex_u64(F.substring(digits, 9, 8)).cast("int").alias("header_size"),
        F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<long>")).alias("offsets"),
        at(n).alias("end"),
    )


def bloom_position(key: Column, n: Column, mb: float) -> Column:
    """struct(byte_index, bit) of the n-th hash in a filter of mb megabytes.

    The hash is one of the key's first three 8-byte words, so more than three
    hashes add nothing. The word is a full unsigned 64-bit number.
    """
    if mb < 0:
        raise ValueError("a filter has at least 0 megabytes")
    digits = key.substr((n * 8) % 24 * 2 + 1, F.lit(16))
    v = (F.conv(digits, 16, 10).cast("decimal(20,0)") % F.lit(int(1024 * 1024 * mb) << 8).cast("decimal(20,0)")).cast("long")
    return F.struct(F.shiftright(v, 8).alias("byte_index"), (v % 8).cast("int").alias("bit"))


def time_per_op(tps: Column) -> Column:
    """The time of one operation at a rate, in ns, us, ms or s."""
    ns = F.lit(1.0) / tps * F.lit(1e9)
    text = lambda unit, by: F.format_string(f"%4.3f {unit}", ns / F.lit(by))
    return F.when(ns < 1e3, text("ns", 1.0)).when(ns < 1e6, text("us", 1e3)).when(ns < 1e9, text("ms", 1e6)).otherwise(text("s", 1e9))
