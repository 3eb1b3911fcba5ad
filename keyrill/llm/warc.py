"""WARC archives: a writer, and a sequential reader that checks what it reads."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyrill.llm.shared import columns, cut, new_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 16


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes | None, sha: str, size: int, refers_to: int | None) -> bytes:
    """A response with its HTTP block, or for payload None a revisit."""
    headers = {
        "WARC-Type": "revisit" if payload is None else "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http;msgtype=response",
        "X-Payload-Length": str(size),
    }
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    if url is not None:
        # a header ends at a line's end, which no valid address holds
        headers["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if payload is None:
        headers |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": str(refers_to)}
        return record(headers, b"")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return record(headers | {"WARC-Block-Digest": f"sha1:{digest(block)}"}, block)


class WarcError(ValueError):
    """A record that is cut off, badly framed or not as its digest says."""


def members(file: BinaryIO) -> Iterator[bytes]:
    """The gzip members of a file, each decompressed piece by piece."""
    rest = b""
    while True:
        z, out = zlib.decompressobj(31), []
        begun = False
        while not z.eof:
            data = rest or file.read(READ)
            rest = b""
            if not data:
                if begun:
                    raise WarcError("the last record is cut off")
                return
            begun = True
            try:
                out.append(z.decompress(data))
            except zlib.error as damage:
                raise WarcError(f"a record can't be decompressed: {damage}") from damage
        rest = z.unused_data
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of one record; the framing and all SHA-1 digests must hold.

    White space around a value counts for nothing, a line that begins with
    some goes on with the value before, and of several headers with one name
    the first counts. Digests by other algorithms or in other forms than
    base32 and hexadecimal can't be checked and are passed over.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise WarcError("not a WARC record")
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            headers[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise WarcError(f"not a header: {line[:80]!r}")
        if name in headers:
            name = ""
            continue
        headers[name] = value.strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise WarcError("no Content-Length")
    if len(rest) != int(size) + 4 or rest[int(size) :] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {size} does not frame the record")
    if not headers.get("warc-type"):
        raise WarcError("no WARC-Type")
    block = rest[: int(size)]
    if (want := sha1_of(headers.get("warc-block-digest"))) and want != digest(block):
        raise WarcError("the block digest does not match")
    if (want := sha1_of(headers.get("warc-payload-digest"))) and headers["warc-type"].lower() in WITH_PAYLOAD and "warc-segment-number" not in headers and want != digest(payload_of(headers, block)):
        raise WarcError("the payload digest does not match")
    return headers, block


#: Records whose block holds the payload that their payload digest is of.
WITH_PAYLOAD = ("response", "resource", "request", "conversion")


def sha1_of(value: str | None) -> str | None:
    """The base32 form of a SHA-1 digest header; None if it is no such digest."""
    kind, _, text = (value or "").partition(":")
    text = text.strip()
    if kind.strip().lower() not in ("sha1", "sha-1"):
        return None
    if len(text) == 40 and not text.strip("0123456789abcdefABCDEF"):
        return base64.b32encode(bytes.fromhex(text)).decode()
    return text.upper() if len(text) == 32 else None


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP head, or all of a block that isn't HTTP."""
    http = headers.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    return block.partition(b"\r\n\r\n")[2] if http else block


def read_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    for data in members(file):
        yield parse(data)


SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def whole_number(headers: dict[str, str], name: str) -> int | None:
    value = headers.get(name)
    if value is None:
        return None
    try:
        return int(value)
    except ValueError:
        raise WarcError(f"{name} is no number: {value[:80]!r}") from None


def row_of(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """A record as a row of SCHEMA."""
    kind = headers["warc-type"].lower()
    body = payload_of(headers, block) if kind in WITH_PAYLOAD else None
    sha = sha1_of(headers.get("warc-payload-digest")) or (digest(body) if body is not None else None)
    size = whole_number(headers, "x-payload-length") if body is None else len(body)
    return whole_number(headers, "x-page-id"), headers.get("warc-target-uri"), kind, whole_number(headers, "x-refers-to-page-id"), size, sha, body if payloads else None



def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write one archive per task; returns path, records of those that are complete.

    Of payloads of at least min_bytes that are equal, the one with the least
    page_id is a response and the others revisit it; a null page_id counts as
    the largest, and repeated rows with the least id are all responses. Null
    html is an empty payload; a null url has no target header. Files have names
    of their own for each attempt of a task, and the returned table, written
    after them, lists those of the attempts that count.
    """
    spark = pages.sparkSession
    rows = columns(pages, page_id=page_id, url=url, html=html)
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = rows.withColumn("sha", F.sha1(body)).withColumn("size", F.octet_length(F.coalesce("html", F.lit(""))).cast("long"))
    # a table of repeated payloads alone: Spark knows its size and broadcasts it only if that is small
    firsts = rows.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    rows = rows.join(cut(firsts.where("copies > 1").drop("copies"), "payloads"), "sha", "left")
    lone = F.col("first_id").isNull() | (F.col("page_id").eqNullSafe(F.col("first_id")))
    rows = rows.select("page_id", "url", "sha", "size", F.when(lone, F.coalesce("html", F.lit(""))).alias("html"), F.when(~lone, F.col("first_id")).alias("refers_to"))
    folder = new_path(spark, "warc")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        path, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                payload = None if row["html"] is None else row["html"].encode()
                sha = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                out.write(page_record(row["page_id"], row["url"], payload, sha, row["size"], row["refers_to"]))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [n]})

    return cut(rows.mapInArrow(write, "path string, records long"), "warc-list")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in column `path`, one task for each few files.

    Columns: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (null for revisits, and for all unless wanted).
    Archives of other writers are read too: records of every type have a row,
    in which what their headers don't tell is null. A record that is cut off,
    badly framed or not as its digest says raises WarcError.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as file:
                    for headers, block in read_records(file):
                        rows.append(row_of(headers, block, payloads))
                        held += len(block) if payloads else 0
                        if len(rows) == 4096 or held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = archives.select("path").repartitionByRange(_tasks(archives.sparkSession), "path")
    return files.mapInArrow(read, SCHEMA)


def _tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
