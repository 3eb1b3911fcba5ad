import base64
import hashlib
import io
import zlib

import pytest

from keyrill.llm import warc
from keyrill.llm.queries import QUERIES
from tests.oracle import SF


def expected(pages, min_bytes=0):
    first, out = {}, {}
    for p in sorted(pages):
        body = (pages[p] or "").encode()
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        lead = first.setdefault(sha, p)
        out[p] = (len(body), sha, *(("response", None) if lead == p or len(body) < min_bytes else ("revisit", lead)))
    return out


def test_query_equals_brute_force(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op1_warc"](spark, SF).collect()}
    assert rows == expected(pages)


def test_null_empty_long_and_repeated(spark):
    pages = {1: None, 2: "", 3: "é" * 100_000, 4: "x", 5: "é" * 100_000, 6: "x"}
    df = spark.createDataFrame([(k, None if k == 2 else f"http://h/{k}\r\nX: y", v, "clash") for k, v in pages.items()], "page_id long, url string, html string, sha string")
    rows = warc.read_archives(warc.write_archives(df)).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == expected(pages)
    assert {r.page_id: bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {1: "", 3: pages[3], 4: "x"}
    rows = warc.read_archives(warc.write_archives(df, min_bytes=2)).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == expected(pages, 2)
    odd = spark.createDataFrame([(None, None, "a"), (7, "u", "a"), (7, "u", "a"), (None, None, None)], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(odd)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == [(0, "response", 0), (0, "revisit", 7), (7, "response", 0), (7, "response", 0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(df)).count() == 0


def test_damage_is_found():
    good = warc.page_record(1, "u", b"abc" * 9000, warc.digest(b"abc" * 9000), 27000, None)
    assert [h["warc-type"] for h, _ in warc.read_records(io.BytesIO(good * 3))] == ["response"] * 3
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good + good[:-9])))
    headers, block = warc.parse(next(warc.members(io.BytesIO(good))))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(warc.record({k: v for k, v in headers.items() if k != "content-length"}, block.replace(b"abc", b"abd", 1)))))
    with pytest.raises(warc.WarcError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n")


def member(head, block=b""):
    z = zlib.compressobj(wbits=31)
    return z.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def test_archives_of_other_writers(spark, tmp_path):
    http, body = b"HTTP/1.1 200 OK\r\nServer:x\r\n\r\n", b"<p>hello</p>"
    sha = hashlib.sha1(body).hexdigest()
    records = [
        member("WARC/1.0\r\nWARC-Type:warcinfo\r\nContent-Length:4", b"a: b"),
        member(f"WARC/1.0\r\nwarc-type: response\r\nWARC-Target-URI:http://h/a b\r\ncontent-type:application/http; msgtype=response\r\nCONTENT-LENGTH:  {len(http + body)}", http + body),
        member(f"WARC/1.0\r\nWARC-Type: request\r\nContent-Type: application/http\r\nContent-Length: {len(http)}", http),
        member(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Payload-Digest: SHA1:{sha}\r\nX-Long: one\r\n two\r\nContent-Length: {len(body)}", body),
        member(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:0000\r\nWARC-Block-Digest: md5:00\r\nContent-Length: {len(body)}", body),
        member("WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0"),
        member("WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Payload-Digest: sha1:" + "A" * 32 + "\r\nContent-Length: 0"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    own = base64.b32encode(hashlib.sha1(body).digest()).decode()
    empty = base64.b32encode(hashlib.sha1(b"").digest()).decode()
    rows = sorted((r.record_type, r.url or "", r.payload_bytes, r.payload_digest) for r in warc.read_archives(paths).collect())
    assert rows == sorted([("warcinfo", "", None, None), ("response", "http://h/a b", 12, own), ("request", "", 0, empty), ("resource", "", 12, own), ("response", "", 12, own), ("metadata", "", None, None), ("revisit", "", None, "A" * 32)], key=str)


@pytest.mark.parametrize("data", [
    b"not gzip at all", member("HTTP/1.1 200 OK"), member("WARC/1.0\r\nWARC-Type: response"), member("WARC/1.0\r\nContent-Length: 0"), member("WARC/1.0\r\nno header here\r\nContent-Length: 0"),
    member("WARC/1.0\r\nWARC-Type: x\r\nContent-Length: many"), member("WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 9", b"ab"), member("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:" + "A" * 32 + "\r\nContent-Length: 1", b"x"),
    member("WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 0")[:-1], member("WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 0")[:3],
])
def test_all_damage_is_a_warc_error(data):
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data)))


def test_bad_numbers_are_damage():
    with pytest.raises(warc.WarcError):
        warc.row_of({"warc-type": "revisit", "x-page-id": "seven"}, b"", False)


def test_files_hold_one_gzip_member_for_each_record(spark):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(df).first().path
    data, found = open(path.removeprefix("file://"), "rb").read(), []
    while data:
        z = zlib.decompressobj(31)
        found.append(z.decompress(data))
        data = z.unused_data
    assert len(found) == 5 and all(x.startswith(b"WARC/1.1\r\n") for x in found)
