import random

import pytest
from pyspark.sql import functions as F

from keyrill.functions import keys as K
from keyrill.operators import bloom, index, log, router, store, views
from keyrill.operators.router import Layers
from keyrill.operators.scan import running_total
from keyrill.sources import logs, storage
from keyrill.streaming.router import expiry_stream, route_stream
from tests.oracle import SF


def puts(spark, rows):
    return spark.createDataFrame(rows, "seq long, key string, value string").withColumn("length", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long"))


def random_log(n=600, keys=7, seed=1):
    r = random.Random(seed)
    return [(i, f"{r.randrange(keys):064x}", r.choice(["a", "b", "", None])) for i in range(n)]


def test_route_matches_model_across_blocks(spark):
    rows = random_log()
    for width in (1, 13, 1 << 20):
        found = {r.seq: r.action for r in router.route(puts(spark, rows), width).collect()}
        states, want = {}, {}
        for seq, key, value in rows:
            want[seq] = states.setdefault(key, Layers()).apply("put", value)
        assert found == want


def test_layers_agree_with_latest(spark):
    df = puts(spark, random_log(300))
    got = {r["key"]: r["value"] for r in router.get(df).collect()}
    assert got == {r["key"]: r["value"] for r in store.latest(df).collect()}


def test_mixed_ops_matches_model_across_blocks(spark):
    r = random.Random(3)
    rows = [(i, k, v, r.choice(["put", "put_dyna", "put_perm", "put_perm"])) for i, k, v in random_log(900, 120)]
    states, want = {}, {}
    for seq, key, value, op in rows:
        want[seq] = states.setdefault(key, Layers()).apply(op, value)
    df = spark.createDataFrame(rows, "seq long, key string, value string, op string")
    for width in (1, 50, 1 << 20):
        assert {r.seq: r.action for r in router.mixed_ops(df, width).collect()} == want


def test_write_once_outcomes_across_blocks(spark):
    rows = random_log(300, 5)
    want = {r.seq: (r.outcome, r.kv_outcome) for r in store.immutable_outcome(puts(spark, rows)).collect()}
    first = {}
    for seq, key, value in rows:
        new = key not in first
        assert want[seq] == (("inserted", "inserted") if new else ("noop" if first[key] == value else "rejected", "rejected"))
        first.setdefault(key, value)
    assert {r.seq: (r.outcome, r.kv_outcome) for r in store.immutable_outcome(puts(spark, rows), 7).collect()} == want


def test_expiry_at_the_edge_of_the_timeout(spark):
    at = [(1, 0), (1, 10), (1, 20), (1, 31), (1, 31), (2, 9), (2, 20), (3, None), (3, 5)]
    df = spark.createDataFrame(at, "h int, s int").selectExpr("h", "timestamp_seconds(s) AS ts", "0L AS seq")
    got = {(r.h, r.session, r.accesses, r.start and r.start.second, r.end and r.end.second) for r in views.expiry(df, "h", "ts", 10).collect()}
    assert got == {(1, 0, 3, 0, 20), (1, 1, 2, 31, 31), (2, 0, 1, 9, 9), (2, 1, 1, 20, 20), (3, 0, 2, 5, 5)}


def test_empty_log(spark):
    df = puts(spark, [])
    assert router.route(df).count() == store.latest(df).count() == log.value_offsets(df, ["key"]).count() == 0
    assert index.offset_table(spark, store.latest(df), 4).count() == 4


def test_nil_key_is_not_stored(spark):
    assert index.key_list(puts(spark, [(1, K.NIL_KEY, "x"), (2, "1" * 64, "y")]), 8).count() == 1


def test_flush_on_exact_fill_and_long_values(spark):
    df = spark.createDataFrame([(1, "f", 32768), (2, "f", 1), (3, "f", 100000), (4, "f", 0)], "seq long, file string, length long")
    rows = {r.seq: (r.flush_count, r.updated) for r in log.flush_events(df, ["file"]).collect()}
    assert rows == {1: (0, False), 2: (1, True), 3: (4, True), 4: (4, False)}


def test_entry_codec_and_short_entry(spark):
    row = spark.sql(f"SELECT '{'ab' * 32}' AS key, 5L AS offset, 7L AS length").select(K.encode_entry(F.col("key"), F.col("offset"), F.col("length")).alias("e"))
    e = row.select("e", K.decode_entry(F.col("e")).alias("d"), K.decode_entry(F.substring("e", 1, 20)).alias("s")).first()
    assert (e.d.key, e.d.offset, e.d.length, e.d.error) == ("ab" * 32, 5, 7, None)
    assert e.s.error == "entry cut off after 10 bytes" and e.s.key is None


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    key = lambda a, b: spark.range(a, b).select(K.key_of(F.col("id")).alias("key"))
    bitmaps = bloom.build(key(0, 4000), 0.05)
    assert bloom.probe(bitmaps, key(0, 4000), 0.05).where(~F.col("maybe_present")).count() == 0
    assert bloom.probe(bitmaps, key(10000, 14000), 0.05).where("maybe_present").count() < 200
    assert bitmaps.count() <= 13 and bitmaps.select(F.sum(F.bitmap_count("bitmap"))).first()[0] == bloom.bits(key(0, 4000), 0.05).count()
    for args in ((-1, 3), (1, 0)):
        with pytest.raises(ValueError):
            bloom.build(key(0, 1), *args)
    probes = key(3998, 4002).withColumn("probe_id", F.lit(1)).unionByName(spark.createDataFrame([(None, 2)], "key string, probe_id int"))
    got = bloom.filtered_get(probes, key(0, 4000).withColumn("value", F.lit("v")), bitmaps, 0.05).collect()
    assert sorted((r.found, r.value or "") for r in got) == [(False, "")] * 3 + [(True, "v")] * 2


def test_null_groups_and_seqs_lose_no_row(spark):
    rows = [(1, None, 5), (2, "f", 7), (3, None, 1), (None, "f", 2), (None, None, 3), (4, "f", None), (9, "f", 4)]
    df = spark.createDataFrame(rows, "seq long, file string, length long")
    for width in (1, 2, 1 << 20):
        got = running_total(df, ["file"], "seq", F.col("length"), "offset", width, total="all").collect()
        assert sorted((str(r.file), r.seq or 0, r.offset, r["all"]) for r in got) == [("None", 0, 0, 9), ("None", 1, 3, 9), ("None", 3, 8, 9), ("f", 0, 0, 13), ("f", 2, 2, 13), ("f", 4, 9, 13), ("f", 9, 9, 13)]
    assert log.flush_events(df, ["file"]).count() == index.generations(df, ["file"], 1).count() == 7


def test_null_keys_lose_no_row(spark):
    rows = [(i, None if r % 3 == 0 else f"{r % 5:064x}", v) for i, (r, v) in enumerate(zip(range(60), "abca" * 15, strict=True))]
    states, want, first = {}, {}, {}
    for seq, key, value in rows:
        want[seq] = states.setdefault(key, Layers()).apply("put", value)
        first.setdefault(key, value)
    for width in (1, 8, 1 << 20):
        assert {r.seq: r.action for r in router.route(puts(spark, rows), width).collect()} == want
        got = {r.seq: r.outcome for r in store.immutable_outcome(puts(spark, rows), width).collect()}
        assert len(got) == 60 and all(got[s] == "inserted" or got[s] == ("noop" if first[k] == v else "rejected") for s, k, v in rows)
    assert {r.key: r.value for r in router.get(puts(spark, rows)).collect()} == {k: (s.dyna or s.perm)[0] for k, s in states.items()}


def test_scan_reads_rows_once(spark, tmp_path):
    spark.range(1000).selectExpr("id AS seq", "id % 7 AS file", "id % 100 AS length", "id AS more").write.parquet(str(tmp_path / "t"))
    df = running_total(spark.read.parquet(str(tmp_path / "t")), ["file"], "seq", F.col("length"), "offset", share=["length", "more"])
    assert df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "Reused" in final
    log = spark.read.parquet(str(tmp_path / "t")).selectExpr("seq", "cast(file AS string) AS key", "cast(length AS string) AS value")
    df = router.route(log)
    assert df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "Reused" in final


def test_explicit_flush_begins_a_block(spark):
    df = spark.createDataFrame([(1, "f", 30000, True), (2, "f", 30000, None), (3, "f", 30000, True), (4, "f", 32768, False), (5, "g", 1, True), (6, "g", 0, True)], "seq long, file string, length long, flush boolean")
    got = {r.seq: (r.flush_count, r.updated) for r in log.flush_events(df, ["file"], flush="flush").collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (3, True), 4: (3, False), 5: (1, False), 6: (2, False)}


def test_range_bytes_against_the_file(spark):
    r = random.Random(2)
    values = [bytes(r.randrange(256) for _ in range(r.choice((0, 1, 7, 40, 300)))) for _ in range(60)]
    files = {f: b"".join(v for i, v in enumerate(values) if i % 2 == f) for f in (0, 1)}
    df = spark.createDataFrame([(i, i % 2, v, len(v)) for i, v in enumerate(values)], "seq long, file int, data binary, length long")
    held = log.value_offsets(df, ["file"])
    asked = [(n, n % 3 % 2 if n else 7, r.randrange(len(files[0])), r.choice((0, 1, 64, 65, 1000))) for n in range(120)]
    rows = log.range_bytes(spark.createDataFrame(asked, "request_id long, file int, offset long, length long"), held, ["file"], block=64).collect()
    got = {x.request_id: None if x.data is None else bytes(x.data) for x in rows}
    for n, f, at, size in asked:
        data = files.get(f, b"")
        assert got[n] == (data[at : at + size] if at + size <= len(data) or not size else None), (n, f, at, size)


def test_view_validity_closing_and_activity(spark):
    at = [(1, 0), (1, 9), (1, 30), (1, 31), (2, 5), (2, 14), (None, 3), (3, None)]
    df = spark.createDataFrame(at, "h int, s int").selectExpr("h", "timestamp_seconds(s) AS ts")
    order = lambda rows: sorted((r.h or 0, r.ts.second if r.ts else -1, r.valid) for r in rows)
    assert order(views.validity(df, "h", "ts", 10).collect()) == [(0, 3, True), (1, 0, True), (1, 9, True), (1, 30, False), (1, 31, False), (2, 5, True), (2, 14, True), (3, -1, False)]
    closes = spark.sql("SELECT 2 AS h, timestamp_seconds(8) AS closed_at")
    assert order(views.validity(df, "h", "ts", 10, closes).collect())[-2:] == [(2, 14, False), (3, -1, False)]
    alive = lambda s: {r.h: r.active for r in views.active(df, "h", "ts", 10, F.timestamp_seconds(F.lit(s)), closes).collect()}
    assert alive(7) == {1: True, 2: True, None: True} and alive(19) == {1: True, 2: False, None: False} and alive(31)[1] is False


def test_key_files_round_trip(spark, tmp_path):
    r = random.Random(9)
    entries = [(f"{r.getrandbits(256):064x}", i, i % 90) for i in range(500)]
    df = spark.createDataFrame(entries, "key string, offset long, length long").withColumn("shard", K.shard_of(F.col("key")) % 5)
    files = storage.write_key_files(df, f"file://{tmp_path}/keys", 8).collect()
    assert len(files) == 5 and sum(f.entries for f in files) == 500
    back = storage.read_key_files(spark, [f.path for f in files]).collect()
    assert sorted((x.key, x.offset, x.length) for x in back) == sorted(entries)
    for f in files:
        data = open(f.path.removeprefix("file://"), "rb").read()
        head = spark.createDataFrame([(data[:80].hex(),)], "h string").select(K.decode_bin_header(F.col("h")).alias("d")).first().d
        assert (head.bins, head.header_size, head.end) == (8, 80, len(data))
        own = [(data[i : i + 32].hex(), i) for i in range(80, len(data), 48)]
        assert [k for k, _ in own] == sorted((k for k, _ in own), key=lambda k: (int(k[:8], 16) % 8, k))
        for b, start in enumerate(head.offsets):
            assert all((i >= start) == (int(k[:8], 16) % 8 >= b) for k, i in own)
    assert storage.write_key_files(df.limit(0), f"file://{tmp_path}/none", 8).count() == 0


def test_entry_text_and_span_codec(spark):
    row = spark.sql(f"SELECT '{'ab' * 32}' AS k, 5L AS o, 7L AS n")
    assert row.select(K.describe_entry(F.col("k"), F.col("o"), F.col("n"))).first()[0] == f" Key {'ab' * 32}\n Off 5\n Len 7\n"
    assert row.select(K.decode_span(K.encode_span(F.col("o"), F.col("n")))).first()[0][:] == (5, 7)


def test_store_round_trip(spark, tmp_path):
    df = store.latest(logs.event_log(spark, SF)).select("key", "value")
    storage.write_store(df, str(tmp_path / "a"))
    held = storage.open_store(spark, str(tmp_path / "a"))
    assert held.count() == df.count()
    one = df.first()
    got = storage.get_one(held, one.key)
    assert [r.value for r in got.collect()] == [one.value]
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(shard), IsNotNull(key)" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    storage.upsert(spark, str(tmp_path / "a"), str(tmp_path / "b"), puts(spark, [(1, one.key, "new"), (2, "f" * 64, "z")]))
    after = storage.open_store(spark, str(tmp_path / "b"))
    assert after.count() == df.count() + 1 and storage.get_one(after, one.key).first().value == "new"


def test_key_files(spark, tmp_path):
    header = "00000001" + "00000018" + "0" * 14 + "18" + "0" * 14 + "48"
    (tmp_path / "k.dat").write_bytes(storage.key_file_bytes(header, ["cd" * 32 + f"{9:016x}" + f"{4:016x}"]))
    assert [(r.key, r.offset, r.length) for r in storage.read_key_files(spark, str(tmp_path / "*.dat")).collect()] == [("cd" * 32, 9, 4)]


def test_key_files_longer_than_a_read_empty_and_cut_off(spark, tmp_path):
    n = storage.READ_ENTRIES + 3
    header = bytes.fromhex("00000001" + "00000018" + f"{24:016x}" + f"{24 + 48 * n:016x}")
    (tmp_path / "long.dat").write_bytes(header + b"".join(bytes(24) + i.to_bytes(8, "big") + i.to_bytes(8, "big") + (7).to_bytes(8, "big") for i in range(n)) + b"half")
    (tmp_path / "none.dat").write_bytes(header)
    rows = storage.read_key_files(spark, str(tmp_path / "*.dat"))
    r = rows.agg(F.count("*"), F.countDistinct("key"), F.sum("offset"), F.sum("length"), F.countDistinct("path")).first()
    assert tuple(r) == (n, n, n * (n - 1) // 2, 7 * n, 1)
    assert rows.where(F.conv(F.substring("key", 49, 16), 16, 10).cast("long") != F.col("offset")).count() == 0


def run_stream(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_route_stream_equals_batch(spark, tmp_path):
    rows = random_log(200, 5)
    for i in range(2):
        puts(spark, rows[i * 100 : i * 100 + 100]).withColumn("op", F.lit("put")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("seq long, key string, value string, op string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = {r.seq: r.action for r in run_stream(spark, route_stream(source), "routed")}
    assert found == {r.seq: r.action for r in router.route(puts(spark, rows)).collect()}


def test_expiry_stream(spark, tmp_path):
    spark.sql("SELECT 1L AS h, timestamp'2020-01-01 00:00:00' + make_interval(0,0,0,0,x,0,0) AS ts FROM VALUES (0),(1),(30),(200) t(x)").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("h long, ts timestamp").parquet(str(tmp_path / "in"))
    rows = run_stream(spark, expiry_stream(source, "h", "ts", "10 hours", "1 hour"), "expired")
    assert sorted(r.accesses for r in rows) == [1, 2]
