"""Every query of the put-log engine, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyrill.functions import keys as K
from keyrill.operators import bloom, compact, index, log, router, store, views
from keyrill.operators.scan import running_total
from keyrill.sources import logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EV = "ev AS (SELECT event_id AS seq, sha256(CAST(user_id AS VARCHAR)) AS key, event_type AS value, CAST(octet_length(encode(event_type)) AS BIGINT) AS length FROM events)"
OR = "ol AS (SELECT o_orderkey AS seq, sha256(CAST(o_custkey AS VARCHAR)) AS key, o_orderstatus AS value, CAST(octet_length(encode(o_orderstatus)) AS BIGINT) AS length FROM orders)"
DOC = "dl AS (SELECT doc_id AS seq, sha256(text) AS key, text AS value, CAST(octet_length(encode(text)) AS BIGINT) AS length, source FROM documents)"
SHARD = "CAST(CAST('0x' || substr(key, 9, 8) AS UBIGINT) % 512 AS INTEGER)"
BIN = "CAST(CAST('0x' || substr(key, 1, 8) AS UBIGINT) % {} AS BIGINT)"
LATEST = "(SELECT key, arg_max(value, seq) AS value, arg_max(length, seq) AS length, max(seq) AS seq FROM {} GROUP BY key)"
LAG = "rt0 AS (SELECT seq, key, value, row_number() OVER w AS rn, lag(value) OVER w AS pv FROM ev WINDOW w AS (PARTITION BY key ORDER BY seq)), rt1 AS (SELECT *, coalesce(max(CASE WHEN rn > 1 AND value IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dy FROM rt0), rt AS (SELECT seq, key, value, CASE WHEN rn = 1 THEN 'PERM_INSERT' WHEN value IS DISTINCT FROM pv THEN 'DYNA_WRITE' WHEN dy = 1 THEN 'NOOP_DYNA' ELSE 'NOOP_PERM' END AS action FROM rt1)"
PERM = "pm AS (SELECT key, arg_min(value, seq) AS value FROM ev GROUP BY key)"
DYNA = "dn AS (SELECT key, arg_max(value, seq) AS value FROM rt WHERE action = 'DYNA_WRITE' GROUP BY key)"
VIEWS = "vw AS (SELECT i AS view_id, CAST(floor((SELECT max(seq) FROM ev) * i / 4) AS BIGINT) AS created FROM (VALUES (1), (2), (3)) t(i))"
SNAP = "sn AS (SELECT view_id, key, arg_max(value, seq) AS value FROM ev JOIN vw ON seq <= created GROUP BY view_id, key)"
#: Keys in a file's history segment and bins of the small header.
LIMIT, BINS, SMALL = 100, 1024, 16


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT o_orderkey, key, CAST({BIN.format(1024)} AS INTEGER) AS bin, {SHARD} AS shard FROM (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS key FROM orders)")
def key_placement(spark, sf_dir):
    rows = logs.table(spark, sf_dir, "orders").select("o_orderkey", K.key_of(F.col("o_orderkey")).alias("key"))
    return rows.select("o_orderkey", "key", K.bin_of(F.col("key"), BINS).alias("bin"), K.shard_of(F.col("key")).alias("shard"))


def _document_shards(spark, sf_dir):
    return logs.document_log(spark, sf_dir).withColumn("shard", K.shard_of(F.col("key")))


def _doc_offsets(spark, sf_dir):
    return log.value_offsets(_document_shards(spark, sf_dir).drop("value", "source"), ["shard"], share=["key", "length"])


OFFSETS = f"of AS (SELECT seq, key, length, {SHARD} AS shard, CAST(coalesce(sum(length) OVER (PARTITION BY {SHARD} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM dl)"


@query(f"WITH {DOC}, {OFFSETS} SELECT seq, key, \"offset\", length FROM of")
def value_offsets(spark, sf_dir):
    return _doc_offsets(spark, sf_dir).select("seq", "key", "offset", "length")


@query(f"WITH {DOC}, {OFFSETS} SELECT seq, key, key || lower(printf('%016x', \"offset\")) || lower(printf('%016x', length)) AS entry_hex, \"offset\", length FROM of")
def entry_codec(spark, sf_dir):
    rows = _doc_offsets(spark, sf_dir).select("seq", K.encode_entry(F.col("key"), F.col("offset"), F.col("length")).alias("entry_hex"))
    back = K.decode_entry(F.col("entry_hex"))
    return rows.withColumn("__e", back).select("seq", F.col("__e.key").alias("key"), "entry_hex", F.col("__e.offset").alias("offset"), F.col("__e.length").alias("length"))


@query(f"WITH {DOC}, {OFFSETS}, tt AS (SELECT shard, sum(length) AS total FROM of GROUP BY shard) SELECT seq, key, \"offset\" + 2 * length <= total AS in_bounds, CAST(CASE WHEN \"offset\" + 2 * length <= total THEN 2 * length ELSE 0 END AS BIGINT) AS bytes_read FROM of JOIN tt USING (shard)")
def range_read(spark, sf_dir):
    """Reads of twice each value's length, some of them past the end."""
    rows = _document_shards(spark, sf_dir).drop("value", "source")
    rows = running_total(rows, ["shard"], "seq", F.col("length"), "offset", total="total_bytes", share=["key", "length"])
    return log.bounded(rows.withColumn("length", F.col("length") * 2), F.col("total_bytes")).select("seq", "key", "in_bounds", "bytes_read")


RANGES = f"fl AS (SELECT shard, string_agg(hex(encode(value)), '' ORDER BY seq) AS h FROM (SELECT *, {SHARD} AS shard FROM dl) GROUP BY shard), rq AS (SELECT seq, shard, \"offset\" + length // 3 AS pos, 2 * length AS n FROM of)"


@query(
    f"WITH {DOC}, {OFFSETS}, {RANGES} "
    "SELECT seq, CASE WHEN pos + n <= length(h) // 2 THEN sha256(substr(h, CAST(1 + 2 * pos AS BIGINT), CAST(2 * n AS BIGINT))) END AS sha FROM rq JOIN fl USING (shard)"
)
def range_bytes(spark, sf_dir):
    """The bytes themselves, of reads that begin inside a value and reach over the next ones."""
    rows = running_total(_document_shards(spark, sf_dir).drop("source"), ["shard"], "seq", F.col("length"), "offset")
    asked = rows.select(F.col("seq").alias("request_id"), "shard", (F.col("offset") + F.floor(F.col("length") / 3)).alias("offset"), (2 * F.col("length")).alias("length"))
    held = rows.select("shard", "offset", F.encode("value", "UTF-8").alias("data"))
    return log.range_bytes(asked, held, ["shard"]).select(F.col("request_id").alias("seq"), F.sha2(F.hex("data"), 256).alias("sha"))


@query(f"WITH {DOC}, c AS (SELECT seq, length, CAST(sum(length) OVER (PARTITION BY source ORDER BY seq) AS BIGINT) AS c FROM dl), f AS (SELECT seq, CASE WHEN c > 0 THEN (c + 32767) // 32768 - 1 ELSE 0 END AS flush_count, CASE WHEN c - length > 0 THEN (c - length + 32767) // 32768 - 1 ELSE 0 END AS before FROM c) SELECT seq AS doc_id, CAST(flush_count AS BIGINT) AS flush_count, flush_count > before AS updated FROM f")
def bfile_flush_events(spark, sf_dir):
    return log.flush_events(logs.document_log(spark, sf_dir).select("seq", "length", "source"), ["source"]).select(F.col("seq").alias("doc_id"), "flush_count", "updated")


FLUSHES = (
    "f0 AS (SELECT *, seq % 50 = 0 AS flush, coalesce(sum(CAST(seq % 50 = 0 AS INTEGER)) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM dl), "
    "f1 AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY source, stretch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM f0), "
    "f2 AS (SELECT *, CASE WHEN pos > 0 THEN (pos + 32767) // 32768 - 1 ELSE 0 END AS w0, CASE WHEN pos + length > 0 THEN (pos + length + 32767) // 32768 - 1 ELSE 0 END AS w FROM f1)"
)


@query(
    f"WITH {DOC}, {FLUSHES} SELECT seq AS doc_id, CAST(coalesce(sum(CASE WHEN flush THEN w + 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + w + CAST(flush AS INTEGER) AS BIGINT) AS flush_count, w > w0 AS updated FROM f2"
)
def bfile_explicit_flush(spark, sf_dir):
    """The file of a source is flushed after every document whose id is divisible by 50."""
    rows = logs.document_log(spark, sf_dir).drop("value").withColumn("flush", F.col("seq") % 50 == 0)
    return log.flush_events(rows, ["source"], flush="flush").select(F.col("seq").alias("doc_id"), "flush_count", "updated")


SOURCES = "sn AS (SELECT seq, length, CASE WHEN seq % 5 <> 0 THEN source END AS source FROM dl)"


@query(f"WITH {DOC}, {SOURCES} SELECT seq, source, CAST(coalesce(sum(length) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM sn")
def value_offsets_null_groups(spark, sf_dir):
    """A fifth of the documents have no source: they are a file of their own."""
    rows = logs.document_log(spark, sf_dir).select("seq", "length", F.when(F.col("seq") % 5 != 0, F.col("source")).alias("source"))
    return log.value_offsets(rows, ["source"]).select("seq", "source", "offset")


@query(f"WITH {EV} SELECT key, value, seq FROM {LATEST.format('ev')}")
def kv_latest(spark, sf_dir):
    return store.latest(logs.event_log(spark, sf_dir)).select("key", "value", "seq")


@query(f"WITH {EV}, pr AS (SELECT c_custkey AS probe_id, sha256(CAST(c_custkey AS VARCHAR)) AS key FROM customer) SELECT probe_id, pr.key, s.key IS NOT NULL AS found, value FROM pr LEFT JOIN {LATEST.format('ev')} s ON pr.key = s.key")
def kv_get(spark, sf_dir):
    """Looks every customer id up among the users; most are absent."""
    probe = logs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("probe_id"), K.key_of(F.col("c_custkey")).alias("key"))
    return store.multi_get(probe, store.latest(logs.event_log(spark, sf_dir)))


@query(f"WITH {EV}, f AS (SELECT key, arg_min(value, seq) AS fv, min(seq) AS fs FROM ev GROUP BY key) SELECT seq, key, CASE WHEN seq = fs THEN 'inserted' WHEN value = fv THEN 'noop' ELSE 'rejected' END AS outcome, CASE WHEN seq = fs THEN 'inserted' ELSE 'rejected' END AS kv_outcome FROM ev JOIN f USING (key)")
def immutable_put_outcome(spark, sf_dir):
    return store.immutable_outcome(logs.event_log(spark, sf_dir))


@query(f"WITH {DOC}, f AS (SELECT key, min(seq) AS fs FROM dl GROUP BY key) SELECT seq, key, CASE WHEN seq = fs THEN 'inserted' ELSE 'noop' END AS outcome, CASE WHEN seq = fs THEN 'inserted' ELSE 'rejected' END AS kv_outcome FROM dl JOIN f USING (key)")
def immutable_put_outcome_docs(spark, sf_dir):
    """Content-addressed values: a repeated key always has the same value."""
    rows = logs.document_log(spark, sf_dir)
    return store.immutable_outcome(rows.withColumn("value", F.col("key")))


@query(f"WITH {EV}, {LAG} SELECT seq, key, action FROM rt")
def kv2_route(spark, sf_dir):
    return router.route(logs.event_log(spark, sf_dir).drop("length")).select("seq", "key", "action")


EVNULL = EV.replace("sha256(CAST(user_id AS VARCHAR))", "CASE WHEN user_id % 7 <> 0 THEN sha256(CAST(user_id AS VARCHAR)) END")


def _null_keys(spark, sf_dir):
    """The events of every seventh user have a null key."""
    rows = logs.table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("seq"), F.when(F.col("user_id") % 7 != 0, K.key_of(F.col("user_id"))).alias("key"), F.col("event_type").alias("value"))


@query(f"WITH {EVNULL}, {LAG} SELECT seq, key, action FROM rt")
def kv2_route_null_keys(spark, sf_dir):
    return router.route(_null_keys(spark, sf_dir)).select("seq", "key", "action")


@query(
    f"WITH {EVNULL}, f AS (SELECT *, first_value(value) OVER (PARTITION BY key ORDER BY seq) AS fv, min(seq) OVER (PARTITION BY key) AS fs FROM ev) "
    "SELECT seq, key, CASE WHEN seq = fs THEN 'inserted' WHEN value = fv THEN 'noop' ELSE 'rejected' END AS outcome, CASE WHEN seq = fs THEN 'inserted' ELSE 'rejected' END AS kv_outcome FROM f"
)
def immutable_put_outcome_null_keys(spark, sf_dir):
    return store.immutable_outcome(_null_keys(spark, sf_dir))


@query(f"WITH {EV}, {LAG}, {PERM}, {DYNA} SELECT pm.key, coalesce(dn.value, pm.value) AS value FROM pm LEFT JOIN dn USING (key)")
def kv2_get(spark, sf_dir):
    return router.get(logs.event_log(spark, sf_dir)).select("key", "value")


@query(f"WITH {EV}, {PERM} SELECT key, value FROM pm")
def kv2_get_perm(spark, sf_dir):
    return router.perm_layer(logs.event_log(spark, sf_dir))


@query(f"WITH {EV}, {LAG}, {DYNA} SELECT key, value FROM dn")
def kv2_get_dyna(spark, sf_dir):
    return router.dyna_layer(logs.event_log(spark, sf_dir))


@query(f"WITH {EV}, {LAG}, {PERM}, {DYNA} SELECT pm.key, pm.value AS perm_value, dn.value AS dyna_value FROM pm JOIN dn USING (key)")
def kv2_shadowed_perm(spark, sf_dir):
    return router.shadowed(logs.event_log(spark, sf_dir))


@query(f"WITH {EV}, {LAG} SELECT {SHARD} AS shard, count(*) FILTER (action = 'DYNA_WRITE') AS dwrites, count(*) FILTER (action = 'PERM_INSERT') AS pwrites, count(*) FILTER (action LIKE 'NOOP%') AS noops FROM rt GROUP BY 1")
def kv2_write_counters(spark, sf_dir):
    return router.write_counters(router.route(logs.event_log(spark, sf_dir)))


@query(f"WITH {EV}, {LAG}, n AS (SELECT {SHARD} AS shard, row_number() OVER (PARTITION BY {SHARD} ORDER BY seq) AS n FROM rt WHERE action = 'DYNA_WRITE') SELECT shard, CAST((n - 1) // 51 AS BIGINT) AS epoch, count(*) AS writes FROM n GROUP BY 1, 2")
def compaction_epochs(spark, sf_dir):
    return router.compaction_epochs(router.route(logs.event_log(spark, sf_dir)), threshold=50)


OPS = "m0 AS (SELECT seq, key, value, CASE seq % 3 WHEN 0 THEN 'put' WHEN 1 THEN 'put_dyna' ELSE 'put_perm' END AS op, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM ev), m1 AS (SELECT *, last_value(CASE WHEN op <> 'put_perm' OR rn = 1 THEN value END IGNORE NULLS) OVER w AS seen, coalesce(bool_or(op = 'put_perm' OR (op = 'put' AND rn = 1)) OVER w, false) AS has_perm FROM m0 WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), m2 AS (SELECT *, op = 'put_dyna' OR (op = 'put' AND rn > 1 AND value IS DISTINCT FROM seen) AS changed FROM m1), mo AS (SELECT *, coalesce(bool_or(changed) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS has_dyna FROM m2)"


@query(f"WITH {EV}, {OPS} SELECT seq, key, CASE WHEN op = 'put_perm' AND has_perm THEN 'PERM_REJECTED' WHEN changed THEN 'DYNA_WRITE' WHEN op = 'put_perm' OR rn = 1 THEN 'PERM_INSERT' WHEN has_dyna THEN 'NOOP_DYNA' ELSE 'NOOP_PERM' END AS action FROM mo")
def kv2_mixed_ops(spark, sf_dir):
    return router.mixed_ops(_mixed(spark, sf_dir)).select("seq", "key", "action")


def _mixed(spark, sf_dir):
    op = F.when(F.col("seq") % 3 == 0, "put").when(F.col("seq") % 3 == 1, "put_dyna").otherwise("put_perm")
    return logs.event_log(spark, sf_dir).drop("length").withColumn("op", op)


MIXED = (
    "mp AS (SELECT key, arg_min(value, seq) AS value FROM mo WHERE (op = 'put_perm' AND NOT has_perm) OR (op = 'put' AND rn = 1) GROUP BY key), "
    "md AS (SELECT key, arg_max(value, seq) AS value FROM mo WHERE changed GROUP BY key)"
)


@query(f"WITH {EV}, {OPS}, {MIXED} SELECT coalesce(md.key, mp.key) AS key, CASE WHEN md.key IS NOT NULL THEN md.value ELSE mp.value END AS value FROM mp FULL JOIN md ON mp.key = md.key")
def kv2_mixed_get(spark, sf_dir):
    """What a read finds after puts into either layer."""
    return router.get(_mixed(spark, sf_dir)).select("key", "value")


@query(f"WITH {EV}, {OPS}, {MIXED} SELECT key, value FROM mp")
def kv2_mixed_get_perm(spark, sf_dir):
    return router.perm_layer(_mixed(spark, sf_dir))


@query(f"WITH {EV}, {OPS}, {MIXED} SELECT key, value FROM md")
def kv2_mixed_get_dyna(spark, sf_dir):
    return router.dyna_layer(_mixed(spark, sf_dir))


def _table_sql(bins: int) -> str:
    return f"kl AS (SELECT {BIN.format(bins)} AS bin FROM (SELECT DISTINCT key FROM ol)), bt AS (SELECT r.range AS bin, count(kl.bin) AS n FROM range({bins}) r LEFT JOIN kl ON kl.bin = r.range GROUP BY 1), ft AS (SELECT bin, CAST({8 * bins + 16} + 48 * coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", CAST(n AS BIGINT) AS n FROM bt)"


@query(f"WITH {OR}, {_table_sql(BINS)} SELECT bin, \"offset\", n FROM ft")
def kfile_offset_table(spark, sf_dir):
    return index.offset_table(spark, index.live_keys(logs.order_log(spark, sf_dir)), BINS)


@query(f"WITH {OR}, {_table_sql(SMALL)} SELECT printf('%08x', 16) || printf('%08x', {8 * SMALL + 16}) || string_agg(printf('%016x', \"offset\"), '' ORDER BY bin) || printf('%016x', CAST({8 * SMALL + 16} + 48 * sum(n) AS BIGINT)) AS header_hex, 16 AS bins, {8 * SMALL + 16} AS header_size, CAST({8 * SMALL + 16} + 48 * sum(n) AS BIGINT) AS end_of_list FROM ft")
def kfile_header_codec(spark, sf_dir):
    table = index.offset_table(spark, index.live_keys(logs.order_log(spark, sf_dir)), SMALL)
    head = index.bin_header(table, SMALL)
    return head.withColumn("__h", K.decode_bin_header(F.col("header_hex"))).select("header_hex", "__h.bins", "__h.header_size", F.col("__h.end").alias("end_of_list"))


@query(f"WITH {OR} SELECT DISTINCT CAST({BIN.format(1024)} AS INTEGER) AS bin, key FROM ol WHERE key <> repeat('0', 64)")
def key_list(spark, sf_dir):
    return index.key_list(logs.order_log(spark, sf_dir), BINS)


GENS = f"fk AS (SELECT key, min(seq) AS seq FROM ol GROUP BY key), gn AS (SELECT key, seq, {SHARD} % 4 AS file, CAST((row_number() OVER (PARTITION BY {SHARD} % 4 ORDER BY seq) - 1) // {LIMIT + 1} AS BIGINT) AS generation FROM fk)"


def _order_generations(spark, sf_dir):
    firsts = index.write_once(logs.order_log(spark, sf_dir)).withColumn("file", K.shard_of(F.col("key")) % 4)
    return index.generations(firsts, ["file"], LIMIT)


@query(f"WITH {OR}, {GENS} SELECT file, generation, count(*) AS key_count FROM gn GROUP BY 1, 2")
def history_generations(spark, sf_dir):
    return _order_generations(spark, sf_dir).groupBy("file", "generation").agg(F.count("*").alias("key_count"))


@query(f"WITH {OR}, {GENS}, fu AS (SELECT file, generation FROM gn GROUP BY 1, 2 HAVING count(*) = {LIMIT + 1}), b AS (SELECT {BIN.format(SMALL)} AS bin FROM gn JOIN fu USING (file, generation)), c AS (SELECT r.range AS bin, count(b.bin) AS entries FROM range({SMALL}) r LEFT JOIN b ON b.bin = r.range GROUP BY 1), e AS (SELECT bin, entries, CAST({4 + 16 * SMALL} + 48 * sum(entries) OVER (ORDER BY bin) AS BIGINT) AS fin FROM c) SELECT bin, entries, entries * 48 AS size_bytes, printf('%016x', fin - 48 * entries) || printf('%016x', fin) AS span_hex FROM e")
def history_keysets(spark, sf_dir):
    rows = index.pushed(_order_generations(spark, sf_dir), ["file"], LIMIT)
    return index.history_segments(spark, rows, SMALL)


@query(f"WITH {EV} SELECT key, arg_min(value, seq) AS value FROM ev GROUP BY key")
def history_get(spark, sf_dir):
    rows = logs.event_log(spark, sf_dir).withColumn("generation", F.floor(F.col("seq") / F.lit(LIMIT + 1)))
    return index.history_get(rows)


@query(f"WITH {EV}, g AS (SELECT *, {SHARD} % 4 AS file, (row_number() OVER (PARTITION BY {SHARD} % 4 ORDER BY seq) - 1) // {LIMIT + 1} AS gen FROM ev), l AS (SELECT file, count(*) // {LIMIT + 1} AS live FROM g GROUP BY 1) SELECT key, arg_max(value, seq) AS value FROM g JOIN l USING (file) WHERE gen = live GROUP BY key")
def dyna_generation_visible(spark, sf_dir):
    rows = logs.event_log(spark, sf_dir).withColumn("file", K.shard_of(F.col("key")) % 4)
    return index.visible_generation(rows, ["file"], LIMIT)


@query(f"WITH {EV}, {VIEWS}, {SNAP} SELECT view_id, key, value FROM sn")
def view_snapshot(spark, sf_dir):
    rows = logs.event_log(spark, sf_dir)
    return views.snapshots(rows, views.quarter_views(rows))


@query(f"WITH {EV}, {VIEWS}, {SNAP} SELECT view_id, sn.key, sn.value <> c.value AS changed FROM sn JOIN {LATEST.format('ev')} c ON sn.key = c.key")
def view_vs_current(spark, sf_dir):
    rows = logs.event_log(spark, sf_dir)
    return views.against_current(views.snapshots(rows, views.quarter_views(rows)), store.latest(rows))


@query(f"WITH {EV}, {VIEWS} SELECT CAST((SELECT count(*) FROM vw WHERE created < seq) AS INTEGER) AS view_id, count(*) AS writes FROM ev GROUP BY 1")
def view_write_attribution(spark, sf_dir):
    rows = logs.event_log(spark, sf_dir)
    return views.write_attribution(rows, views.quarter_views(rows))


@query("WITH a AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 86400000000 THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT user_id, ts, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM a) SELECT user_id, session, min(ts) AS start, max(ts) AS \"end\", count(*) AS accesses FROM s GROUP BY 1, 2")
def view_expiry(spark, sf_dir):
    rows = logs.table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("seq"))
    return views.expiry(rows, "user_id", "ts", 86400)


LIVES = (
    "a AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 86400000000 THEN 1 ELSE 0 END AS n FROM events), "
    "s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM a)"
)


@query(f"WITH {LIVES} SELECT user_id, event_id, session = 0 AS valid, max(CASE WHEN session = 0 THEN ts END) OVER (PARTITION BY user_id) + INTERVAL 1 DAY AS expires FROM s")
def view_valid(spark, sf_dir):
    """Users as view handles, their events as accesses: valid until the first day without one."""
    rows = logs.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return views.validity(rows, "user_id", "ts", 86400).select("user_id", "event_id", "valid", "expires")


def _bloom_sql(source: str, name: str) -> str:
    v = "CAST(CAST('0x' || substr(key, 1 + 16 * h, 16) AS UBIGINT) % (1048576 * 256) AS BIGINT)"
    return f"{name} AS (SELECT DISTINCT key, {v} // 256 AS byte_index, CAST({v} % 8 AS INTEGER) AS bit FROM {source}, (VALUES (0), (1), (2)) t(h))"


@query(f"WITH {EV}, {_bloom_sql('ev', 'ps')} SELECT DISTINCT byte_index, bit FROM ps")
def bloom_bits(spark, sf_dir):
    return bloom.bits(logs.event_log(spark, sf_dir).select("key"))


@query(f"WITH {EV}, {_bloom_sql('ev', 'ps')}, bs AS (SELECT DISTINCT byte_index, bit FROM ps), ck AS (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS key FROM customer), {_bloom_sql('ck', 'pc')} SELECT key, count(bs.bit) = count(*) AS maybe_present FROM pc LEFT JOIN bs USING (byte_index, bit) GROUP BY key")
def bloom_probe(spark, sf_dir):
    bitmaps = bloom.build(logs.event_log(spark, sf_dir).select("key"))
    keys = logs.table(spark, sf_dir, "customer").select(K.key_of(F.col("c_custkey")).alias("key"))
    return bloom.probe(bitmaps, keys)


HISTORY = (
    f"hk AS (SELECT key FROM gn JOIN (SELECT file, generation FROM gn GROUP BY 1, 2 HAVING count(*) = {LIMIT + 1}) USING (file, generation)), "
    "ck AS (SELECT c_custkey AS probe_id, sha256(CAST(c_custkey AS VARCHAR)) AS key FROM customer)"
)


@query(
    f"WITH {OR}, {GENS}, {HISTORY}, {_bloom_sql('hk', 'ps')}, bs AS (SELECT DISTINCT byte_index, bit FROM ps), {_bloom_sql('ck', 'pc')}, "
    "mp AS (SELECT key, count(bs.bit) = count(*) AS maybe_present FROM pc LEFT JOIN bs USING (byte_index, bit) GROUP BY key), "
    "hv AS (SELECT key, arg_min(value, seq) AS value FROM ol JOIN hk USING (key) GROUP BY key) "
    "SELECT probe_id, ck.key, maybe_present, hv.key IS NOT NULL AS found, hv.value FROM ck JOIN mp USING (key) LEFT JOIN hv ON hv.key = ck.key"
)
def history_bloom_get(spark, sf_dir):
    """Lookups in the history that ask its filter first."""
    rows = index.pushed(_order_generations(spark, sf_dir), ["file"], LIMIT)
    probes = logs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("probe_id"), K.key_of(F.col("c_custkey")).alias("key"))
    return bloom.filtered_get(probes, index.history_get(rows), bloom.build(rows.select("key")))


@query(f"WITH {EV}, k AS (SELECT key, sum(length) AS a, arg_max(length, seq) AS l FROM ev GROUP BY key) SELECT {SHARD} AS shard, CAST(sum(l) AS BIGINT) AS live_bytes, CAST(sum(a) - sum(l) AS BIGINT) AS garbage_bytes FROM k GROUP BY 1")
def compress_reclaimable(spark, sf_dir):
    return compact.reclaimable(logs.event_log(spark, sf_dir))


@query(f"WITH {EV} SELECT {SHARD} AS shard, key, CAST(coalesce(sum(length) OVER (PARTITION BY {SHARD} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset, length FROM {LATEST.format('ev')}")
def compressed_offsets(spark, sf_dir):
    return compact.compressed(logs.event_log(spark, sf_dir))


@query("SELECT sha256(text) AS key, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return compact.content_copies(logs.document_log(spark, sf_dir))


@query(f"WITH {OR} SELECT {SHARD} AS shard, printf('Shard%04d', {SHARD}) AS dir, count(*) AS keys, CAST(sum(length) AS BIGINT) AS bytes FROM {LATEST.format('ol')} GROUP BY 1, 2")
def shard_stats(spark, sf_dir):
    return compact.shard_stats(logs.order_log(spark, sf_dir))


@query("WITH t AS (SELECT o_orderkey, o_totalprice * o_totalprice AS tps, 1e9 / 1.0 * (1.0 / (o_totalprice * o_totalprice)) AS ns FROM orders) SELECT o_orderkey, CASE WHEN ns < 1e3 THEN printf('%.3f ns', ns) WHEN ns < 1e6 THEN printf('%.3f us', ns / 1e3) WHEN ns < 1e9 THEN printf('%.3f ms', ns / 1e6) ELSE printf('%.3f s', ns / 1e9) END AS text FROM t")
def time_per_op(spark, sf_dir):
    rows = logs.table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", K.time_per_op(F.col("o_totalprice") * F.col("o_totalprice")).alias("text"))
