import random

import pytest
from pyspark.sql import functions as F

from keyrill.functions.keys import NIL_KEY
from keyrill.operators import router
from keyrill.operators.router import Layers
from keyrill.plans.store import Database
from keyrill.sources.generate import put_log


def rows(spark, *puts):
    return spark.createDataFrame(list(puts), "seq long, key string, value string")


A, B, C = "a" * 64, "b" * 64, "c" * 64


def test_put_get_views_and_compaction(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    assert db.current().count() == 0 and db.new_view() == -1
    db.put(rows(spark, (1, A, "x"), (2, B, "y")))
    handle = db.new_view()
    db.put(rows(spark, (3, A, "xx"), (4, C, None)))
    again = Database(spark, str(tmp_path / "db"))
    assert again.get(A).first().value == "xx" and again.get("d" * 64).count() == 0
    assert {r.key: r.value for r in again.view(handle).collect()} == {A: "x", B: "y"}
    assert {r.key: r.changed for r in again.changed_since(handle).collect()} == {A: True, B: False}
    probe = spark.createDataFrame([(1, C), (2, "d" * 64)], "probe_id long, key string")
    assert {r.probe_id: (r.found, r.value) for r in again.multi_get(probe).collect()} == {1: (True, None), 2: (False, None)}
    perm, dyna = again.layers()
    assert {r.key: r.value for r in perm.collect()} == {A: "x", B: "y", C: None} and {r.key: r.value for r in dyna.collect()} == {A: "xx"}
    assert again.reclaimable().agg(F.sum("live_bytes"), F.sum("garbage_bytes")).first()[:] == (4, 0)
    small = again.compress(str(tmp_path / "small"))
    assert sorted(map(tuple, small.current().select("key", "value").collect()), key=str) == sorted(map(tuple, again.current().select("key", "value").collect()), key=str)
    assert small.log().count() == 4 and {(r.layer, r.key, r.length) for r in small.layout().collect()} == {("perm", A, 1), ("dyna", A, 2), ("perm", B, 1), ("perm", C, 0)}


def test_explicit_layers(spark, tmp_path):
    """Reads after every mix of operations agree with the two layers step by step."""
    r = random.Random(5)
    db, states = Database(spark, str(tmp_path / "db")), {}
    log = [(i, f"{r.randrange(1, 60):064x}", r.choice(["a", "bb", "", None]), r.choice(["put", "put_dyna", "put_perm"])) for i in range(400)]
    for part in (log[:150], log[150:]):
        db.put(spark.createDataFrame(part, "seq long, key string, value string, op string"))
    wrote = 0
    for _, key, value, op in log:
        if states.setdefault(key, Layers()).apply(op, value) in ("PERM_INSERT", "DYNA_WRITE"):
            wrote += len(value or "")
    live = sum(len(x[0] or "") for s in states.values() for x in (s.perm, s.dyna) if x)
    for now in (db, db.compress(str(tmp_path / "small"))):
        perm, dyna = now.layers()
        assert {x.key: x.value for x in perm.collect()} == {k: s.perm[0] for k, s in states.items() if s.perm}
        assert {x.key: x.value for x in dyna.collect()} == {k: s.dyna[0] for k, s in states.items() if s.dyna}
        assert {x.key: x.value for x in now.current().collect()} == {k: (s.dyna or s.perm)[0] for k, s in states.items()}
        key = log[7][1]
        assert now.get(key).first().value == (states[key].dyna or states[key].perm)[0]
    assert db.reclaimable().agg(F.sum("live_bytes"), F.sum("garbage_bytes")).first()[:] == (live, wrote - live)
    twice = Database(spark, str(tmp_path / "twice"))
    twice.put(spark.createDataFrame([(1, A, "x", "put_perm"), (2, A, "y", "put_perm")], "seq long, key string, value string, op string"))
    assert twice.get(A).first().value == twice.get_perm(A).first().value == "x" and twice.get_dyna(A).count() == 0


def test_seqs_must_rise(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.put(rows(spark, (5, A, "x")))
    for seq in (5, 4, None):
        with pytest.raises(Exception, match="above those stored"):
            db.put(rows(spark, (seq, B, "y")))
    with pytest.raises(Exception, match="nil key"):
        db.put(rows(spark, (9, None, "y")))
    assert db.log().count() == 1


def test_nil_key_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="nil key"):
        Database(spark, str(tmp_path / "db")).put(rows(spark, (1, NIL_KEY, "x")))


def test_lookup_reads_one_bucket(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.put(put_log(spark, 400, 50))
    plan = db.get(A)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(key,aaaa" in plan


def test_generated_logs_repeat(spark):
    df = put_log(spark, 500, 40, seed=7, low=10, high=20, repeat=0.3)
    assert sorted(df.collect()) == sorted(put_log(spark, 500, 40, seed=7, low=10, high=20, repeat=0.3).repartition(3).collect())
    assert all(10 <= r.length < 20 for r in df.collect())
    kinds = {r.action: r["count"] for r in router.route(df).groupBy("action").count().collect()}
    assert kinds["PERM_INSERT"] == 40 and kinds["DYNA_WRITE"] > 300 and kinds.get("NOOP_PERM", 0) + kinds.get("NOOP_DYNA", 0) > 0
