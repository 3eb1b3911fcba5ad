import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from keyrill.llm import pieces
from keyrill.llm.queries import QUERIES, digests
from tests.oracle import SF

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = pieces.codec(open(PATH, "rb").read())


def want(text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_query_equals_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_sentencepiece"](spark, SF).collect()}
    assert rows == {d.doc_id: want(d.text) for d in docs}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\t\x00aeothn.é　\xa0<s>/🙂"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_as_the_library(text):
    assert CODEC.by_chunk
    ids = CODEC.encode(text)
    assert ids.tolist() == LIBRARY.encode(text, add_eos=True)
    assert CODEC.decode(ids) == LIBRARY.decode(ids.tolist())


def test_each_distinct_chunk_is_segmented_once(spark, monkeypatch):
    texts = ["one two three", "two three four", None, "", "three  three\none", "one " * 500] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model = open(PATH, "rb").read()
    rows = spark.read.parquet(pieces.chunk_table(df, model, spark.sparkContext.broadcast({" one": b""}))).collect()
    want = {c for t in texts for c in pieces.chunks_of(t or "")} - {" one"}
    assert {r.chunk for r in rows} == want
    assert len({(r.task, r.chunk) for r in rows}) == len(rows) <= 4 * len(want)
    assert all(np.frombuffer(r.ids, np.int32).tolist() == CODEC.single.encode(r.chunk) for r in rows)
    # one run of equal chunks is segmented once
    seen = []
    monkeypatch.setattr(CODEC, "segment", lambda c: (seen.append(c), b"\0\0\0\0")[1])
    batch = pa.RecordBatch.from_pydict({"task": [1, 2, 3], "chunk": [" a", " a", " b"]})
    list(pieces._segmented(model, "task")([batch, batch.slice(2, 1)]))
    assert seen == [" a", " b"]


def test_lists_are_passed_on_when_full(spark, monkeypatch):
    monkeypatch.setattr(pieces, "LISTED", 3)
    monkeypatch.setattr(pieces.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 7})())
    batch = pa.RecordBatch.from_pydict({"text": ["one two three four five", "one two", None, "six"]})
    out = list(pieces._listed(spark.sparkContext.broadcast({" six": b""}))([batch]))
    assert len(out) == 2 and {c for b in out for c in b.column("chunk").to_pylist()} == {f" {w}" for w in "one two three four five".split()}


def test_frequent_chunks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(pieces, "HEAD_SHARE", 1)
    df = spark.createDataFrame([(f"a a a a b b b c c d {i} " + "x" * 99,) for i in range(30)], "text string")
    for head, want in ((0, set()), (1, {" a"}), (3, {" a", " b", " c"}), (1000, {" a", " b", " c", " d"})):
        got = pieces.frequent_chunks(df, open(PATH, "rb").read(), head)
        assert set(got) == want and all(np.frombuffer(v, np.int32).tolist() == CODEC.single.encode(k) for k, v in got.items())


def test_missing_chunks_are_segmented_where_they_are_met():
    table = {" one": CODEC.segment(" one")}
    assert CODEC.encode("one two one", table).tolist() == LIBRARY.encode("one two one", add_eos=True)
    assert set(table) == {" one", " two"}


def test_nulls_long_and_empty(spark):
    texts = [None, "", " ", "word " * 50_000, "é" * 70_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(pieces.encode_decode(df, PATH)).collect()}
    assert rows == {i: want(t) for i, t in enumerate(texts)}
    assert pieces.encode_decode(df.limit(0), PATH).count() == 0
