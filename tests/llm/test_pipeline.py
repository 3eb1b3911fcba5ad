import public_tokenizers
import sentencepiece

from pyspark.sql import functions as F

import corpus_pipeline
from keyrill.llm import decontaminate, lines, quality, simhash
from tests.llm.test_simhash import similar_groups
from tests.oracle import SF


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.classify(docs).where("accepted").collect()}
    texts = {r.doc_id: r.text for r in lines.remove_lines(docs.where(docs.doc_id.isin(list(good)))).collect()}
    names, _ = similar_groups(texts)
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}
    firsts = {d for d in texts if names[d] == d}
    assert firsts <= kept and len(kept - firsts) <= 0.02 * (len(texts) - len(firsts))
    left = {d: t for d, t in texts.items() if d in kept}
    items = [(r.item_id, decontaminate.normal_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = decontaminate.Benchmark(items, 0.2).search(list(left.values()))
    clean = {d: t for (d, t), f in zip(left.items(), found, strict=True) if not f}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {d: sp.encode(t, add_eos=True) for d, t in clean.items()}
    assert all(r.decoded == clean[r.doc_id] for r in rows)
    assert len(clean) > 500 and simhash.masks(1)[0] == 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 100")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


#: Names of our own columns inside the operators.
CLASHES = ["hash", "fp", "ids", "decoded", "component_id", "fingerprint", "row", "own", "md5", "held", "kept", "keeper", "line", "site", "Quality", "accepted", "N_Removed", "root", "node", "u", "v", "seed", "doc", "source_id", "__kept", "__md5", "a.b", "text.z"]


def test_stages_with_nulls_no_rows_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    want = {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        want[name] = stage(spark, docs, SF).count()
        clashing = docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        assert stage(spark, clashing, SF).count() == want[name]
        assert stage(spark, docs.limit(0), SF).count() == 0
        rows = [(None, None, None, None, None)] * 2 + [(1, None, None, None, None)] * 2 + [(2, "", None, "s", 0), (None, "some words", "en", "s", 3), (3, "some words", "en", None, 3), (3, "some words", "en", None, 3), (4, "long " * 100_000, "en", "s", 3)]
        got = stage(spark, spark.createDataFrame(rows, docs.schema), SF).count()
        assert got == (8, 9, 3, 9, 9)[at]


def test_lines_by_join_and_single_copies_keep_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    a, b = lines.remove_lines(docs, min_sites=2), lines.remove_lines(docs, min_sites=2, broadcast_lines=0)
    assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert simhash.one_of_each(docs).columns == docs.columns and simhash.one_of_each(docs).where("fp <> 'x' OR __kept <> 'x'").count() == 0


def test_stages_pass_whole_texts_in_small_batches(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs, before = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 20"), spark.conf.get(size)
    try:
        for own, want in (("10000", "1000"), ("0", "1000"), ("300", "300")):
            for _, stage in corpus_pipeline.STAGES[1:2]:
                spark.conf.set(size, own)
                assert stage(spark, docs, SF).columns == docs.columns
                assert spark.conf.get(size) == want
    finally:
        spark.conf.set(size, before)
