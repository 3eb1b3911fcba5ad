import math
import zlib
from collections import Counter

import numpy as np

from keyrill.llm import language_model as lm
from keyrill.llm.queries import QUERIES
from tests.oracle import SF


def check(spark_rows, docs):
    c = Counter()
    for d, t in docs:
        if d is not None and zlib.crc32(str(d).encode()) % 5 != 1:
            c.update((t or "").encode().lower().split())
            c[b""] += 1
    total, distinct = sum(c.values()), len(c)
    rows = {r.doc_id: r for r in spark_rows}
    for d, t in docs:
        toks, r = [*(t or "").encode().lower().split(), b""], rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(toks), sum(c[w] > 0 for w in toks), total)
        assert r.held_out == (d is None or zlib.crc32(str(d).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in toks), rel_tol=1e-9, abs_tol=1e-9)


def test_query_counts_and_beats_unigrams_on_held_out(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op5_language_model"](spark, SF).collect()
    check(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)


def test_rare_words_are_joined_with_the_same_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    wide = {r.doc_id: r for r in lm.score_documents(docs, rounds=0).collect()}
    rows = lm.score_documents(docs, head=4000, rounds=0).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert all(math.isclose(r.base_score, wide[r.doc_id].base_score, rel_tol=1e-9) and math.isclose(r.score, wide[r.doc_id].score, rel_tol=1e-6) for r in rows)


def test_cases(spark):
    docs = [(2, None), (3, ""), (4, "A b É\x0bC " * 3000), (None, "b"), (9, "1 2 3! a.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS word", "1 AS n")
    check(lm.score_documents(df).collect(), docs)
    assert lm.score_documents(df.limit(0)).count() == 0
    only = lm.score_documents(df.where("doc_id IS NULL")).collect()
    assert [(r.n_known, r.train_tokens) for r in only] == [(0, 0)]


def test_probabilities_sum_to_one():
    net = lm.Network(np.arange(100)[::-1])
    h = np.random.default_rng(1).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    total = sum(float(np.exp(net.log_probability(h, np.array([s])))[0]) for s in range(100))
    assert abs(total - 1) < 1e-4


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    net = lm.Network(rng.integers(1, 50, 70))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for live in (None, rng.random((5, 3)) < 0.8):
        x, y, fresh = rng.integers(0, 70, (5, 3)), rng.integers(0, 70, (5, 3)), rng.random((5, 3)) < 0.2
        h, n = rng.standard_normal((lm.HIDDEN, 3)), 15 if live is None else live.sum()
        _, grad, _ = net.gradients(x, y, fresh, live, h)
        for k, g in grad.items():
            flat, i = net.p[k].reshape(-1), int(np.abs(g).argmax())
            keep, step = flat[i], 1e-5
            losses = []
            for d in (step, -step):
                flat[i] = keep + d
                losses.append(net.gradients(x, y, fresh, live, h)[0])
            flat[i] = keep
            assert abs((losses[0] - losses[1]) / (2 * step * n) - g.reshape(-1)[i]) < 1e-4


def plain_score(net, text, start):
    h, last, total = np.zeros((lm.HIDDEN, 1), np.float32), start, 0.0
    for x in text:
        h = net.step(np.array([last]), h)
        total += float(net.log_probability(h.T, np.array([x]))[0])
        last = x
    return total / math.log(10), h


def test_state_runs_through_whole_texts():
    net = lm.Network(np.arange(60)[::-1])
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 60, n) for n in (1, 100, 33, 64)]
    for t, s in zip(texts, lm.score_symbols(net, texts, 0), strict=True):
        assert math.isclose(s, plain_score(net, t, 0)[0], rel_tol=1e-4)


def test_training_carries_the_state_through_documents(monkeypatch):
    monkeypatch.setattr(lm, "RATE", 0.0)
    monkeypatch.setattr(lm, "STREAMS", 2)
    rng = np.random.default_rng(8)
    net = lm.Network(np.arange(60)[::-1])
    trainer = lm.Trainer(net, 0)
    losses, plain = [], net.gradients
    monkeypatch.setattr(net, "gradients", lambda *a: (losses.append(r := plain(*a)), r)[1])
    texts = [rng.integers(0, 60, n) for n in (900, 5, 300, 1, 0, 77, 640)]
    for t in texts:
        trainer.add(t)
    trainer.finish()
    assert trainer.tokens == sum(map(len, texts)) and trainer.queued == 0
    want = sum(plain_score(net, t, 0)[0] for t in texts)
    assert math.isclose(-sum(r[0] for r in losses) / math.log(10), want, rel_tol=1e-3)


def test_every_token_of_every_training_document_trains(spark):
    texts = [f"{w} b c" for w in "adefghij"] + ["x y " * 150]
    docs = spark.createDataFrame([(t, False) for t in texts], "text string, held_out boolean")
    vocab = lm.vocabulary(lm.count_words(docs).persist())
    words, start = spark.sparkContext.broadcast(vocab), lm.Network(vocab.order).flat()
    for t in texts[:-1]:
        assert (lm.train(docs.where(docs.text == t), words, rounds=1).flat() != start).any()
    # a word at any place of a long text changes what is learned
    whole, long = lm.train(docs.where(docs.text == texts[-1]), words, rounds=1).flat(), texts[-1].split()
    for at in range(32, len(long), 64):
        other = spark.createDataFrame([(" ".join([*long[:at], "a", *long[at + 1 :]]), False)], docs.schema)
        assert (lm.train(other, words, rounds=1).flat() != whole).any()


def test_beats_bigrams_of_its_own_symbols(spark):
    """On held-out documents of sf0.01, with the symbols the network tells apart, against bigrams interpolated with unigrams."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') AS text", "crc32(cast(doc_id AS string)) % 5 = 1 AS held_out").persist()
    vocab = lm.vocabulary(lm.count_words(docs))
    net = lm.train(docs, spark.sparkContext.broadcast(vocab), rounds=6)
    look, one, two = vocab.lookup, Counter(), Counter()
    texts = {h: [np.append(look(lm.tokens(r.text.encode()))[0], 0) for r in docs.where(docs.held_out == h).collect()] for h in (True, False)}
    for t in texts[False]:
        one.update(t.tolist())
        two.update(zip([0, *t.tolist()], t.tolist()))  # noqa: B905
    before, n, v = Counter(), sum(one.values()), len(vocab.order)
    for (a, _), k in two.items():
        before[a] += k
    unigram = lambda w: (one[w] + 0.5) / (n + 0.5 * v)
    bigram = sum(math.log10((two[a, w] + 50 * unigram(w)) / (before[a] + 50)) for t in texts[True] for a, w in zip([0, *t.tolist()], t.tolist()))  # noqa: B905
    assert lm.score_symbols(net, texts[True], 0).sum() > bigram


def test_scores_do_not_hang_on_the_rows_whose_logits_are_held_at_once(monkeypatch):
    rng = np.random.default_rng(7)
    net = lm.Network(rng.integers(1, 999, 90))
    texts = [rng.integers(0, 90, n).astype(np.int32) for n in (1, 70, 33, 5, 400)]
    whole, held, real = lm.score_symbols(net, texts, 0), [], net.log_probability
    monkeypatch.setattr(lm, "ROWS", 7)
    monkeypatch.setattr(net, "log_probability", lambda h, t: held.append(len(t)) or real(h, t))
    assert np.allclose(lm.score_symbols(net, texts, 0), whole, rtol=1e-5)
    assert max(held) == 7 and sum(held) == sum(map(len, texts))
