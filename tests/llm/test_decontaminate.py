import random

import numpy as np

from keyrill.llm import decontaminate as dc
from keyrill.llm.queries import QUERIES
from tests.oracle import SF


def brute_force(item, words):
    """Least edits between the item and any stretch of the words."""
    row = [0] * (len(words) + 1)
    for w in item:
        new = [row[0] + 1]
        for j, v in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: dc.normal_words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: dc.normal_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rows = QUERIES["op6_decontamination"](spark, SF).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        found = docs[r.doc_id][r.start_word : r.end_word]
        assert brute_force(items[r.item_id], found) == r.edits <= 0.2 * len(items[r.item_id])
    # brute force over each pair that shares a run of words that any match must hold
    runs = {}
    for i, w in items.items():
        for j in range(len(w) - 3):
            runs.setdefault(tuple(w[j : j + 4]), set()).add(i)
    want = set()
    for d, w in docs.items():
        near = {i for j in range(len(w) - 3) for i in runs.get(tuple(w[j : j + 4]), ())}
        want |= {(d, i) for i in near if brute_force(items[i], w) <= dc.edits_allowed(len(items[i]), 0.2)}
    assert want <= got


def test_recall_on_edited_passages():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, [rng.choice(words) for _ in range(rng.randint(8, 60))]) for i in range(60)]
    bench = dc.Benchmark(items, 0.2)
    texts, want = [], []
    for n in range(300):
        i, item = items[n % 60]
        v = list(item)
        for _ in range(rng.randint(0, dc.edits_allowed(len(item), 0.2))):
            at = rng.randrange(len(v))
            v[at : at + rng.choice((0, 1, 1))] = rng.choice(([], ["new"], [rng.choice(words)]))
        texts.append(" ".join([*rng.choices(words, k=rng.randint(0, 60)), *v, *rng.choices(words, k=rng.randint(0, 60))]))
        want.append(n % 60)
    found = [any(bench.ids[m.item] == i for m in ms) for ms, i in zip(bench.search(texts), want, strict=True)]
    assert np.mean(found) >= 0.97


def test_clean_text_of_common_words_is_left_alone(spark):
    items = [(1, "the cat sat on the mat and the dog sat on the rug by the door"), (2, "too short"), (3, None), (4, "")]
    docs = [(1, "the cat and the dog " * 500), (2, None), (3, ""), (4, "It is TOO short!"), (5, "x The cat sat on the mat, and the dog slept on the rug by the door. y"), (None, "too short")]
    item_df = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS item_id", "'c' AS words")
    rows = dc.find_leaks(df, item_df).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.start_word, r.end_word, r.edits) for r in rows) == [(0, 2, 0, 2, 0), (4, 2, 2, 4, 0), (5, 1, 1, 17, 1)]
    kept = dc.drop_leaks(df, item_df)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and kept.columns == df.columns
    assert dc.find_leaks(df.limit(0), item_df).count() == 0 and dc.find_leaks(df, item_df.limit(0)).count() == 0


def test_blocks_of_a_large_benchmark_give_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, dc.find_leaks(docs, items).collect()))
    monkeypatch.setattr(dc, "BLOCK_WORDS", 400)
    assert sorted(map(tuple, dc.find_leaks(docs, items).collect())) == want


def test_best_alignment_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item, region = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        edits, a, b = dc.best_alignment(item, region)
        assert edits == brute_force(item.tolist(), region.tolist())
        assert brute_force(item.tolist(), region[a:b].tolist()) <= edits


def test_recall_at_all_allowed_edits_at_the_end_and_for_long_items():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    for low, high in ((8, 14), (45, 60), (100, 120), (200, 400)):
        items = [(i, [rng.choice(words) for _ in range(rng.randint(low, high))]) for i in range(30)]
        bench = dc.Benchmark(items, 0.2)
        for tail in (0, 60):
            texts = []
            for _, item in items:
                v = list(item)
                for _ in range(dc.edits_allowed(len(item), 0.2)):
                    at, kind = rng.randrange(len(v)), rng.randrange(3)
                    v[at : at + (kind < 2)] = [rng.choice(words)] if kind else []
                texts.append(" ".join([*rng.choices(words, k=60), *v, *rng.choices(words, k=tail)]))
            found = [any(bench.ids[m.item] == i for m in ms) for i, ms in enumerate(bench.search(texts))]
            assert np.mean(found) >= 0.97, (low, high, tail)


def test_some_part_is_within_its_edits():
    for n in range(dc.SHORT, 500):
        parts = dc.parts_of(n)
        assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])] and parts[-1][1] == n
        assert len(parts) == 1 or min(b - a for a, b in parts) >= dc.PART
        assert sum(dc.edits_allowed(b - a, 0.2) + 1 for a, b in parts) > dc.edits_allowed(n, 0.2)


def test_short_items_within_their_edits():
    """All of the brute force's matches, for every length below SHORT and several shares."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    for share in (0.0, 0.2, 0.45):
        items = [(i, rng.choices(words, k=1 + i % 7)) for i in range(40)]
        bench = dc.Benchmark(items, share)
        texts = [rng.choices(words, k=rng.randint(0, 30)) for _ in range(60)]
        for text, found in zip(texts, bench.search([" ".join(t) for t in texts]), strict=True):
            got = {m.item for m in found}
            assert got == {n for n, (_, item) in enumerate(items) if brute_force(item, text) <= int(len(item) * share + 1e-9)}
            for m in found:
                assert brute_force(items[m.item][1], text[m.start : m.end]) <= m.edits


def test_recall_is_a_parameter():
    rng = random.Random(4)
    items = [(i, [f"w{rng.randrange(3000)}" for _ in range(30)]) for i in range(40)]
    few, many = (dc.Benchmark(items, 0.2, recall=r) for r in (0.5, 0.995))
    walks = lambda b: [c[5].walks for c in b.classes]
    assert max(walks(few)) < max(walks(many))
    size, stride, *_ = many.classes[0]
    trial = many.classes[0][5].recall(size, stride, [30], 0.2, np.random.default_rng(1))
    assert trial >= 0.97


def test_size_does_not_grow_with_the_words():
    import pickle

    items = [(i, [f"w{i * 500 + j}" for j in range(500)]) for i in range(40)]
    assert len(pickle.dumps(dc.Benchmark(items, 0.2).classes)) < 3_000_000
