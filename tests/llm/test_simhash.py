import random

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from keyrill.llm import simhash
from keyrill.llm.components import components
from keyrill.llm.queries import QUERIES
from tests.oracle import SF


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {d: plain_fingerprint(t) for d, t in docs.items()}
    rows = QUERIES["op2_simhash"](spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {r.doc_id: r.component_id for r in rows} == groups(fps)


def test_fingerprint_cases():
    for text in ("", " \t\n\x0b\x0c\r", "One", "one TWO", "É é\xa0x", "a b c d " * 40000, "a\x1cb c d"):
        assert simhash.fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)


def test_links_equal_brute_force(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for _ in range(300):
        f = r.choice(sorted(fps))
        for _ in range(r.choice((1, 2, 3))):
            f ^= 1 << r.randrange(64)
        fps.add(f)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for radius in (1, 2):
        stars = {x.node % (1 << 64): x.root for x in components(simhash.ball_links(df, radius)).collect()}
        want = {}
        for f in fps:
            seen, todo = {f}, [f]
            while todo:
                g = todo.pop()
                new = [x for x in fps if x not in seen and (x ^ g).bit_count() <= radius]
                seen.update(new)
                todo += new
            want[f] = frozenset(seen)
        assert set(stars) == {f for f in fps if len(want[f]) > 1}
        for f in stars:
            assert {g for g in stars if stars[g] == stars[f]} == want[f]


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(3, None, 1), (3, None, 1), (None, "", 2), (2, "x y z", 3), (9, "x y z", 4)], "doc_id long, text string, fp long")
    rows = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 3), (2, 2), (3, 3), (3, 3), (9, 2)]
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [2, 3]
    odd = spark.createDataFrame([(None, "p q r"), (None, "p q r"), (None, "s t u"), (4, "s t u"), (5, "v w x"), (5, "entirely different words stand here"), (6, " \t\n"), (7, "")], "doc_id long, text string")
    kept = simhash.one_of_each(odd).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "p q r"), (4, "s t u"), (5, "entirely different words stand here"), (5, "v w x"), (6, " \t\n")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_chain_of_components(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 5000 + i) for i in range(50)]
    found = {r.node: r.root for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[5000 + i] == 1000 for i in range(50))
    assert components(spark.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_groups(texts, similarity=0.8):
    """id -> least id of its group, and the links, by brute force over pairs that share a shingle."""
    sets, holders, parent, links = {d: shingles(t) for d, t in texts.items()}, {}, {d: d for d in texts}, set()
    for d, x in sets.items():
        for s in x or [None]:
            holders.setdefault(s, []).append(d)
    find = lambda x: x if parent[x] == x else find(parent[x])
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                if (max(a, b), min(a, b)) not in links and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                    links.add((max(a, b), min(a, b)))
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}, links


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"n{rng.randrange(99999)}"
    return out


def test_near_copies_of_five_word_shingles_are_one(spark):
    """Pairs at every similarity from 0.7 up: all found links are right, and nearly all links are found."""
    rng, rows = random.Random(11), []
    for g in range(150):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        rows += [(len(rows) + c, " ".join(edited(rng, base, rng.randint(0, len(base) // 30) if c else 0))) for c in range(3)]
    texts = dict(rows)
    _, links = similar_groups(texts)
    df = spark.createDataFrame(rows, "u long, text string")
    got = {(r.u, r.v) for r in simhash.similar_pairs(df).collect()}
    assert got <= links
    close = [x for x in links if len(shingles(texts[x[0]]) & shingles(texts[x[1]])) < 0.9 * len(shingles(texts[x[0]]) | shingles(texts[x[1]]))]
    assert len(close) > 50 and len(got & set(close)) >= 0.78 * len(close)
    # not every link of a group is looked for, but its texts hang together
    stars = {r.node: r.root for r in components(spark.createDataFrame(sorted(got), "u long, v long")).collect()}
    names, _ = similar_groups(texts)
    lost = sum(names[d] != d and stars.get(d, d) == d for d in texts)
    assert lost <= 0.08 * sum(names[d] != d for d in texts)


def test_documents_left_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names, links = similar_groups(texts)
    left = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    want = {d for d in texts if names[d] == d}
    assert want <= left and len(left - want) <= 0.02 * (len(texts) - len(want))


def test_all_pairs_of_near_fingerprints_are_settled(spark):
    """Chains of texts that are alike to their neighbours only, under numbers in no order."""
    rng, rows = random.Random(17), []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(12):
            rows.append(" ".join(words))
            words = edited(rng, words, 2)
    rng.shuffle(rows)
    prints = [simhash.signature(simhash.shingle_hashes(t.encode(), 5)).view("<u4").tolist() for t in rows]
    _, links = similar_groups(dict(enumerate(rows)))
    apart = {(u, v): [(a ^ b).bit_count() for a, b in zip(prints[u], prints[v], strict=True)] for u, v in links}
    want = {x for x, d in apart.items() if min(d) <= 2 and sum(d) <= simhash.PLAUSIBLE}
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {(r.u, r.v) for r in simhash.similar_pairs(df.withColumnRenamed("doc_id", "u")).collect()} == want
    parent = dict.fromkeys(range(len(rows)))
    find = lambda x: x if parent[x] is None else find(parent[x])
    for u, v in want:
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == {d for d in parent if parent[d] is None}


def test_near_fingerprints_equal_brute_force_at_any_cut(spark, monkeypatch):
    """Sites that go on over many batches, and fingerprints that differ in first bits, others or both; variants are no rows."""
    rng, fps = random.Random(23), set()
    for table in (0, 3):
        for _ in range(25):
            base = rng.getrandbits(32)
            for _ in range(20):
                x = base
                for _ in range(rng.randrange(5)):
                    x ^= 1 << rng.randrange(32)
                fps.add(table << 32 | x)
    want = {(a, b) for a in fps for b in fps if a > b and a >> 32 == b >> 32 and (a ^ b).bit_count() <= 2}
    rows = sorted((f >> 24 ^ flip, f) for f in fps for flip in (0, *(1 << i for i in range(8))))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 97], strict=True)], ["site", "fp"]) for i in range(0, len(rows), 97)]
    for together in (1, 500, simhash.TOGETHER):
        monkeypatch.setattr(simhash, "TOGETHER", together)
        assert {p for b in simhash._met(batches) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)} == want
    assert list(simhash._met([])) == []
    low = [f for f in fps if f >> 32 == 0]
    _, near = simhash.print_groups(spark.createDataFrame([(i, [f]) for i, f in enumerate(low)], "u long, prints array<long>"))
    assert sorted((r.fp, r.other) for r in near.collect()) == sorted(p for p in want if p[0] >> 32 == 0)
