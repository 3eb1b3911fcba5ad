import numpy as np

from keyrill.llm import vectors
from keyrill.llm.queries import QUERIES
from tests.oracle import SF


def brute_force(rows, cosine=0.93):
    """vec_id -> (n_links, component) for distinct non-null ids."""
    out = {i: (0, i) for i, _, _ in rows}
    fit = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i, _, _ in fit}
    for n, (i, v, y) in enumerate(fit):
        for j, w, z in fit[n + 1 :]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= cosine:
                near[i].add(j)
                near[j].add(i)
    for i in sorted(near):
        if out[i] == (0, i):
            seen, todo = {i}, [i]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            for j in seen:
                out[j] = (len(near[j]), min(seen))
    return out


def planted(n=60, d=64, seed=2):
    rng, rows = np.random.default_rng(seed), []
    for g in range(n):
        centre = rng.standard_normal(d)
        for _ in range(1 + g % 5):
            noise = rng.standard_normal(d) * rng.uniform(0.05, 0.45)
            rows.append((len(rows), (centre + noise).astype(np.float32).tolist(), g % 3))
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(30)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * d, 1), (2003, [float("nan")] * d, 1), (2004, [None] * d, 1), (2005, rows[7][1], None), (2006, [float("inf")] * d, 0), (2007, [1.0, 0.5, 0.2], 1), (2008, [2.0, 1.0, 0.4], 1)]
    return rows


def test_planted_groups_reach_recall_and_add_nothing(spark, monkeypatch):
    for block, tile in ((2048, 512), (2048, 16), (8, 512)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "TILE", tile)
        rows = planted()
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS dim")
        got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
        want = brute_force(rows)
        assert len(got) == len(rows)
        links = sum(w[0] for w in want.values())
        assert all(got[i].n_links <= want[i][0] for i in want)
        assert sum(r.n_links for r in got.values()) >= 0.98 * links
        assert all(got[i].component_id >= want[i][1] for i in want)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
        assert got[1000].n_links >= 30 and got[2008].component_id == 2007


def test_query_equals_brute_force_on_fixture(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op4_embedding_near_dedup"](spark, SF).collect()} == brute_force(rows)


def test_null_id_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vectors.near_vectors(df).collect()) == [(0, 0, 0, False), (5, 1, 5, True), (5, 1, 5, True)]
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), 4 * np.linalg.norm(x, axis=1))


def test_ids_with_several_vectors(spark):
    east, north, up = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = [0.99, 0.05, 0.0]
    rows = [(5, east, 1), (5, north, 1), (6, near, 1), (7, [0.98, 0.1, 0.0], 1), (7, east, 2), (8, up, 1), (8, up, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect())
    assert got == [(5, 0, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 0, 7, True), (7, 2, 5, False), (8, 1, 8, True), (8, 1, 8, True)]


def test_recall_of_the_hashing_by_width():
    rng = np.random.default_rng(9)
    for d in (3, 16, 64, 128, 384, 768):
        a = rng.standard_normal((1500, d))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal((1500, d))
        b -= (b * a).sum(1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        ca, cb = (vectors.codes(x, 6, 11) for x in (a, 0.931 * a + np.sqrt(1 - 0.931**2) * b))
        met = (ca[:, :, :1] == cb).any((1, 2)) | (cb[:, :, :1] == ca).any((1, 2))
        assert met.mean() >= 0.95, (d, met.mean())
