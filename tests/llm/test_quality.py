import math
from collections import Counter
from itertools import pairwise

import numpy as np

from keyrill.llm import quality as q
from keyrill.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_against_labels(spark):
    """No label is used in training; all of them are held out."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op8_quality"](spark, SF).collect()}
    good = [rows[d].accepted for d, x in labels.items() if x == 1]
    bad = [not rows[d].accepted for d, x in labels.items() if x == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) >= 0.95 * len(bad)


def planted(n, caught, alarms, shares, seed):
    """Vote patterns of documents whose kinds are known."""
    rng, kinds = np.random.default_rng(seed), None
    kinds = rng.choice(len(shares), n, p=shares)
    rate = np.where(q.FAMILY[None] == kinds[:, None], caught, alarms)
    votes = np.where(rng.random((n, 12)) < rate, q.BAD, q.GOOD)
    votes[rng.random((n, 12)) < 0.1] = q.ABSTAIN
    return kinds, [tuple(v) for v in votes.tolist()]


def test_label_model_finds_planted_rates():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        caught, alarms = rng.uniform(0.6, 0.95, 12), rng.uniform(0.001, 0.08, 12)
        kinds, votes = planted(40_000, caught, alarms, [0.82, 0.06, 0.05, 0.04, 0.03], seed)
        model = q.label_model(Counter(votes))
        assert np.abs(model.caught - caught).max() < 0.08 and np.abs(model.alarms - alarms).max() < 0.01
        assert np.abs(model.shares - [0.82, 0.06, 0.05, 0.04, 0.03]).max() < 0.01
        said = np.array([model.good[v] > 0.5 for v in votes])
        # as good as one can do who knows the planted rates
        bad, cast = np.array(votes) == q.BAD, np.array(votes) != q.ABSTAIN
        rate = np.where(q.FAMILY[None] == np.arange(5)[:, None], caught, alarms)
        best = np.log([0.82, 0.06, 0.05, 0.04, 0.03]) + bad @ np.log(rate).T + (cast & ~bad) @ np.log(1 - rate).T
        assert (said == (kinds == 0)).mean() > ((best.argmax(1) == 0) == (kinds == 0)).mean() - 0.01


def test_a_labeller_that_is_wrong_on_one_in_twenty_is_found_out():
    alarms = np.full(12, 0.001)
    alarms[4] = 0.05
    _, votes = planted(20_000, np.full(12, 0.9), alarms, [0.9, 0.04, 0.03, 0.02, 0.01], 3)
    model = q.label_model(Counter(votes))
    assert abs(model.alarms[4] - 0.05) < 0.01
    alone = tuple(q.BAD if j == 4 else q.GOOD for j in range(12))
    assert model.good[alone] > 0.9
    assert all(p < 0.1 for v, p in model.good.items() if sum(x == q.BAD for x, f in zip(v, q.FAMILY) if f == 2) == 3)  # noqa: B905


def test_label_model_against_brute_force():
    """The likelihood grows with each round; the posterior is that of the model spelled out."""
    for seed in range(3):
        _, votes = planted(20_000, np.full(12, 0.8), np.full(12, 0.05), [0.6, 0.1, 0.1, 0.1, 0.1], seed)
        patterns = Counter(votes)
        model = q.label_model(patterns)
        assert all(b >= a - 1.0 for a, b in pairwise(model.likelihood)) and model.likelihood[-1] > model.likelihood[0]
        total = 0.0
        for v, n in patterns.items():
            by_kind = [s * math.prod(1 if x == q.ABSTAIN else (r if x == q.BAD else 1 - r) for x, r in zip(v, np.where(q.FAMILY == k, model.caught, model.alarms), strict=True)) * (k == 0 or any(x != q.ABSTAIN for x, f in zip(v, q.FAMILY, strict=True) if f == k)) for k, s in enumerate(model.shares)]
            total += n * math.log(sum(by_kind))
            assert abs(model.good[v] - by_kind[0] / sum(by_kind)) < 1e-9
        assert abs(total - model.likelihood[-1]) < 1e-6
    assert q.label_model({}).good == {}


def test_measures_by_hand():
    m, shapes = q.measures(b"ONE!! two | three$ four\nfive | six six six *** Ab")
    words = b"ONE!! two | three$ four five | six six six *** Ab".split()
    assert len(shapes) == len(words) == 12
    assert m[1] == 1 / 12 and m[3] == 4 / 12 and m[5] == 2 / 12 and m[6] == 2 / 12 and m[7] == 3 / 12 and m[8] == 1.0
    text = b"SHOUTED WORDS ARE ALL IN CAPITALS AND ALIKE alike " * 3
    m, _ = q.measures(text)
    assert abs(m[2] - 24 / 27) < 1e-9 and m[10] == 0 and abs(m[11] - (1 - 9 / 27)) < 1e-9


def test_cases(spark):
    junk = "BUY!! NOW!! CHEAP!! " * 40
    docs = [(1, None, 1), (2, "", 2), (3, "A plain sentence about nothing much at all, with a few words.", 3), (4, junk, 4), (5, "word " * 40_000, 5), (None, junk, 6)]
    df = spark.createDataFrame([(d, t, x) for d, t, x in docs] + [(10 + i, f"Some ordinary text number {i} that reads like a sentence and goes on for a while, as such texts do.", 7) for i in range(60)], "doc_id long, text string, quality int")
    out = q.classify(df)
    rows = {r.doc_id: r.accepted for r in out.collect()}
    assert not rows[4] and not rows[None] and rows[3] and rows[1] == rows[2] and all(rows[10 + i] for i in range(60)) and not rows[5]
    assert set(out.columns) == {"doc_id", "text", "quality", "accepted"}
    assert q.classify(df.limit(0)).count() == 0
