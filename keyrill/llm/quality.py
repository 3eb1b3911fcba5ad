"""Quality classifier: weak labellers weighed by EM train a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField

from keyrill.llm.shared import map_rows, quoted

#: Votes of a labeller.
ABSTAIN, GOOD, BAD = 0, 1, 2
#: Labellers by the kind of junk that they know; three know each kind, in ways of their own.
KINDS = {
    "shouting": ("capitals", "shouts", "capital words"),
    "symbols": ("symbols", "marks", "marked words"),
    "tables": ("pipes", "bare words", "piped lines"),
    "repetition": ("triples", "stutter", "few words"),
}
LABELLERS = tuple(name for names in KINDS.values() for name in names)
#: The kind of each labeller, from 1; 0 is a good document.
FAMILY = np.repeat(np.arange(1, len(KINDS) + 1), 3)
#: Good below the first figure, bad above the second.
LIMITS = ((0.3, 0.5), (0.02, 0.2), (0.1, 0.3), (0.1, 0.4), (0.12, 0.3), (0.1, 0.3), (0.05, 0.2), (0.05, 0.15), (0.2, 0.5), (0.2, 0.4), (0.05, 0.2), (0.35, 0.55))
WIDTH = 1 << 14
#: Words of a stretch in which different ones are counted.
STRETCH = 50
#: Documents, about, that the scorer learns from; their choice is by a hash of the text.
SAMPLE = 6000

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
SYMBOLS = b"*#%&$@^~<>{}=_+\\"
HIGH = bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
#: Bytes by kind: letters A and a, digits 0, other bytes as they are, line ends as spaces.
SHAPE = bytes(65 if b in UPPER else 97 if b in LOWER or b > 127 else 48 if 48 <= b < 58 else 32 if b < 32 else b for b in range(256))
#: Shapes of words that are nothing but marks, and of words in capitals.
BARE = re.compile(rb"(?<![^ ])[^A0a ]+(?![^ ])")
CAPITAL_WORD = re.compile(rb"(?<![^ ])[^A0a ]*AA+[^a ]*(?![^ ])")
MARKED = re.compile(rb"[" + re.escape(SYMBOLS) + rb"](?![^ ])")


def measures(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The figures that labellers judge, -1 where a text is too short for one, and the shapes of the words."""
    words, shape = text.split(), text.translate(SHAPE)
    n = max(1, len(words))
    upper, lower = len(text) - len(text.translate(None, UPPER)), len(text) - len(text.translate(None, LOWER))
    other = len(text.translate(None, UPPER + LOWER + HIGH + DIGITS + b" \t\n\r\x0b\x0c"))
    solid = sum(map(len, words))
    lines = text.split(b"\n")
    few = solid < 40
    triples_again = stutter = same = -1.0
    runs = len(words) - 2
    if runs >= 20:
        triples = Counter(zip(words, words[1:], words[2:]))  # noqa: B905  the shortest ends them
        often = sum(n > 1 for n in triples.values())
        # many triples must come again: one phrase that does is no mark of junk
        triples_again = min(1 - len(triples) / runs, 4 * often / len(triples))
        stutter = sum(map(eq, words, words[1:])) / (n - 1)
        same = 1 - sum(len(set(words[i : i + STRETCH])) for i in range(0, n, STRETCH)) / n
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    found = (
        -1.0 if few else upper / max(1, upper + lower), text.count(b"!!") / n, -1.0 if few else len(CAPITAL_WORD.findall(shape)) / n,
        symbols / n, -1.0 if few else other / solid, len(MARKED.findall(shape)) / n,
        text.count(b"|") / n, len(BARE.findall(shape)) / n, sum(b" | " in x for x in lines) / len(lines),
        triples_again, stutter, same,
    )
    return np.array(found), shape.split()


def votes(m: np.ndarray) -> tuple[int, ...]:
    """One vote per labeller."""
    return tuple(ABSTAIN if x < 0 else GOOD if x < low else BAD if x > high else ABSTAIN for x, (low, high) in zip(m.tolist(), LIMITS, strict=True))


def features(text: bytes) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """Votes, hashed feature numbers and their weights.

    Features are the shapes of words by their share, and the figures in steps.
    """
    m, words = measures(text)
    shapes = Counter(w[:12] for w in words)
    n = max(1, len(words))
    names = [*shapes, *[b"\x00%d:%d" % (i, int(max(-1.0, min(x, 4.0)) * 20)) for i, x in enumerate(m)]]
    weights = [4.0 * c / n for c in shapes.values()] + [1.0] * len(m)
    return votes(m), np.array([zlib.crc32(x) % WIDTH for x in names]), np.array(weights)


@dataclass
class LabelModel:
    """What the votes say: shares of the kinds (0 good), and each labeller's rates of bad votes on its kind and elsewhere.

    good: the posterior of a good document for each vote pattern; likelihood:
    the log likelihood after each round.
    """

    shares: np.ndarray
    caught: np.ndarray
    alarms: np.ndarray
    good: dict[tuple[int, ...], float]
    likelihood: list[float]


def label_model(patterns: dict[tuple[int, ...], int], family: np.ndarray = FAMILY, rounds: int = 80) -> LabelModel:
    """Estimates, by expectation-maximisation, how far each labeller can be trusted.

    patterns: vote tuple -> documents. A document is good or junk of one kind.
    Given that, labellers vote independently: a labeller gives bad votes at its
    rate `caught` on the kind it knows and at its rate `alarms` on all others,
    good ones or junk. An abstention says nothing, and where all labellers of a
    kind abstain the document can't be of that kind. Several labellers know each
    kind, so one that is often alone with a bad vote is found to be wrong and
    one that is silent where the others agree is found to miss. It starts from
    belief where two labellers of a kind agree; small prior counts alone keep
    the rates from 0 and 1.
    """
    kinds = int(family.max())
    keys = sorted(patterns)
    if not keys:
        return LabelModel(np.append(1.0, np.zeros(kinds)), np.full(len(family), 0.5), np.full(len(family), 0.5), {}, [])
    v, n = np.array(keys), np.array([patterns[k] for k in keys], float)
    bad, cast = (v == BAD).astype(float), (v != ABSTAIN).astype(float)
    own = family[None] == np.arange(kinds + 1)[:, None]  # kind, labeller
    told = np.where(np.concatenate([np.ones((len(v), 1)), cast @ own[1:].T], axis=1) > 0, 0.0, -np.inf)
    agree = np.stack([(bad * own[k]).sum(1) for k in range(1, kinds + 1)], axis=1)
    belief = np.concatenate([np.ones((len(v), 1)), np.array([0.01, 0.4, 20.0, 100.0])[np.minimum(agree, 3).astype(int)]], axis=1)
    belief *= told == 0
    belief /= belief.sum(1, keepdims=True)
    likelihood: list[float] = []
    for _ in range(rounds):
        weight = n[:, None] * belief
        shares = (weight.sum(0) + 0.1) / (n.sum() + 0.1 * (kinds + 1))
        bad_by, cast_by = weight.T @ bad, weight.T @ cast  # kind, labeller
        caught = ((bad_by * own).sum(0) + 1) / ((cast_by * own).sum(0) + 1.5)
        alarms = ((bad_by * ~own).sum(0) + 0.5) / ((cast_by * ~own).sum(0) + 100)
        rate = np.where(own, caught, alarms)
        logs = np.log(shares) + bad @ np.log(rate).T + (cast - bad) @ np.log(1 - rate).T + told
        top = logs.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        belief = np.exp(logs - total[:, None])
        likelihood.append(float(n @ total))
    return LabelModel(shares, caught, alarms, dict(zip(keys, belief[:, 0].tolist(), strict=True)), likelihood)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 30, rate: float = 0.5, seed: int = 5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer, by AdaGrad on posterior labels."""
    w, g = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            idx = np.concatenate([np.append(rows[i][0], WIDTH) for i in batch])
            val = np.concatenate([np.append(rows[i][1], 1.0) for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[i][0]) + 1 for i in batch])
            p = 1 / (1 + np.exp(-np.bincount(of, val * w[idx], minlength=len(batch))))
            grad = np.bincount(idx, val * (p - target[batch])[of], minlength=WIDTH + 1) / len(batch) + 1e-5 * w
            g += grad * grad
            w -= rate * grad / np.sqrt(g)
    return w


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights for these documents.

    Vote patterns (three votes of each labeller, so at most 3^12) are counted
    over all documents. The scorer learns from about `sample` of them: the
    different texts whose hash is below the share that `sample` is of all
    documents. It sees their posterior and no label of a person. Null texts
    count as empty.
    """
    rows = docs.select(F.coalesce(docs[quoted(text)], F.lit("")).alias("text"))

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(votes(measures(t.as_py())[0]) for t in batch.column("text").cast(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([bytes(k) for k in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    counted = rows.mapInArrow(vote, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = {tuple(r["pattern"]): r["n"] for r in counted}
    good = label_model(patterns).good
    share = min(1.0, sample / max(1, sum(patterns.values())))
    chosen = rows.where(F.xxhash64("text", F.lit("sample")) <= int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True))
    # copies of one text count once, so that a large group of them can't fill the sample
    chosen = chosen.distinct()

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([bytes(v) for v, _, _ in found], pa.binary()), pa.array([i.astype(np.int32).tobytes() for _, i, _ in found], pa.binary()), pa.array([x.tobytes() for _, _, x in found], pa.binary())], ["pattern", "at", "weight"])

    got = sorted((bytes(r["pattern"]), bytes(r["at"]), bytes(r["weight"])) for r in chosen.mapInArrow(learn, "pattern binary, at binary, weight binary").collect())
    if not got:
        return np.append(np.zeros(WIDTH), 1.0)
    return train([(np.frombuffer(a, np.int32), np.frombuffer(w)) for _, a, w in got], np.array([good.get(tuple(p), 0.5) for p, _, _ in got]))


def score(text: bytes, w: np.ndarray) -> float:
    _, at, weight = features(text)
    return float(1 / (1 + np.exp(-(w[at] @ weight + w[WIDTH]))))


def classify(docs: DataFrame, text: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents' columns with quality (the scorer's probability) and accepted, which replace columns of these names.

    Null and empty texts get the score of a text without features.
    """
    w = docs.sparkSession.sparkContext.broadcast(fit(docs, text, sample))
    kept = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in ("quality", "accepted")])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [score(t.as_py() or b"", w.value) for t in batch.column(text).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q, pa.float64()), pa.array([x >= threshold for x in q], pa.bool_())], names=[*batch.schema.names, "quality", "accepted"])

    return map_rows(kept, each, [StructField("quality", DoubleType()), StructField("accepted", BooleanType())])
