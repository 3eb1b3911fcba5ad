"""A gated recurrent language model: trained where the documents are, scored over whole documents."""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyrill.llm.shared import columns, cut

#: The token that ends each document; no word is empty.
END = b""
#: Words that every task knows the counts of, at most; rarer ones are joined.
HEAD = 131_072
#: Words that the network tells apart; others it knows by their group.
KNOWN = 1000
HIDDEN, CLASS = 24, 32
#: Steps of truncated backpropagation, documents trained side by side, and tokens of each that are laid out at once.
WINDOW, STREAMS, REACH = 16, 320, 64
#: Tokens of a document over which training carries the state; a longer one goes on from a new state, elsewhere.
CARRIED = 1024
#: Rounds over all training text, and the step size.
ROUNDS, RATE = 1, 0.02
#: Tokens scored together, and steps whose states are held at once.
TOKENS, STEPS = 3_000_000, 32
#: States whose logits are held at once.
ROWS = 8192
#: Groups of words by their last byte, then by the hash of their last two.
MARKS = b".,!|%#*$&"
ENDINGS = 48
GROUPS = len(MARKS) + 2 + ENDINGS


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def group_of(word: bytes) -> int:
    last = word[-1]
    if (i := MARKS.find(last)) >= 0:
        return i
    if 48 <= last < 58:
        return len(MARKS)
    if last < 128 and not 97 <= last < 123:
        return len(MARKS) + 1
    return len(MARKS) + 2 + zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Vocabulary:
    """Counts of frequent words, the network's symbols, and what the rest amounts to.

    symbols maps a word that the network knows to its number; groups[g] is the
    number of group g. weight[g] is log10 of a group's smoothed total.
    """

    head: dict[bytes, int]
    symbols: dict[bytes, int]
    groups: list[int]
    weight: np.ndarray
    order: np.ndarray
    total: int
    distinct: int

    @cached_property
    def lookup(self) -> Lookup:
        """Made once in each worker that holds the broadcast."""
        return Lookup(self)

    def symbol(self, word: bytes) -> int:
        s = self.symbols.get(word)
        return self.groups[group_of(word)] if s is None else s


class Lookup:
    """Arrays over the frequent words, so that a text costs one dictionary look a word."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.at = vocab, {w: i for i, w in enumerate(vocab.head)}
        # the last entry is for words that are not there
        self.symbol = np.array([vocab.symbol(w) if w else 0 for w in vocab.head] + [0], np.int32)
        self.log = np.log10(np.array([*vocab.head.values(), 0.5]) + 0.5)
        self.share = np.where(self.symbol < len(vocab.symbols), 0.0, self.log - vocab.weight[np.maximum(self.symbol - len(vocab.symbols), 0)])

    def __call__(self, toks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, places in the arrays, and where words are not among the frequent ones."""
        place = np.fromiter(map(self.at.get, toks, repeat(-1)), np.int32, len(toks))
        symbols, rare = self.symbol[place], np.flatnonzero(place < 0)
        symbols[rare] = [self.vocab.symbol(toks[j]) for j in rare]
        return symbols, place, rare


def count_words(docs: DataFrame) -> DataFrame:
    """word, n of training documents (text, held_out), END among them; partial counts first."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column("text").cast(pa.binary()):
                seen.update(tokens(t.as_py()))
                seen[END] += 1
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.where(~F.col("held_out")).select("text").mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """From the table of counts; at most `head` rows and one row per group reach the driver."""
    size = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(size.alias("size")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    floor, room = 1 << 62, head
    for r in sorted(steps, key=lambda r: -r["size"]):
        room -= r["words"]
        if room < 0:
            break
        floor = r["least"]
    top = {bytes(r["word"]): r["n"] for r in counts.where((F.col("n") >= floor) | (F.col("word") == F.lit(END))).collect()}
    known = sorted((w for w in top if w != END), key=lambda w: (-top[w], w))[:KNOWN]
    symbols = {w: i for i, w in enumerate([END, *known])}
    groups = [len(symbols) + g for g in range(GROUPS)]

    def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
        for batch in batches:
            for w, c in zip(batch.column("word"), batch.column("n").to_pylist(), strict=True):
                if (w := w.as_py()) not in symbols:
                    g = group_of(w)
                    n[g] += c
                    v[g] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(GROUPS), pa.int32()), pa.array(n), pa.array(v)], ["g", "n", "v"])

    sums = {r["g"]: r for r in counts.mapInArrow(grouped, "g int, n long, v long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    n, v = (np.array([sums[g][k] if g in sums else 0 for g in range(GROUPS)]) for k in ("n", "v"))
    seen = np.array([top.get(w, 0) for w in symbols] + n.tolist())
    return Vocabulary(top, symbols, groups, np.log10(n + 0.5 * (v + 1)), seen, int(seen.sum()), int(v.sum() + sum(w in top for w in symbols)))


class Network:
    """A gated recurrent unit with a class-factored softmax.

    A symbol's probability is its class's times its own within the class;
    classes hold CLASS symbols each, in order of frequency.
    """

    def __init__(self, order: np.ndarray, seed: int = 3):
        n, rng = len(order), np.random.default_rng(seed)
        classes = -(-n // CLASS)
        rank = np.empty(n, np.int64)
        rank[np.argsort(-order, kind="stable")] = np.arange(n)
        self.cls, self.slot = (rank // CLASS).astype(np.int32), (rank % CLASS).astype(np.int32)
        mass = np.full((classes, CLASS), -1.0)
        mass[self.cls, self.slot] = order + 0.5
        filled = mass > 0
        share = np.where(filled, mass, 0).sum(1)
        normal = lambda *s, by=0.1: (rng.standard_normal(s) * by).astype(np.float32)
        self.p = {
            "e": normal(n, 3 * HIDDEN), "u": normal(HIDDEN, 3 * HIDDEN, by=0.2), "bu": np.zeros(3 * HIDDEN, np.float32),
            "wc": normal(HIDDEN, classes, by=0.05), "bc": np.log(share / share.sum()).astype(np.float32),
            "w": normal(classes, HIDDEN, CLASS, by=0.05), "b": np.where(filled, np.log(np.maximum(mass, 0.5) / share[:, None]), -60).astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The next states (units, streams): a stream is a column, so that gates are whole stretches of memory."""
        return self.unit(self.p["e"][x].T, h)[0]

    def unit(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next states from the inputs' part a, and what their gradient needs."""
        d = HIDDEN
        g = self.p["u"].T @ h
        g += self.p["bu"][:, None]
        zr = a[: 2 * d] + g[: 2 * d]
        # the logistic function by way of tanh, which does not overflow
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        c = zr[d:] * g[2 * d :]
        c += a[2 * d :]
        np.tanh(c, out=c)
        new = h - c
        new *= zr[:d]
        new += c
        return new, zr, c, g

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Places in order of their target's class, and (class, start, end) in that order."""
        k = self.cls[target].astype(np.uint16)
        order = np.argsort(k, kind="stable")
        cuts = np.searchsorted(k[order], np.arange(len(self.p["bc"]) + 1)).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(pairwise(cuts)) if b > a]

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms."""
        order, classes = self.by_class(target)
        h, target, rows = h[order], target[order], np.arange(len(target))
        logits = h @ self.p["wc"]
        logits += self.p["bc"]
        out = logits[rows, self.cls[target]]
        out -= self.log_total(logits)
        own = self.within(h, target, classes)
        out += own[rows, self.slot[target]]
        out -= self.log_total(own)
        back = np.empty_like(out)
        back[order] = out
        return back

    def within(self, h: np.ndarray, target: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits of all symbols of the targets' classes; rows stand in order of the class."""
        own = np.empty((len(h), CLASS), h.dtype)
        for c, a, b in classes:
            np.matmul(h[a:b], self.p["w"][c], out=own[a:b])
        own += self.p["b"][self.cls[target]]
        return own

    def log_total(self, logits: np.ndarray) -> np.ndarray:
        """Logarithms of the sums of exponentials; the logits are lost."""
        # states lie within -1 and 1 and weights are small: logits stay far below 80, where float32 would overflow
        np.clip(logits, -80, 80, out=logits)
        np.exp(logits, out=logits)
        return np.log(logits @ np.ones(logits.shape[1], logits.dtype))

    def errors(self, logits: np.ndarray, own: np.ndarray) -> float:
        """Turns logits into probabilities less one at the target; returns the loss."""
        np.clip(logits, -80, 80, out=logits)
        np.exp(logits, out=logits)
        logits /= logits @ np.ones((logits.shape[1], 1), logits.dtype)
        rows = np.arange(len(logits))
        loss = -float(np.log(logits[rows, own] + 1e-30).sum())
        logits[rows, own] -= 1
        return loss

    def gradients(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, live: np.ndarray | None, h: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients and the last state of one window (steps, streams); none flows before it.

        States are (units, streams). fresh marks the places where a document
        begins, whose state is zero; live those that count, None for all.
        """
        p, d, (length, streams) = self.p, HIDDEN, x.shape
        a = np.ascontiguousarray(p["e"][x].transpose(0, 2, 1))
        hs, steps, starts = np.empty((length, streams, d), h.dtype), [], fresh.any(1)
        for t in range(length):
            before = h * ~fresh[t] if starts[t] else h
            h, zr, c, g = self.unit(a[t], before)
            hs[t] = h.T
            steps.append((before, zr, c, g))
        out, target = hs.reshape(-1, d), y.reshape(-1)
        places = np.arange(len(target)) if live is None else np.flatnonzero(live.reshape(-1))
        n = max(1, len(places))
        order, classes = self.by_class(target[places])
        places = places[order]
        out, target = out[places], target[places]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        e = out @ p["wc"]
        e += p["bc"]
        loss = self.errors(e, self.cls[target])
        grad["wc"], grad["bc"], back = out.T @ e, e.sum(0), e @ p["wc"].T
        slot = self.slot[target]
        for c, lo, hi in classes:
            s = out[lo:hi] @ p["w"][c]
            s += p["b"][c]
            loss += self.errors(s, slot[lo:hi])
            grad["w"][c], grad["b"][c] = out[lo:hi].T @ s, s.sum(0)
            back[lo:hi] += s @ p["w"][c].T
        dout = np.zeros((length * streams, d), h.dtype)
        dout[places] = back
        dout = np.ascontiguousarray(dout.reshape(length, streams, d).transpose(0, 2, 1))
        dh, da = np.zeros_like(h), np.empty_like(a)
        for t in range(length - 1, -1, -1):
            before, zr, c, g = steps[t]
            dh += dout[t]
            dc = c * c
            np.subtract(1, dc, out=dc)
            dc *= 1 - zr[:d]
            dc *= dh
            # of the two gates together: their own slopes times what each is worth
            slope = 1 - zr
            slope *= zr
            worth = before - c
            worth *= dh
            slope[:d] *= worth
            np.multiply(g[2 * d :], dc, out=worth)
            slope[d:] *= worth
            da[t, : 2 * d], da[t, 2 * d :] = slope, dc
            # the gates' part of the state passes through dc and r alone
            dc *= zr[d:]
            dg = np.concatenate([slope, dc])
            grad["u"] += before @ dg.T
            grad["bu"] += dg.sum(1)
            dh *= zr[:d]
            dh += p["u"] @ dg
            if starts[t]:
                dh *= ~fresh[t]
        da = np.ascontiguousarray(da.transpose(0, 2, 1))
        rows = x.reshape(-1).astype(np.uint16)
        order = np.argsort(rows, kind="stable")
        heads = np.flatnonzero(np.diff(rows[order].astype(np.int32), prepend=-1))
        grad["e"][rows[order[heads]]] = np.add.reduceat(da.reshape(-1, 3 * d)[order], heads, axis=0)
        for v in grad.values():
            v /= n
            np.clip(v, -1, 1, out=v)
        return loss, grad, h


class Trainer:
    """Adam on documents side by side, each followed from window to window.

    A stream holds one document after another; its state goes on from window to
    window and begins anew with each document.
    """

    def __init__(self, net: Network, start: int):
        self.net, self.start, self.t, self.tokens = net, start, 0, 0
        self.m, self.v = (np.zeros(sum(x.size for x in net.p.values()), np.float32) for _ in range(2))
        self.queue: deque[np.ndarray] = deque()
        self.queued = 0
        self.rest: list[np.ndarray | None] = [None] * STREAMS
        self.state = np.zeros((HIDDEN, STREAMS), np.float32)

    def add(self, symbols: np.ndarray) -> None:
        for at in range(0, len(symbols), CARRIED):
            # the symbol before the first, then all of them
            self.queue.append(np.concatenate([symbols[at - 1 : at] if at else [self.start], symbols[at : at + CARRIED]]))
        self.queued += len(symbols)
        while self.queued >= STREAMS * REACH:
            self.run()

    def finish(self) -> None:
        while self.queue or any(r is not None for r in self.rest):
            self.run()

    def run(self) -> None:
        """Lays out and trains up to REACH tokens of each stream."""
        x, y = (np.zeros((REACH, STREAMS), np.int32) for _ in range(2))
        fresh, used = np.zeros((REACH, STREAMS), bool), np.zeros(STREAMS, np.int64)
        for i, held in enumerate(self.rest):
            at = 0
            while at < REACH:
                if held is None:
                    if not self.queue:
                        break
                    held = self.queue.popleft()
                    self.queued -= len(held) - 1
                    fresh[at, i] = True
                n = min(REACH - at, len(held) - 1)
                x[at : at + n, i], y[at : at + n, i] = held[:n], held[1 : n + 1]
                at += n
                held = held[n:] if n < len(held) - 1 else None
            self.rest[i], used[i] = held, at
        busy = np.flatnonzero(used)
        x, y, fresh, used, state = x[:, busy], y[:, busy], fresh[:, busy], used[busy], self.state[:, busy]
        for at in range(0, int(used.max(initial=0)), WINDOW):
            on = np.flatnonzero(used > at)
            spots = slice(at, min(at + WINDOW, int(used.max())))
            cut = (spots, on)
            live = np.arange(spots.start, spots.stop)[:, None] < used[on]
            _, grad, state[:, on] = self.net.gradients(x[cut], y[cut], fresh[cut], None if live.all() else live, state[:, on])
            self.tokens += int(live.sum())
            self.update(np.concatenate([grad[k].reshape(-1) for k in self.net.p]))
        self.state[:, busy] = state

    def update(self, g: np.ndarray) -> None:
        self.t += 1
        rate = RATE * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        self.m += 0.1 * (g - self.m)
        g *= g
        g -= self.v
        g *= 0.001
        self.v += g
        np.sqrt(self.v, out=g)
        g += 1e-6
        np.divide(self.m, g, out=g)
        g *= rate
        at = 0
        for k, v in self.net.p.items():
            self.net.p[k] = v - g[at : at + v.size].reshape(v.shape)
            at += v.size


def train(docs: DataFrame, words: Broadcast, rounds: int = ROUNDS) -> Network:
    """Rounds of local training on all training documents, weights averaged between them.

    Each task trains a copy on every token of each of its documents; Spark
    sums the copies' weights, each by the tokens it saw, and one weight vector
    reaches the driver.
    """
    net, sc = Network(words.value.order), docs.sparkSession.sparkContext
    for _ in range(rounds):
        weights = sc.broadcast(net.flat())

        def each(batches: Iterable[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            vocab = words.value
            own = Network(vocab.order)
            own.load(weights.value)
            look, end = vocab.lookup, vocab.symbols[END]
            trainer = Trainer(own, end)
            for batch in batches:
                for t in batch.column("text").cast(pa.binary()):
                    trainer.add(np.append(look(tokens(t.as_py()))[0], end))
            trainer.finish()
            if trainer.tokens:
                yield pa.RecordBatch.from_arrays([pa.array([trainer.tokens], pa.int64()), pa.array([own.flat().tolist()], pa.list_(pa.float32()))], ["seen", "weights"])

        copies = docs.where(~F.col("held_out")).select("text").mapInArrow(each, "seen long, weights array<float>")
        sums = copies.select("seen", F.posexplode("weights").alias("i", "x")).groupBy("i").agg((F.sum(F.col("x").cast("double") * F.col("seen")) / F.sum("seen")).alias("x")).collect()
        if sums:
            net.load(np.array([r["x"] for r in sorted(sums, key=lambda r: r["i"])]))
    return net


def score_symbols(net: Network, texts: list[np.ndarray], start: int) -> np.ndarray:
    """log10 probability of each text's symbols; the state runs from its first to its last."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[i]) for i in order])
    flat, first = np.concatenate([texts[i] for i in order]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out, h, last = np.zeros(len(texts)), np.zeros((HIDDEN, len(texts)), np.float32), np.full(len(texts), start)
    for at in range(0, int(sizes[0]), STEPS):
        states, targets, owners = [], [], []
        for t in range(at, min(at + STEPS, int(sizes[0]))):
            live = int(np.searchsorted(-sizes, -t, "left"))
            h = net.step(last[:live], h[:, :live])
            last = flat[first[:live] + t]
            states.append(h.T)
            targets.append(last)
            owners.append(np.arange(live))
        h_all, t_all = np.concatenate(states), np.concatenate(targets)
        # few enough rows at once that their logits stay in the processor's cache
        got = np.concatenate([net.log_probability(h_all[i : i + ROWS], t_all[i : i + ROWS]) for i in range(0, len(t_all), ROWS)])
        out += np.bincount(np.concatenate(owners), got, len(out))
    back = np.empty(len(texts))
    back[order] = out / math.log(10)
    return back


def score_documents(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with crc32(doc_id as text) mod folds equal to held_fold are held
    out; all others count and train. A null doc_id is held out; null texts are
    empty (the end token alone). Repeated rows are documents of their own.
    base_score is the smoothed unigram log10 probability. score is the model's:
    the network's for words it knows; for others that of their group in this
    place times their smoothed share of the group. Without training documents
    the network stays as it began.

    Counts of up to `head` frequent words go to every task; rarer words of a
    document are joined with their counts, which can't be skewed, as no word
    among them is frequent.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    docs = columns(rows, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(fold == held_fold, F.lit(True)).alias("held_out"))
    counts = cut(count_words(docs), "word-counts")
    sc = docs.sparkSession.sparkContext
    words = vocabulary(counts, head)
    shipped = sc.broadcast(words)
    weights = sc.broadcast(train(docs, shipped, rounds).flat())

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shipped.value
        own = Network(vocab.order)
        own.load(weights.value)
        look, end = vocab.lookup, vocab.symbols[END]
        end_log, base, serial = math.log10(vocab.head.get(END, 0) + 0.5), int.from_bytes(os.urandom(8), "big", signed=True), 0
        ids, held, facts, rare, numbers, room = [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            scores = score_symbols(own, numbers, end)
            n, k, b, s = (list(c) for c in zip(*facts, strict=True))
            uids = [(base + serial + i + (1 << 63)) % (1 << 64) - (1 << 63) for i in range(len(ids))]
            return pa.RecordBatch.from_arrays([
                pa.array(uids, pa.int64()), pa.array(ids, id_kind), pa.array(held, pa.bool_()), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(b, pa.float64()), pa.array(scores + np.array(s), pa.float64()),
                pa.array([list(r) for r in rare], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rare], pa.list_(pa.int64())),
            ], ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare", "times"])

        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            for i, t, h in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("held_out").to_pylist(), strict=True):
                toks = tokens(t.as_py())
                nums, place, missing = look(toks)
                tail = Counter(toks[j] for j in missing)
                rest = look.share[place].sum() - vocab.weight[nums[missing] - len(vocab.symbols)].sum()
                ids.append(i)
                held.append(h)
                facts.append((len(toks) + 1, len(toks) - len(missing) + (END in vocab.head), float(look.log[place].sum()) + end_log, float(rest)))
                rare.append(tail)
                numbers.append(np.append(nums, np.int32(end)))
                room += len(numbers[-1])
                if room >= TOKENS:
                    yield out()
                    serial += len(ids)
                    ids, held, facts, rare, numbers, room = [], [], [], [], [], 0
        if ids:
            yield out()

    kinds = f"uid long, doc_id {dict(rows.dtypes)[doc_id]}, held_out boolean, n_tokens long, known long, base double, model double, rare array<binary>, times array<long>"
    scored = cut(docs.mapInArrow(each, kinds), "scored")
    rare = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    joined = rare.join(counts, "word", "left").select("uid", "times", F.coalesce("n", F.lit(0)).alias("n"))
    tails = joined.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + F.lit(0.5))).alias("tail"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    done = scored.drop("rare", "times").join(tails, "uid", "left")
    tail = F.coalesce("tail", F.lit(0.0))
    norm = math.log10(words.total + 0.5 * (words.distinct + 1))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + tail - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("model") + tail).alias("score"),
    )
