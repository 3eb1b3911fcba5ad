"""Benchmark passages in documents, by CGK embedding, bit-sampling LSH and exact edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keyrill.llm.shared import columns, map_rows

WORD = re.compile(r"\w+")
#: Items of fewer words are found by their exact pieces, longer ones by hashing.
SHORT = 8
#: Items of twice so many words or more are sought by parts of at least so many.
PART = 20
#: Words of benchmark items that go to the tasks at once; a larger benchmark takes several passes.
BLOCK_WORDS = 2_000_000
#: Tables of each random walk, and positions that a table samples.
TABLES, SAMPLED = 6, 3
#: Numbers of walks that are tried until trials reach the target recall, and trials for each.
WALKS, TRIALS = (4, 6, 8, 12, 16, 24, 32), 1000
#: The share of matches at the full number of edits that hashing must find.
RECALL = 0.995
#: Texts that are searched together, so that their windows are embedded together.
TEXTS = 256


def normal_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def edits_allowed(n: int, share: float) -> int:
    return int(n * share + 1e-9)


def parts_of(n: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of an item of n words.

    Where an item is within its edits, some part is within its own: if each had
    more than its share, all together would have more than the item's.
    """
    m = max(1, n // PART)
    return [(n * i // m, n * (i + 1) // m) for i in range(m)]


@dataclass
class Match:
    item: int
    start: int
    end: int
    edits: int


def best_alignment(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Edits, start and end of the stretch of the region nearest to the item; the shortest of equals."""
    one = 1 << 32
    at = np.arange(len(region) + 1, dtype=np.int64)
    row = one - 1 - at  # edits above, start below: less is nearer, then later
    for w in item:
        skip, change = row + one, row[:-1] + np.where(region == w, 0, one)
        row = skip
        row[1:] = np.minimum(row[1:], change)
        row = np.minimum.accumulate(row - at * one) + at * one
    end = int(row.argmin())
    edits = int(row[end] // one)
    return edits, int(one - 1 - row[end] % one), end


class Walks:
    """Random CGK embeddings of word numbers and their sampling tables."""

    def __init__(self, size: int, walks: int, rng: np.random.Generator):
        self.walks = walks
        # steps late in a walk read mostly past both ends, where all agree
        reach = max(SAMPLED, int(1.6 * size))
        self.taken = np.stack([np.stack([rng.choice(reach, SAMPLED, replace=False) for _ in range(TABLES)]) for _ in range(walks)])
        self.salt = rng.integers(1 << 63, size=(int(self.taken.max()) + 1, walks, 1), dtype=np.uint64)

    def keys(self, rows: np.ndarray, base: int) -> np.ndarray:
        """(walks * TABLES, rows) numbers of the words at the sampled steps; -1 if one is in no item or past the end.

        A step reads the word at its place and moves on if a hash of the walk,
        the step and the word says so, so insertions and deletions are soon in
        step again and edit distance turns into Hamming distance. The hash
        stands for a table of random bits, whose size would grow with the words.
        """
        n, width = rows.shape
        padded = np.concatenate([rows, np.full((n, 1), base - 1, rows.dtype)], axis=1).reshape(-1)
        line = np.arange(n)[None] * (width + 1)
        at = np.zeros((self.walks, n), np.int64)
        read = np.empty((len(self.salt), self.walks, n), np.int64)
        for t, salt in enumerate(self.salt):
            read[t] = padded[line + at]
            mixed = read[t].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ salt
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            at = np.minimum(at + (mixed >> np.uint64(63)).astype(np.int64), width)
        got = read[self.taken, np.arange(self.walks)[:, None, None]]  # walk, table, sample, row
        known = ((got > 0) & (got < base - 1)).all(2)
        key = got[:, :, 0].copy()
        for i in range(1, SAMPLED):
            key = key * base + got[:, :, i]
        return np.where(known, key, -1).reshape(-1, n)

    def recall(self, size: int, stride: int, lengths: list[int], share: float, rng: np.random.Generator) -> float:
        """The share of trials in which an item and a stretch at all its allowed edits collide, wherever windows start."""
        words, items, wins = 4 * size + 50, [], []
        for n in range(TRIALS):
            item = rng.integers(1, words, lengths[n % len(lengths)])
            stretch = item.tolist()
            for _ in range(edits_allowed(len(item), share)):
                at, kind = int(rng.integers(len(stretch) + 1)), rng.integers(3)
                stretch[at : at + (kind < 2)] = [int(rng.integers(1, words))] if kind else []
            lead = int(rng.integers(2 * stride))
            around = [*rng.integers(1, words, lead).tolist(), *stretch, *rng.integers(1, words, 2 * size).tolist()]
            items.append(np.pad(item, (0, max(lengths) - len(item)), constant_values=words))
            wins += [around[at : at + size] for at in range(0, 3 * stride, stride)]
        a = self.keys(np.array(items), words + 1)
        b = self.keys(np.array(wins), words + 1).reshape(len(a), TRIALS, 3)
        return float(((a[:, :, None] == b) & (b >= 0)).any((0, 2)).mean())


def walks_for(size: int, stride: int, lengths: list[int], share: float, recall: float, rng: np.random.Generator) -> Walks:
    """As few walks as reach the recall in trials; the most there are if none do."""
    for n in WALKS:
        walks = Walks(size, n, rng)
        if walks.recall(size, stride, lengths, share, rng) >= recall:
            break
    return walks


class Benchmark:
    """Items prepared for search; goes to the tasks as a broadcast."""

    def __init__(self, items: list[tuple], share: float, recall: float = RECALL, seed: int = 17):
        items = [(i, words) for i, words in items if words]
        self.share, self.recall, self.ids = share, recall, [i for i, _ in items]
        self.words = {w: n for n, w in enumerate(dict.fromkeys(w for _, words in items for w in words), 1)}
        self.base = len(self.words) + 2
        self.items = [np.array([self.words[w] for w in words], np.int64) for _, words in items]
        #: by their first word: the exact pieces of short items, one of which any match must hold
        self.short: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for n, x in enumerate(self.items):
            if len(x) < SHORT:
                cuts = np.linspace(0, len(x), edits_allowed(len(x), share) + 2).astype(int).tolist()
                for a, b in pairwise(cuts):
                    if b > a:
                        self.short.setdefault(int(x[a]), []).append((n, a, x[a:b]))
        self.grams = np.unique(np.concatenate([self.gram_numbers(x) for x in self.items if len(x) >= SHORT] or [np.array([], np.int64)]))
        #: item, start and end of each part
        self.parts = [(n, a, b) for n, x in enumerate(self.items) if len(x) >= SHORT for a, b in parts_of(len(x))]
        rng, size, self.classes = np.random.default_rng(seed), SHORT, []
        long = sorted((b - a, p) for p, (_, a, b) in enumerate(self.parts))
        while long:
            size = max(size, long[0][0])
            top = size + size // 5
            mine = [p for m, p in long if m <= top]
            long = [(m, p) for m, p in long if m > top]
            self.classes.append(self.window_class((size + top) // 2, mine, rng))

    def gram_numbers(self, x: np.ndarray) -> np.ndarray:
        """Three words as one number; 0 if one of them is in no item."""
        a, b, c = x[:-2], x[1:-1], x[2:]
        return np.where((a > 0) & (b > 0) & (c > 0), (a * self.base + b) * self.base + c, 0)

    def window_class(self, size: int, mine: list[int], rng: np.random.Generator) -> tuple:
        stride = max(1, size // 16)
        words = [self.part(p) for p in mine]
        edits = [edits_allowed(len(w), self.share) for w in words]
        slack = max(k + abs(len(w) - size) for w, k in zip(words, edits, strict=True)) + stride
        # a part keeps all but three of its word triples for each edit
        least = min(len(w) - 2 - 3 * k for w, k in zip(words, edits, strict=True))
        shortest = min(len(w) - k for w, k in zip(words, edits, strict=True))
        rows = np.full((len(mine), max(map(len, words))), self.base - 1, np.int64)
        for i, w in enumerate(words):
            rows[i, : len(w)] = w
        walks = walks_for(size, stride, sorted({len(w) for w in words}), self.share, self.recall, rng)
        tables = []
        for keys in walks.keys(rows, self.base):
            order = np.argsort(keys, kind="stable")
            order = order[keys[order] >= 0]
            tables.append((keys[order], np.array(mine)[order]))
        return size, stride, slack, max(1, least), shortest, walks, tables

    def part(self, p: int) -> np.ndarray:
        n, a, b = self.parts[p]
        return self.items[n][a:b]

    def hits(self, x: np.ndarray) -> np.ndarray:
        """Where a triple of some item's words starts."""
        known = x > 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        gram = (x[at] * self.base + x[at + 1]) * self.base + x[at + 2]
        place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        return at[self.grams[place] == gram]

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, part, start, size) of windows that collide with an item's part.

        Windows whose surroundings hold too few of all items' word triples for
        any part within its edits are passed over; that loses no match. The
        others are embedded. Windows start as late as the shortest part that
        deletions may leave; past the end of the text they are padded.
        """
        if not self.classes:
            return
        marked = [(i, x, self.hits(x)) for i, x in enumerate(texts) if len(x) >= 3]
        for size, stride, slack, least, shortest, walks, tables in self.classes:
            wins, spots = [], []
            for i, x, hit in marked:
                if len(hit) < least:
                    continue
                starts = np.arange(0, max(1, len(x) - shortest + stride), stride)
                inside = np.searchsorted(hit, starts + size + slack - 2) - np.searchsorted(hit, starts - slack)
                starts = starts[inside >= least]
                at = starts[:, None] + np.arange(size)
                wins.append(np.where(at < len(x), x[np.minimum(at, len(x) - 1)], self.base - 1))
                spots.append(np.stack([np.full(len(starts), i), starts], axis=1))
            if not wins:
                continue
            rows, where = np.concatenate(wins), np.concatenate(spots)
            for lo in range(0, len(rows), 2048):
                found = set()
                for keys, (known, parts) in zip(walks.keys(rows[lo : lo + 2048], self.base), tables, strict=True):
                    left, right = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                    for r in np.flatnonzero(right > left):
                        found.update((lo + int(r), int(n)) for n in parts[left[r] : right[r]])
                yield from ((int(where[r, 0]), n, int(where[r, 1]), size) for r, n in sorted(found))

    def search(self, texts: list[str | None]) -> list[list[Match]]:
        """Each text's stretches within an item's edits, in order; those of one item don't overlap."""
        get = self.words.get
        numbers = [np.array([get(w, 0) for w in normal_words(t)], np.int64) for t in texts]
        found: list[list[Match]] = [self.short_matches(x) for x in numbers]
        seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
        tried: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, p, start, size in self.candidates(numbers):
            x, part, (n, own, end) = numbers[i], self.part(p), self.parts[p]
            k = edits_allowed(len(part), self.share)
            reach = k + abs(len(part) - size) + size // 4
            lo, hi = max(0, start - reach), min(len(x), start + size + reach)
            if any(a <= max(0, start - k) and min(len(x), start + size + k) <= b for a, b in seen.get((i, p), ())):
                continue
            seen.setdefault((i, p), []).append((lo, hi))
            edits, a, b = best_alignment(part, x[lo:hi])
            if edits > k:
                continue
            a, b = lo + a, lo + b
            item = self.items[n]
            if len(part) < len(item):
                # around the part, as much as the item's edits may shift it
                k = edits_allowed(len(item), self.share)
                first, last = a - own, b + len(item) - end
                if any(u <= max(0, first - k) and min(len(x), last + k) <= v for u, v in tried.get((i, n), ())):
                    continue
                lo, hi = max(0, first - k - reach), min(len(x), last + k + reach)
                tried.setdefault((i, n), []).append((lo, hi))
                edits, a, b = best_alignment(item, x[lo:hi])
                a, b = lo + a, lo + b
            if edits <= k:
                found[i].append(Match(n, a, b, edits))
        return [self.apart(f) for f in found]

    def short_matches(self, x: np.ndarray) -> list[Match]:
        """Short items: of so many edits and one piece more than that, some piece stands in the text word for word."""
        out, seen = [], set()
        for at in np.flatnonzero(np.isin(x, list(self.short))).tolist() if self.short else ():
            for n, a, piece in self.short[int(x[at])]:
                if not np.array_equal(x[at : at + len(piece)], piece):
                    continue
                item = self.items[n]
                k = edits_allowed(len(item), self.share)
                lo, hi = max(0, at - a - k), min(len(x), at - a + len(item) + k)
                if (n, lo, hi) in seen:
                    continue
                seen.add((n, lo, hi))
                edits, a, b = best_alignment(item, x[lo:hi]) if k else (0 if np.array_equal(x[lo:hi], item) else 1, 0, hi - lo)
                if edits <= k:
                    out.append(Match(n, lo + a, lo + b, edits))
        return out

    def apart(self, found: list[Match]) -> list[Match]:
        kept: dict[int, list[Match]] = {}
        for m in sorted(found, key=lambda m: (m.item, m.edits, m.start, m.end)):
            if not any(o.start < m.end and m.start < o.end for o in kept.get(m.item, ())):
                kept.setdefault(m.item, []).append(m)
        return sorted((m for own in kept.values() for m in own), key=lambda m: (m.start, m.item))


def benchmark_blocks(items: DataFrame, share: float, recall: float, item_id: str, text: str) -> Iterator[Benchmark]:
    """Items in blocks of at most BLOCK_WORDS words and one item; one block is held at a time."""
    block, size = [], 0
    for r in columns(items, item_id=item_id, text=text).toLocalIterator():
        words = normal_words(r["text"])
        if block and size + len(words) > BLOCK_WORDS:
            yield Benchmark(block, share, recall)
            block, size = [], 0
        block.append((r["item_id"], words))
        size += len(words)
    yield Benchmark(block, share, recall)


def find_leaks(docs: DataFrame, items: DataFrame, edits: float = 0.2, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, end_word, edits: where documents hold benchmark items.

    Words are runs of letters, digits and underscores, in lower case. A
    stretch of a document is an item's if it is at most `edits` times the
    item's words away in edit distance. Items of under SHORT words are all
    found; of longer ones hashing finds the share `recall` even where all
    allowed edits are used, which trials with random words settle, and more
    where fewer are. Null and empty texts and items hold nothing; equal
    items and repeated rows are each reported.
    """
    spark, source = docs.sparkSession, columns(docs, doc_id=doc_id, text=text)
    kinds = f"doc_id {dict(docs.dtypes)[doc_id]}, item_id {dict(items.dtypes)[item_id]}, start_word int, end_word int, edits int"
    out = None
    for block in benchmark_blocks(items, edits, recall, item_id, item_text):
        shipped = spark.sparkContext.broadcast(block)

        def each(batches: Iterable[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            b = shipped.value
            for batch in batches:
                rows = []
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    rows += [(i, b.ids[m.item], m.start, m.end, m.edits) for i, found in zip(part.column("doc_id").to_pylist(), b.search(part.column("text").to_pylist()), strict=True) for m in found]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "item_id"), map(list, list(zip(*rows, strict=True))[:2]), strict=True)) | {k: pa.array([r[i] for r in rows], pa.int32()) for i, k in ((2, "start_word"), (3, "end_word"), (4, "edits"))})

        found = source.mapInArrow(each, kinds)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, edits: float = 0.2, recall: float = RECALL, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which find_leaks would find nothing, with all their columns."""
    for block in benchmark_blocks(items, edits, recall, item_id, item_text):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def each(batches: Iterable[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    yield part.filter(pa.array([not found for found in shipped.value.search(part.column(text).to_pylist())], pa.bool_()))

        docs = map_rows(docs, each, [])
    return docs
