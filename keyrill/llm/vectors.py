"""Near vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyrill.llm.components import components
from keyrill.llm.shared import columns, cut

#: Rows of a bucket that one cell compares with as many others, and how many of them at a time.
BLOCK, TILE = 2048, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """(rows, tables, 4): each table's bucket and three further probes.

    A table joins two hashes; each is the signed axis nearest to the vector
    after three rounds of random signs and a Hadamard transform. The probes
    take the second nearest axis in either hash or both.
    """
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng, rows = np.random.default_rng(seed), np.arange(n)
    out = np.empty((n, tables, 4), np.int32)
    for t in range(tables):
        best = []
        for _ in range(2):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
            size = np.abs(y)
            first = size.argmax(1)
            size[rows, first] = -1
            second = size.argmax(1)
            best.append([2 * a + (y[rows, a] < 0) for a in (first, second)])
        (a1, a2), (b1, b2) = best
        for p, (a, b) in enumerate(((a1, b1), (a2, b1), (a1, b2), (a2, b2))):
            out[:, t, p] = a * 2 * width + b
    return out


def unit(vectors: list[list]) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square overflows."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashed(tables: int, seed: int):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors, dims = part.column("v").to_pylist(), np.array([len(v) for v in part.column("v").to_pylist()])
                for d in np.unique(dims):
                    mine = np.flatnonzero(dims == d)
                    x = unit([vectors[i] for i in mine])
                    c = codes(x, tables, seed)
                    own = part.take(pa.array(mine))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("label"), own.column("v"), own.column("rep"), own.column("first"), own.column("copies"), pa.array(np.full(len(mine), d), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in c], pa.binary()), pa.array(c.reshape(len(mine), -1).tolist(), pa.list_(pa.int32()))],
                        names=["label", "v", "rep", "first", "copies", "dim", "unit", "codes", "probes"],
                    )

    return each


def _meet(prim: np.ndarray, probes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (a, b), rep a < rep b: the table and bucket where they first meet."""
    table, bucket = np.full(len(a), -1), np.full(len(a), -1)
    for t in range(prim.shape[1]):
        for x, y in ((a, b), (b, a)):
            hit = (table < 0) & (probes[y, t] == prim[x, t][:, None]).any(1)
            table[hit], bucket[hit] = t, prim[x, t][hit]
    return table, bucket


def cell_links(reps: np.ndarray, copies: np.ndarray, x: np.ndarray, c: np.ndarray, block: np.ndarray, table: int, bucket: int, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a link in this cell: index, links counted here, least row index reached here.

    A pair counts in the first bucket where it meets, so that it counts once.
    Rows are compared TILE by TILE, so memory grows with the rows and not with
    their square.
    """
    order = np.argsort(reps)
    reps, copies, x, c, block = reps[order], copies[order], x[order], c[order], block[order]
    own, n = c[:, table, 0] == bucket, len(reps)
    links, root, linked = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
    stars = []
    for lo in range(0, n, TILE):
        for to in range(lo, n, TILE):
            rows, cols = slice(lo, lo + TILE), slice(to, to + TILE)
            near = x[rows] @ x[cols].T >= cosine
            near &= own[rows, None] | own[None, cols]
            if not same:
                near &= block[rows, None] != block[None, cols]
            a, b = np.nonzero(near)
            a, b = a + lo, b + to
            if lo == to:
                a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            t, where = _meet(c[:, :, 0], c, a, b)
            here = (t == table) & (where == bucket)
            np.add.at(links, a[here], copies[b[here]])
            np.add.at(links, b[here], copies[a[here]])
            linked[a], linked[b] = True, True
            # a tile's links as stars: every row in it and the least that it reaches
            low = spread(np.arange(n), a, b)
            held = np.flatnonzero(low != np.arange(n))
            stars.append((low[held], held))
    if stars:
        root = spread(root, *(np.concatenate(s) for s in zip(*stars, strict=True)))
    at = np.flatnonzero(linked)
    return order[at], links[at], order[root[at]]


def spread(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each row reaches along the pairs (a, b)."""
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compared(cosine: float):
    keys = ("label", "dim", "table", "bucket", "ci", "cj")
    fields = ("rep", "copies", "unit", "codes", "block")

    def solve(key: tuple, held: list[dict]) -> pa.RecordBatch | None:
        rep, copies, units, cs, block = (np.concatenate([h[f] for h in held]) for f in fields)
        if len(rep) < 2:
            return None
        x = np.stack([np.frombuffer(u) for u in units])
        c = np.stack([np.frombuffer(u, np.int32).reshape(-1, 4) for u in cs])
        at, links, root = cell_links(rep, copies, x, c, block, key[2], key[3], key[4] == key[5], cosine)
        return pa.RecordBatch.from_pydict({"rep": rep[at], "links": links, "root": rep[root]}) if len(at) else None

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            cols = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            data = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in fields}
            cuts = [0, *[i for i in range(1, len(cols)) if cols[i] != cols[i - 1]], len(cols)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if cols[lo] != key:
                    if held and (out := solve(key, held)):
                        yield out
                    key, held = cols[lo], []
                held.append({f: v[lo:hi] for f, v in data.items()})
        if held and (out := solve(key, held)):
            yield out

    return each


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93, tables: int = 6, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row.

    Vectors link if their labels are equal, their lengths too, and their cosine
    is at least `cosine`. A vector that is null, empty, zero or holds null or
    non-finite parts, or whose label or vec_id is null, links with nothing; its
    component is itself (with a null vec_id: null, and it isn't kept). Equal
    vectors of a label count as one with copies, under a number of its own, so
    that a vec_id may stand at several rows: each is a vector of its own.

    Every vector goes to four buckets in each table, by id alone; buckets where
    nothing can meet go, and vectors are then sent to the others. A bucket of
    more than BLOCK rows is compared block by block in separate cells. Cells
    return counts and spanning links, never pairs.
    """
    source = columns(rows, vec_id=vec_id, v=embedding, label=label)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("v", finite) & F.exists("v", lambda e: e != 0), F.lit(False))
    source = source.withColumn("label", F.col("label").cast("string"))
    reps = source.where(fit).groupBy("label", "v").agg(F.min("vec_id").cast("long").alias("first"), F.count("*").alias("copies"))
    kinds = f"label string, v {dict(source.dtypes)['v']}, rep long, first long, copies long, dim int, unit binary, codes binary, probes array<int>"
    # numbers are drawn once: what follows reads them from the table
    numbered = reps.select("label", "v", F.monotonically_increasing_id().alias("rep"), "first", "copies")
    hashed = cut(numbered.mapInArrow(_hashed(tables, seed), kinds), "vectors")
    spots = hashed.select("label", "dim", "rep", F.posexplode("probes").alias("p", "bucket"))
    spots = spots.select("label", "dim", "rep", F.floor(F.col("p") / 4).cast("int").alias("table"), "bucket", (F.col("p") % 4 == 0).cast("int").alias("own"))
    where = ["label", "dim", "table", "bucket"]
    sizes = spots.groupBy(*where).agg(F.count("*").alias("n"), F.sum("own").alias("own_n")).where("n > 1 AND own_n > 0").drop("own_n")
    met = spots.drop("own").join(sizes, where).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = met.select(*where, "rep", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select(*where, "rep", "block", F.least("block", "other").alias("ci"), F.greatest("block", "other").alias("cj"))
    sent = cells.join(hashed.select("rep", "copies", "unit", "codes"), "rep").repartition(*where, "ci", "cj").sortWithinPartitions(*where, "ci", "cj")
    found = cut(sent.mapInArrow(_compared(cosine), "rep long, links long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rep"), "root")
    rooted = hashed.select("label", "v", "rep", "first", "copies").join(stars, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    names = rooted.groupBy("root").agg(F.min("first").alias("name"))
    classes = rooted.join(names, "root").join(counts, "rep", "left")
    classes = cut(classes.select("label", "v", F.coalesce("links", F.lit(0)).alias("links"), "copies", "name"), "classes")
    good = source.where(fit).join(classes, ["label", "v"]).select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("name").alias("component_id"))
    bad = source.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
