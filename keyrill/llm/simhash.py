"""SimHash fingerprints, and links within a Hamming radius by meeting in the middle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from keyrill.llm.components import components
from keyrill.llm.shared import columns, cut, quoted

#: bits of each byte value
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: shingles that are hashed before they are counted, which bounds memory on long texts
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, as a signed number; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    lasts = ends[shingle - 1 :] or ends[-1:]
    h, counts = xxhash.xxh64_intdigest, np.zeros((8, 8), np.int64)
    for at in range(0, len(lasts), BLOCK):
        part = [h(line[s : e - 1], seed) for s, e in zip(starts[at : at + BLOCK], lasts[at : at + BLOCK])]  # noqa: B905  the first ends with the last
        octets = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[i] += np.bincount(octets[:, i], minlength=256) @ BITS
    bits = (2 * counts > len(lasts)).reshape(-1)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp: one row per row; a null text has no words."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = [fingerprint(t.as_py() or b"", shingle, seed) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return columns(docs, doc_id=doc_id, text=text).mapInArrow(each, f"doc_id {dict(docs.dtypes)[doc_id]}, fp long")


def masks(radius: int) -> list[int]:
    """All 64-bit words with at most `radius` bits set, as signed numbers."""
    found = [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links u > v between distinct fingerprints (column fp) at most `radius` bits apart.

    Every fingerprint emits all variants within half the radius; two that are
    near enough meet at one. A variant's bucket holds no more fingerprints than
    the ball has variants. Each is linked with the least of its bucket, after a
    check of their distance; fingerprints of a bucket of an even radius are all
    near, so the links keep every connection. For an odd radius the whole
    bucket is paired and checked.
    """
    spread = fps.select("fp", F.explode(F.lit(masks((radius + 1) // 2))).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    bucket = Window.partitionBy("variant")
    if radius % 2 == 0:
        met = spread.withColumn("v", F.min("fp").over(bucket)).where("fp > v").select(F.col("fp").alias("u"), "v")
    else:
        met = spread.join(spread.select(F.col("fp").alias("v"), "variant"), "variant").where("fp > v").select(F.col("fp").alias("u"), "v")
    return met.distinct().where(near)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id: the least doc_id that links reach.

    Copies share a fingerprint, so links are sought between distinct ones.
    Texts without words have fingerprint zero and link like any other. A null
    doc_id has a row but is no component's name unless no other id is there.
    """
    found = cut(fingerprints(docs, doc_id, text, shingle, seed), "fingerprints")
    firsts = found.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    stars = components(ball_links(firsts.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = firsts.join(stars, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = cut(rooted.join(names, "root").select("fp", "component_id"), "classes")
    return found.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of a text by which similar texts are sought, and bits of each.
TABLES, WIDTH = 12, 32
#: Bits of all fingerprints together that may differ before a pair is not worth the exact check; at a
#: similarity of 0.8 about 58 of 384 differ, with a deviation of 7.
PLAUSIBLE = 100


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The different hashes of a text's shingles, in order; a text of fewer words is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.array([], np.uint64)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(line[s : e - 1], seed) for s, e in zip([0, *ends[:-1]], ends[shingle - 1 :] or ends[-1:])], np.uint64))  # noqa: B905


def signature(hashes: np.ndarray, bits: int = TABLES * WIDTH) -> np.ndarray:
    """SimHash bits, 64 to each remix of the shingles' hashes, as bytes."""
    out = []
    for i in range(-(-bits // 64)):
        counts = np.zeros((8, 8), np.int64)
        for at in range(0, len(hashes), BLOCK):
            x = hashes[at : at + BLOCK] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            octets = (x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8)
            for j in range(8):
                counts[j] += np.bincount(octets[:, j], minlength=256) @ BITS
        out.append(np.packbits((2 * counts > len(hashes)).reshape(-1), bitorder="little"))
    return np.concatenate(out)[: bits // 8]


def signed(rows: DataFrame, shingle: int = 5, tables: int = TABLES) -> DataFrame:
    """The rows with prints, `tables` fingerprints of WIDTH bits, in place of text; null for a text without words."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    keys = [f.name for f in kept]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for t in batch.column("text").cast(pa.binary()):
                x = shingle_hashes(t.as_py() or b"", shingle)
                prints.append(signature(x, tables * WIDTH).view("<u4").astype(np.int64).tolist() if len(x) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(prints, pa.list_(pa.int64()))], names=[*keys, "prints"])

    return rows.select(*keys, "text").mapInArrow(each, StructType([*kept, StructField("prints", ArrayType(LongType()))]))


#: First bits of a fingerprint by which near ones are dealt out, and rows that are looked through together.
PREFIX, TOGETHER = 8, 1 << 18


def meetings(site: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs fp > other of different fingerprints that share a variant, with one bit of each flipped at most, at the sites.

    A site is a table and the first PREFIX bits of a variant. Fingerprints that
    have the site's first bits flip none or one of the others; the rest came
    here by a flip of one of the first.
    """
    low = WIDTH - PREFIX
    at_home = fps >> low == site
    home, guests = fps[at_home], fps[~at_home]
    variant = np.concatenate([(home[:, None] ^ np.append(0, 1 << np.arange(low))).reshape(-1), site[~at_home] << low | guests & (1 << low) - 1])
    holder = np.concatenate([np.repeat(home, low + 1), guests])
    order = np.argsort(variant)
    variant, holder = variant[order], holder[order]
    found, at, step = [(holder[:0], holder[:0])], np.arange(len(variant)), 0
    # a variant has no more holders than its ball has members, so this ends soon
    while len(at):
        step += 1
        at = at[at + step < len(variant)]
        at = at[variant[at] == variant[at + step]]
        found.append((holder[at], holder[at + step]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.maximum(a, b), np.minimum(a, b)


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """meetings() of whole sites; rows come sorted by site."""

    def out(site: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = meetings(site, fps)
        for at in range(0, len(pairs[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in pairs], ["fp", "other"])

    held, rows, enough = [], 0, TOGETHER
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("site", "fp")])
        rows += batch.num_rows
        if rows >= enough:
            site, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            # the last site may go on in the next batch
            end = int(np.searchsorted(site, site[-1]))
            yield from out(site[:end], fps[:end])
            held, rows = [[site[end:], fps[end:]]], len(site) - end
            enough = max(TOGETHER, 2 * rows)
    if rows:
        yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def print_groups(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (u, prints) by fingerprint, and fingerprints that are within two bits.

    members: u, fp, the table and its fingerprint in one number. near: fp > other,
    distinct fingerprints of a table that meet at a variant of each, with one
    bit flipped at most. A fingerprint goes to the sites of its variants, one for
    its own first bits and one for each of them flipped. Variants themselves are
    made and put in order there, so they are no rows of a table and not shuffled.
    """
    low = WIDTH - PREFIX
    members = prints.select("u", F.posexplode("prints").alias("table", "print"))
    members = cut(members.select("u", (F.col("table").cast("long") * F.lit(1 << WIDTH) + F.col("print")).alias("fp")), "prints")
    flips = F.explode(F.lit([0, *(1 << i for i in range(PREFIX))]))
    spread = members.select("fp").distinct().select("fp", flips.alias("flip")).select(F.shiftright("fp", low).bitwiseXOR(F.col("flip").cast("long")).alias("site"), "fp")
    met = spread.repartition("site").sortWithinPartitions("site").mapInArrow(_met, "fp long, other long")
    return members, cut(met.distinct(), "near-prints")


def plausible(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (u, v) without those whose fingerprints together differ in too many bits."""
    pairs = pairs.distinct().join(prints.select("u", F.col("prints").alias("a")), "u").join(prints.select(F.col("u").alias("v"), F.col("prints").alias("b")), "v")
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return cut(pairs.where(apart * TABLES <= PLAUSIBLE * F.size("a")).select("u", "v"), "likely")


def first_candidates(groups: tuple[DataFrame, DataFrame], prints: DataFrame) -> DataFrame:
    """Likely pairs u > v that tie each text to the first of its fingerprint, and the first of a fingerprint to the first of the least near one."""
    members, near = groups
    firsts = members.groupBy("fp").agg(F.min("u").alias("v"))
    same = members.join(firsts, "fp").where("u > v").select("u", "v")
    least = near.groupBy("fp").agg(F.min("other").alias("other"))
    ties = least.join(firsts.withColumnRenamed("v", "a"), "fp").join(firsts.select(F.col("fp").alias("other"), F.col("v").alias("b")), "other").where("a <> b")
    return plausible(same.unionByName(ties.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), prints)


def other_candidates(groups: tuple[DataFrame, DataFrame], prints: DataFrame, roots: DataFrame) -> DataFrame:
    """All likely pairs u > v of texts of the same or near fingerprints whose roots (u, root; others are their own) differ.

    A group of copies that is one already gives no pair, so work grows with
    what is not known to be alike.
    """
    members, near = groups
    rooted = cut(members.join(roots, "u", "left").select("fp", "u", F.coalesce("root", "u").alias("root")), "rooted")
    # only fingerprints with several roots have pairs to give, and only near ones of unlike roots
    spans = cut(rooted.groupBy("fp").agg(F.min("root").alias("low"), F.max("root").alias("high")), "spans")
    right = rooted.select(F.col("fp").alias("other"), F.col("u").alias("v"), F.col("root").alias("root_v"))
    mixed = spans.where("low <> high").select("fp", F.col("fp").alias("other"))
    wide = near.join(spans, "fp").join(spans.select(F.col("fp").alias("other"), F.col("low").alias("low_v"), F.col("high").alias("high_v")), "other")
    wide = wide.where("low <> high OR low_v <> high_v OR low <> low_v").select("fp", "other")
    pairs = mixed.unionByName(wide).join(rooted, "fp").join(right, "other").where("root <> root_v")
    return plausible(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), prints)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The pairs (u, v) whose texts' sets of shingles are at least `similarity` alike, by exact comparison."""

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingle_hashes(t.as_py(), shingle).view(np.int64) for t in part.column("text").cast(pa.binary())]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("u"), pa.ListArray.from_arrays(ends, np.concatenate(found))], ["u", "hashes"])

    held = cut(texts.select("u", "text").mapInArrow(hashes, "u long, hashes array<long>"), "shingles")
    both = pairs.join(held.select("u", F.col("hashes").alias("a")), "u").join(held.select(F.col("u").alias("v"), F.col("hashes").alias("b")), "v")
    # a set that is too small beside the other can't be alike
    both = both.where(F.least(F.size("a"), F.size("b")) >= similarity * F.greatest(F.size("a"), F.size("b")))
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("u", "v")


def similar_pairs(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, tables: int = TABLES) -> DataFrame:
    """Links u > v between texts (u long, unique; text) at least `similarity` alike on sets of shingles (Jaccard).

    Every pair of the same or near fingerprints of some table is settled by
    verified(); null texts and those without words take no part.
    """
    prints = cut(signed(texts.select("u", "text"), shingle, tables).where("prints IS NOT NULL"), "signatures")
    nothing = texts.limit(0).select("u", F.col("u").alias("root"))
    pairs = other_candidates(print_groups(prints), prints, nothing)
    wanted = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct()
    return verified(pairs, texts.join(wanted, "u", "left_semi"), shingle, similarity)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, tables: int = TABLES) -> DataFrame:
    """The documents without all but one of each group of near copies: the row with its least (doc_id, text).

    Equal texts, and texts whose sets of five-word shingles are at least
    `similarity` alike, are in one group; so are all texts without words, and
    null ones count among them. Of several rows with the same id and text one
    stays; a row with a null id stays only if its group has no other.

    Texts are first tied to one of the same or a near fingerprint; then all pairs
    of such texts are settled that those ties have not put in one group already.
    """
    # packed, so that no column of the documents can clash with ours; rows are named by their id and the digest of their text
    content = F.coalesce(F.col(quoted(text)), F.lit(""))
    at = F.struct(F.col(quoted(doc_id)).isNull().alias("last"), F.col(quoted(doc_id)).alias("doc_id"))
    packed = docs.select(at.alias("at"), F.sha2(content, 256).alias("sha"), content.alias("text"), F.struct("*").alias("row"))
    rows = cut(signed(packed.select("at", "sha", "text"), shingle, tables), "signatures")
    # one row for each text, under a number that is drawn once; texts without words are one
    names = rows.groupBy(F.when(F.col("prints").isNotNull(), F.col("sha")).alias("name")).agg(F.min(F.struct("at", "sha")).alias("first"), F.max("prints").alias("prints"))
    names = cut(names.select("first.at", "first.sha", "prints", F.monotonically_increasing_id().alias("u")), "texts")
    prints = names.where("prints IS NOT NULL").select("u", "prints")

    def settled(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct()
        chosen = cut(names.join(wanted, "u").select("at", "sha", "u"), "chosen")
        return cut(verified(pairs, packed.select("at", "sha", "text").join(chosen, ["at", "sha"]).dropDuplicates(["at", "sha"]), shingle, similarity), "links")

    groups = print_groups(prints)
    links = settled(first_candidates(groups, prints))
    stars = cut(components(links), "stars")
    more = settled(other_candidates(groups, prints, stars.select(F.col("node").alias("u"), "root")))
    stars = components(links.unionByName(more)).withColumnRenamed("node", "u")
    rooted = names.join(stars, "u", "left").select(F.struct("at", "sha").alias("first"), F.coalesce("root", "u").alias("root"))
    kept = cut(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.at", "first.sha"), "kept")
    return packed.join(kept, ["at", "sha"], "left_semi").dropDuplicates(["at", "sha"]).select("row.*")
