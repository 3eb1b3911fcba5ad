"""Lines that spread over many sites, and documents without them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from keyrill.llm.shared import columns, cut, map_rows, quoted

#: Boilerplate lines whose hashes may go to every task: 16 bytes each, so some 100 MB in a worker at most.
BROADCAST_LINES = 500_000


def _is_candidate(line: Column, min_chars: int) -> Column:
    return F.length(F.trim(line)) >= min_chars


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    rows = docs.select("doc_id", "site", F.explode(F.split("text", "\n")).alias("line"))
    return rows.where(_is_candidate(F.col("line"), min_chars)).select("doc_id", "site", _line_hash(F.col("line")).alias("hash"))


def spread_lines(docs: DataFrame, min_sites: int = 8, min_chars: int = 20, lg_k: int = 12, band: float = 0.25) -> DataFrame:
    """hash, keeper of lines on at least min_sites sites; docs: doc_id, site, text.

    A sketch per line estimates its distinct sites; sketches merge before and
    after the shuffle, so a line that is everywhere costs no more than others.
    Estimates within `band` of the threshold are settled by exact counts. A
    line of at least min_chars characters, ends trimmed, counts; null sites
    don't. keeper is the least doc_id that has the line.
    """
    rows = _lines(docs, min_chars)
    sketched = rows.groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("keeper"), F.count("*").alias("n"))
    counted = sketched.where(F.col("n") >= min_sites).select("hash", "keeper", F.hll_sketch_estimate("sketch").alias("sites"))
    counted = cut(counted.where(F.col("sites") >= min_sites * (1 - band)), "line-sites")
    sure = counted.where(F.col("sites") > min_sites * (1 + band)).select("hash", "keeper")
    close = counted.where(F.col("sites") <= min_sites * (1 + band)).select("hash", "keeper")
    exact = rows.join(close, "hash").groupBy("hash", "keeper").agg(F.countDistinct("site").alias("sites"))
    return cut(sure.unionByName(exact.where(F.col("sites") >= min_sites).select("hash", "keeper")), "spread-lines")


def remove_lines(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id", broadcast_lines: int = BROADCAST_LINES, **how) -> DataFrame:
    """The documents' own columns, with text less its boilerplate, and n_removed, which replaces a column of that name.

    A boilerplate line stays in the document with the least doc_id that has it
    (in all rows with that id) and goes everywhere else; other lines stay as
    they are. Null texts stay null with 0 removed. Up to broadcast_lines hashes
    go to every task; beyond that, documents are joined with the boilerplate
    lines they hold, by the digest of their text.
    """
    lines = spread_lines(columns(docs, doc_id=doc_id, site=site, text=text), **how)
    min_chars = how.get("min_chars", 20)
    few = lines.limit(broadcast_lines + 1).collect()
    if len(few) <= broadcast_lines:
        return _remove_by_table(docs, {r["hash"]: r["keeper"] for r in few}, doc_id, text, min_chars)
    return _remove_by_join(docs, lines, doc_id, text, min_chars)


def _own(docs: DataFrame) -> list[str]:
    return [quoted(c) for c in docs.columns if c.lower() != "n_removed"]


def _remove_by_table(docs: DataFrame, table: dict[int, int], doc_id: str, text: str, min_chars: int) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    def strip(own, whole: str) -> tuple[str, int]:
        keep, n, lines = [], 0, whole.split("\n")
        for line in lines:
            bare = line.strip(" ")
            if len(bare) >= min_chars:
                h = xxhash.xxh64_intdigest(bare.encode(), 42)
                h -= (h >> 63) << 64
                if h in shipped.value and (keeper := shipped.value[h]) is not None and keeper != own:
                    n += 1
                    continue
            keep.append(line)
        return "\n".join(keep) if n else whole, n

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [(None, 0) if t is None else strip(own, t) for own, t in zip(batch.column(doc_id).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            arrays = [pa.array([t for t, _ in found], pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([n for _, n in found], pa.int64())], names=[*batch.schema.names, "n_removed"])

    kept = docs.select(*_own(docs))
    return map_rows(kept, each, [StructField("n_removed", LongType())])


def _remove_by_join(docs: DataFrame, lines: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    # packed, so that no column of the documents can clash with ours
    rows = docs.select(docs[quoted(doc_id)].alias("own"), docs[quoted(text)].alias("text"), F.md5(docs[quoted(text)]).alias("md5"), F.struct(*_own(docs)).alias("row"))
    held = rows.select("md5", F.explode(F.split("text", "\n")).alias("line")).where(_is_candidate(F.col("line"), min_chars))
    held = held.select("md5", _line_hash(F.col("line")).alias("hash")).join(lines.where("keeper IS NOT NULL"), "hash")
    held = held.distinct().groupBy("md5").agg(F.map_from_entries(F.collect_list(F.struct("hash", "keeper"))).alias("held"))
    rows = rows.join(held, "md5", "left")

    def stays(line: Column) -> Column:
        keeper = F.try_element_at(F.col("held"), _line_hash(line))
        return ~_is_candidate(line, min_chars) | keeper.isNull() | keeper.eqNullSafe(F.col("own"))

    whole = F.split("text", "\n")
    rows = rows.withColumn("kept", F.when(F.col("held").isNull(), whole).otherwise(F.filter(whole, stays)))
    removed = F.when(F.col("text").isNull(), 0).otherwise(F.size(whole) - F.size("kept")).cast("long")
    return rows.select(F.col("row").withField(quoted(text), F.array_join("kept", "\n")).alias("row"), removed.alias("n_removed")).select("row.*", "n_removed")
