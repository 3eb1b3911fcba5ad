"""A training corpus from documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keyrill.llm import decontaminate, lines, pieces, quality, simhash
from keyrill.llm.shared import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that go to a Python worker at once, at most; whole texts are in them, and each side holds a copy.
ROWS_AT_ONCE = 1000


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in batches of ROWS_AT_ONCE rows; the session keeps that, as the stage's rows are read after it returns."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        size = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(size))
        # zero or less is no limit
        spark.conf.set(size, str(min(now, ROWS_AT_ONCE) if now > 0 else ROWS_AT_ONCE))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.classify(docs).where("accepted").select(COLUMNS)


@in_small_batches
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the boilerplate lines that many sources share."""
    return lines.remove_lines(docs).select(COLUMNS)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, alike to 0.8 or more on five-word shingles, the document with the least id stays."""
    return simhash.one_of_each(docs).select(COLUMNS)


@in_small_batches
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the text that they decode to."""
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding and decoding", encode),
]

#: The quality classifier's model is fitted by iteration, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
