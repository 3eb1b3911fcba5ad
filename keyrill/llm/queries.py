"""The queries opN_<name> over whole tables, and the SQL that some are held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyrill.llm import decontaminate, extract, language_model, lines, passages, pieces, quality, simhash, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Five hex digits are four base32 digits.
WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS lead FROM p GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM p JOIN f USING (hex)
"""


@query(WARC_SQL)
def op1_warc(spark, sf_dir):
    """Writes the pages to archives and reads those back."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode_decode returns."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op3_sentencepiece(spark, sf_dir):
    return digests(pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
k AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT u, w AS reached FROM k UNION SELECT r.u, k.w FROM r JOIN k ON r.reached = k.u),
c AS (SELECT u, min(reached) AS low FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM k GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.u LEFT JOIN c ON vec_id = c.u
"""


@query(VECTOR_SQL)
def op4_embedding_near_dedup(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op5_language_model(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@query()
def op6_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op7_html_extraction(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages"))


@query()
def op8_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents")).select("doc_id", "quality", "accepted")


LINE_SQL = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
b AS (SELECT trim(line, ' ') AS bare, min(doc_id) AS keeper FROM l WHERE length(trim(line, ' ')) >= 20 GROUP BY 1 HAVING count(DISTINCT source) >= 8),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id) AS text, count(*) FILTER (keeper <> doc_id) AS n_removed FROM l LEFT JOIN b ON trim(line, ' ') = bare GROUP BY doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_removed FROM k
"""


@query(LINE_SQL)
def op9_line_dedup(spark, sf_dir):
    return lines.remove_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


@query()
def op10_substring_dedup(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))
