"""Put logs derived from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyrill.functions.keys import key_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, key, value, length: each event puts its type under its user."""
    value = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), key_of(F.col("user_id")).alias("key"), value.alias("value"), F.octet_length(value).cast("long").alias("length"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, key, value, length: each order puts its status under its customer."""
    value = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), key_of(F.col("o_custkey")).alias("key"), value.alias("value"), F.octet_length(value).cast("long").alias("length"))


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, key, value, length, source: texts under the hash of their content."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), key_of(text).alias("key"), text.alias("value"), F.octet_length(text).cast("long").alias("length"), "source")
