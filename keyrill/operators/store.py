"""Current state, write-once state and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyrill.functions.keys import NIL_KEY
from keyrill.operators.scan import BLOCK, part_of


def latest(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each key's last put: key, value, seq (and length if the log has it).

    One shuffle; partial maxima before it keep a hot key's rows apart.
    """
    by, rest = by or ["key"], [c for c in ("value", "length") if c in log.columns]
    top = log.groupBy(*by).agg(F.max(F.struct("seq", *rest)).alias("__top"))
    return top.select(*by, *[F.col(f"__top.{c}").alias(c) for c in (*rest, "seq")])


def first(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each key's first put: key, value, seq (and length)."""
    by, rest = by or ["key"], [c for c in ("value", "length") if c in log.columns]
    top = log.groupBy(*by).agg(F.min(F.struct("seq", *rest)).alias("__top"))
    return top.select(*by, *[F.col(f"__top.{c}").alias(c) for c in (*rest, "seq")])


def accepted_keys(log: DataFrame) -> DataFrame:
    """The log without puts of the nil key or a null one, which no store holds."""
    return log.where(F.col("key") != F.lit(NIL_KEY))


def multi_get(probe: DataFrame, state: DataFrame) -> DataFrame:
    """probe (probe_id, key) -> probe_id, key, found, value; absent keys stay."""
    held = state.select("key", "value", F.lit(True).alias("__held"))
    rows = probe.join(held, "key", "left")
    return rows.select("probe_id", "key", F.coalesce("__held", F.lit(False)).alias("found"), "value")


def immutable_outcome(log: DataFrame, width: int = BLOCK) -> DataFrame:
    """seq, key, outcome and kv_outcome of puts into a write-once store.

    outcome: inserted, noop (the first value again) or rejected. kv_outcome
    is that of a value store, where each repeat has a new pointer and is
    rejected. The first put meets the others in blocks of seq, so a hot key
    is split over its blocks. A null key is a key; a null seq comes first.
    """
    rows = log.select("seq", "key", "value", part_of(["key"], "seq", width).alias("__part"))
    firsts = rows.groupBy("__part").agg(F.min(F.struct("seq", "value")).alias("__first"))
    firsts = firsts.withColumn("__first", F.min("__first").over(Window.partitionBy(F.col("__part.key"))))
    rows = rows.join(firsts.select("__part", F.col("__first.value").alias("__value"), F.col("__first.seq").alias("__seq")), "__part")
    new = F.col("seq").eqNullSafe(F.col("__seq"))
    return rows.select(
        "seq", "key",
        F.when(new, "inserted").when(F.col("value").eqNullSafe(F.col("__value")), "noop").otherwise("rejected").alias("outcome"),
        F.when(new, "inserted").otherwise("rejected").alias("kv_outcome"),
    )
