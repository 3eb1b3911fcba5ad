"""Snapshot views: a view is an upper bound on seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quarter_views(log: DataFrame, parts: int = 4) -> list[Column]:
    """The seq bounds of views made at 1/parts, 2/parts ... of the log."""
    top = log.agg(F.max("seq")).scalar()
    return [F.floor(top * F.lit(i) / F.lit(parts)).cast("long") for i in range(1, parts)]


def snapshots(log: DataFrame, bounds: list[Column]) -> DataFrame:
    """view_id (from 1), key, value: each view's state.

    bounds: ascending seq bounds, a handful. Rows are reduced to one per key
    and interval between views before they are spread to the later views.
    """
    n = len(bounds)
    interval = F.coalesce(*[F.when(F.col("seq") <= b, F.lit(i + 1)) for i, b in enumerate(bounds)])
    rows = log.select("key", F.struct("seq", "value").alias("__put"), interval.alias("__from")).where(F.col("__from").isNotNull())
    rows = rows.groupBy("key", "__from").agg(F.max("__put").alias("__put"))
    rows = rows.select("key", "__put", F.explode(F.sequence("__from", F.lit(n))).alias("view_id"))
    return rows.groupBy("view_id", "key").agg(F.max("__put").alias("__put")).select("view_id", "key", F.col("__put.value").alias("value"))


def against_current(views: DataFrame, current: DataFrame) -> DataFrame:
    """view_id, key, changed: whether the key's value is another one now."""
    now = current.select("key", F.col("value").alias("__now"))
    return views.join(now, "key").select("view_id", "key", (~F.col("value").eqNullSafe(F.col("__now"))).alias("changed"))


def write_attribution(log: DataFrame, bounds: list[Column]) -> DataFrame:
    """view_id, writes: puts that the newest view of their time buffers; 0 before any view."""
    owner = F.coalesce(*[F.when(F.col("seq") > b, F.lit(i + 1)) for i, b in reversed(list(enumerate(bounds)))], F.lit(0))
    return log.groupBy(owner.alias("view_id")).agg(F.count("*").alias("writes"))


def expiry(accesses: DataFrame, handle: str, ts: str, timeout_s: int) -> DataFrame:
    """Lives of view handles: a handle idle for longer than the timeout expires.

    Returns handle, session (from 0), start, end, accesses. Accesses within
    one stretch of the timeout's length are never idle between them, so each
    handle's stretches are first reduced to a row each, before the shuffle;
    only those rows are put in order. Accesses without a time belong to
    session 0.
    """
    timeout = timeout_s * 1_000_000
    stretch = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(max(1, timeout)))
    rows = accesses.groupBy(handle, stretch.alias("__stretch")).agg(F.min(ts).alias("__start"), F.max(ts).alias("__end"), F.count("*").alias("__n"))
    w = Window.partitionBy(handle).orderBy("__stretch")
    idle = F.timestamp_diff("MICROSECOND", F.lag("__end").over(w), F.col("__start")) > F.lit(timeout)
    rows = rows.withColumn("__new", F.coalesce(idle.cast("long"), F.lit(0)))
    rows = rows.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(handle, "session").agg(F.min("__start").alias("start"), F.max("__end").alias("end"), F.sum("__n").alias("accesses"))


def validity(accesses: DataFrame, handle: str, ts: str, timeout_s: int, closes: DataFrame | None = None) -> DataFrame:
    """Add `valid` and `expires` to the accesses of view handles.

    A handle expires `expires`, the timeout after the last access that found it
    valid; from then on all accesses to it are invalid, for good. closes
    (handle, closed_at): handles that were closed; later accesses are invalid
    too. An access without a time is invalid. Each handle's life is found from
    a row for each stretch of the timeout's length, as in expiry().
    """
    first = expiry(accesses.where(F.col(ts).isNotNull()), handle, ts, timeout_s).where("session = 0")
    life = first.select(F.struct(F.col(handle).alias("h")).alias("__handle"), F.timestamp_add("SECOND", F.lit(timeout_s), F.col("end")).alias("__expires"))
    rows = accesses.withColumn("__handle", F.struct(F.col(handle).alias("h"))).join(life, "__handle", "left")
    if closes is not None:
        shut = closes.groupBy(F.struct(F.col(handle).alias("h")).alias("__handle")).agg(F.min("closed_at").alias("__closed"))
        rows = rows.join(shut, "__handle", "left").withColumn("__expires", F.least("__expires", "__closed")).drop("__closed")
    valid = F.coalesce(F.col(ts) <= F.col("__expires"), F.lit(False))
    return rows.withColumn("valid", valid).withColumn("expires", F.col("__expires")).drop("__handle", "__expires")


def active(accesses: DataFrame, handle: str, ts: str, timeout_s: int, at: Column, closes: DataFrame | None = None) -> DataFrame:
    """handle, active: whether a handle accessed by then is still alive at a time."""
    rows = validity(accesses.where(F.col(ts) <= at), handle, ts, timeout_s, closes)
    return rows.groupBy(handle).agg(F.coalesce(F.max("expires") >= at, F.lit(False)).alias("active"))
