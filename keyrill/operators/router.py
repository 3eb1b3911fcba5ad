"""Routing of puts to a write-once (perm) and a mutable (dyna) layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyrill.functions.keys import COMPACT_AFTER, shard_of
from keyrill.operators.scan import BLOCK, part_of, running_total
from keyrill.operators.store import first, latest


def mixed_ops(log: DataFrame, width: int = BLOCK) -> DataFrame:
    """Add `action` to rows with op put, put_perm or put_dyna, in seq order.

    put_dyna always writes the mutable layer (DYNA_WRITE); put_perm writes the
    permanent one once (PERM_INSERT, later PERM_REJECTED); put inserts a new
    key (PERM_INSERT), does nothing where it repeats the visible value
    (NOOP_DYNA if the key has a mutable value, else NOOP_PERM), and writes the
    mutable layer otherwise. A null value is a value, a null key a key; a null
    op counts as put, and a null seq comes first.

    No state has to be carried row by row: a key's first row shows its value
    whatever its op, then every put and put_dyna shows its own, and put_perm
    shows nothing more. Rows are scanned in blocks of seq, and what a block
    needs of earlier blocks comes from one row per block: a hot key is split
    over its blocks.
    """
    inside = Window.partitionBy("__part").orderBy("seq")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    is_put, is_dyna, is_perm = (F.coalesce("op", F.lit("put")) == x for x in ("put", "put_dyna", "put_perm"))
    other = lambda a, b: ~a.eqNullSafe(b)
    # the key is read back from the part, so that both branches below take the same columns of one exchange
    rows = log.withColumn("__part", part_of(["key"], "seq", width)).drop("key")
    rows = rows.withColumn("__shown", F.last(F.when(~is_perm, F.struct("value")), ignorenulls=True).over(earlier))
    rows = rows.withColumn("__dyna", is_dyna | (is_put & F.col("__shown").isNotNull() & other(F.col("__shown.value"), F.col("value"))))

    row = F.struct("seq", is_put.alias("is_put"), "value")
    blocks = rows.groupBy("__part").agg(
        F.min(row).alias("__first"), F.min(F.when(~is_perm, row)).alias("__lead"), F.max(F.when(~is_perm, row)).alias("__last"),
        F.max("__dyna").alias("__any_dyna"), F.max(is_perm).alias("__any_perm"),
    )
    across = Window.partitionBy(F.col("__part.key")).orderBy(F.col("__part.__block"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__born", F.first("__first").over(across))
    blocks = blocks.withColumn("__carried", F.coalesce(F.last("__last", ignorenulls=True).over(before), "__born"))
    turned = F.coalesce(F.col("__lead.is_put") & ~F.col("__lead.seq").eqNullSafe(F.col("__born.seq")) & other(F.col("__lead.value"), F.col("__carried.value")), F.lit(False))
    blocks = blocks.withColumn("__turned", F.col("__any_dyna") | turned)
    blocks = blocks.select(
        "__part", F.col("__born.seq").alias("__born"), F.col("__born.is_put").alias("__born_put"), F.col("__carried.value").alias("__carried"),
        F.coalesce(F.max("__turned").over(before), F.lit(False)).alias("__old_dyna"), F.coalesce(F.max("__any_perm").over(before), F.lit(False)).alias("__old_perm"),
    )

    rows = rows.join(blocks, "__part")
    new = F.col("seq").eqNullSafe(F.col("__born"))
    seen = F.when(F.col("__shown").isNull(), F.col("__carried")).otherwise(F.col("__shown.value"))
    rows = rows.withColumn("__changed", is_dyna | (is_put & ~new & other(seen, F.col("value"))))
    has_dyna = F.col("__old_dyna") | F.coalesce(F.max("__changed").over(earlier), F.lit(False))
    has_perm = F.col("__old_perm") | (F.col("__born_put") & ~new) | F.coalesce(F.max(is_perm).over(earlier), F.lit(False))
    rows = rows.withColumn("__has_dyna", has_dyna).withColumn("__has_perm", has_perm)
    action = (
        F.when(is_perm, F.when(F.col("__has_perm"), "PERM_REJECTED").otherwise("PERM_INSERT"))
        .when(F.col("__changed"), "DYNA_WRITE").when(new, "PERM_INSERT").when(F.col("__has_dyna"), "NOOP_DYNA").otherwise("NOOP_PERM")
    )
    own = [F.col("__part.key").alias("key") if c == "key" else c for c in log.columns]
    return rows.withColumn("action", action).select(*own, "action")


def route(log: DataFrame, width: int = BLOCK) -> DataFrame:
    """Add `action` to plain puts: PERM_INSERT, DYNA_WRITE, NOOP_PERM or NOOP_DYNA."""
    return mixed_ops(log.withColumn("op", F.lit("put")), width).select(*log.columns, "action")


def layers(log: DataFrame) -> DataFrame:
    """key, has_perm, perm, perm_seq, has_dyna, dyna, seq: what both layers hold after all puts.

    One aggregation, which combines before the shuffle. The write-once layer
    holds a key's first put, if that was a plain one, else its first put_perm.
    The mutable layer holds something once a put_dyna came or a put changed the
    visible value; from then on its value is that of the last put or put_dyna,
    as those that change nothing repeat it. seq is that of the last row which
    shows. Null keys, values and ops as in mixed_ops().
    """
    op = F.coalesce("op", F.lit("put")) if "op" in log.columns else F.lit("put")
    rows = log.select("key", "seq", "value", op.alias("op"))
    row, shows = F.struct("seq", "op", "value"), F.col("op") != "put_perm"
    rows = rows.groupBy("key").agg(
        F.min(row).alias("__born"), F.min(F.when(~shows, row)).alias("__perm"), F.max(F.when(shows, row)).alias("__last"),
        F.min(F.when(shows, F.struct("value"))).alias("__low"), F.max(F.when(shows, F.struct("value"))).alias("__high"),
        F.max(F.col("op") == "put_dyna").alias("__forced"),
    )
    alike = lambda c: F.col(c).getField("value").eqNullSafe(F.col("__born.value"))
    plain = F.col("__born.op") == "put"
    held = F.when(plain, F.col("__born")).otherwise(F.col("__perm"))
    has_dyna = F.col("__last").isNotNull() & (F.col("__forced") | ~(alike("__low") & alike("__high")))
    rows = rows.select("key", held.alias("__perm"), "__last", has_dyna.alias("has_dyna"))
    return rows.select(
        "key", F.col("__perm").isNotNull().alias("has_perm"), F.col("__perm.value").alias("perm"), F.col("__perm.seq").alias("perm_seq"),
        "has_dyna", F.when(F.col("has_dyna"), F.col("__last.value")).alias("dyna"), F.coalesce("__last.seq", "__perm.seq").alias("seq"),
    )


def perm_layer(log: DataFrame) -> DataFrame:
    """key, value of the write-once layer."""
    if "op" not in log.columns:
        return first(log).select("key", "value")
    return layers(log).where("has_perm").select("key", F.col("perm").alias("value"))


def dyna_layer(log: DataFrame) -> DataFrame:
    """key, value of the mutable layer."""
    return layers(log).where("has_dyna").select("key", F.col("dyna").alias("value"))


def get(log: DataFrame) -> DataFrame:
    """key, value, seq: the mutable layer first, else the permanent one."""
    return layers(log).select("key", F.when(F.col("has_dyna"), F.col("dyna")).otherwise(F.col("perm")).alias("value"), "seq")


def shadowed(log: DataFrame) -> DataFrame:
    """Keys that both layers hold, with both values."""
    return layers(log).where("has_perm AND has_dyna").select("key", F.col("perm").alias("perm_value"), F.col("dyna").alias("dyna_value"))


def write_counters(routed: DataFrame) -> DataFrame:
    """shard, dwrites, pwrites, noops."""
    n = lambda *names: F.sum(F.when(F.col("action").isin(*names), 1).otherwise(0)).cast("long")
    return routed.groupBy(shard_of(F.col("key")).alias("shard")).agg(n("DYNA_WRITE").alias("dwrites"), n("PERM_INSERT").alias("pwrites"), n("NOOP_DYNA", "NOOP_PERM").alias("noops"))


def compaction_epochs(routed: DataFrame, threshold: int = COMPACT_AFTER) -> DataFrame:
    """shard, epoch, writes: mutable writes between compactions, one after each threshold + 1."""
    writes = routed.where(F.col("action") == "DYNA_WRITE").select("seq", shard_of(F.col("key")).alias("shard"))
    rows = running_total(writes, ["shard"], "seq", F.lit(1), "__n")
    return rows.groupBy("shard", F.floor(F.col("__n") / F.lit(threshold + 1)).cast("long").alias("epoch")).agg(F.count("*").alias("writes"))


class Layers:
    """One key's two layers, put by put, as a stream holds them; values are compared as they are."""

    def __init__(self, perm: tuple | None = None, dyna: tuple | None = None):
        self.perm, self.dyna = perm, dyna

    def apply(self, op: str, value) -> str:
        if op == "put_dyna":
            self.dyna = (value,)
            return "DYNA_WRITE"
        if op == "put_perm":
            if self.perm is not None:
                return "PERM_REJECTED"
            self.perm = (value,)
            return "PERM_INSERT"
        seen = self.dyna or self.perm
        if seen == (value,):
            return "NOOP_DYNA" if self.dyna else "NOOP_PERM"
        if seen:
            self.dyna = (value,)
            return "DYNA_WRITE"
        self.perm = (value,)
        return "PERM_INSERT"


def state(log: DataFrame) -> DataFrame:
    """key, value, first_seq, last_seq of the current state."""
    return first(log).select("key", F.col("seq").alias("first_seq")).join(latest(log).withColumnRenamed("seq", "last_seq"), "key")
