"""Prefix scans in blocks of seq, so that no key or file has to fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers in a block: the most rows of one group that a task sorts.
BLOCK = 1 << 20


def block_of(seq: str, width: int = BLOCK) -> Column:
    return F.floor(F.col(seq) / F.lit(width))


def part_of(by: list[str], seq: str, width: int = BLOCK) -> Column:
    """A group's block as one struct, which equals itself where a field is null; so no row is lost in a join on it."""
    return F.struct(*by, block_of(seq, width).alias("__block"))


def group_in(part: str, by: list[str]) -> list[Column]:
    """The group's own columns in part_of()."""
    return [F.col(part).getField(c) for c in by]


def running_total(df: DataFrame, by: list[str], seq: str, amount: Column, out: str, width: int = BLOCK, total: str | None = None, share: list[str] | None = None) -> DataFrame:
    """Add `out`: the sum of `amount` over the group's rows with smaller seq.

    Sums inside blocks of `width` sequence numbers and sums of whole blocks are
    scanned apart, then added; a hot group is split over its blocks. `total`
    names a further column for the sum over the whole group. Rows with a null
    group are a group; rows with a null seq come before the others, in no fixed
    order; a null amount counts as 0. Numbers far apart, such as times, want a
    `width` that holds some million rows: blocks with a row each gain nothing.

    share: the other columns that are read later. Both scans then take the same
    columns, so that rows are read and exchanged once and not twice.
    """
    rows = df.withColumn("__amount", F.coalesce(amount.cast("long"), F.lit(0))).withColumn("__part", part_of(by, seq, width)).drop(*by)
    before = Window.partitionBy("__part").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    if share is None:
        blocks = rows.groupBy("__part").agg(F.sum("__amount").alias("__sum"))
    else:
        # a hash that is looked at keeps the columns
        rows = rows.repartition("__part")
        held = rows.groupBy("__part").agg(F.sum("__amount").alias("__sum"), F.bit_xor(F.xxhash64(seq, *share)).alias("__seen"))
        blocks = held.select("__part", F.when(F.col("__seen").isNotNull(), F.col("__sum")).alias("__sum"))
    across = Window.partitionBy(*group_in("__part", by))
    earlier = across.orderBy(F.col("__part.__block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("__sum").over(across).alias(total)] if total else []
    blocks = blocks.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"), *whole)
    rows = rows.withColumn("__inner", F.coalesce(F.sum("__amount").over(before), F.lit(0))).join(blocks, "__part")
    own = [F.col(f"__part.`{c}`").alias(c) if c in by else F.col(f"`{c}`") for c in df.columns]
    return rows.select(*own, (F.col("__base") + F.col("__inner")).alias(out), *([total] if total else []))
