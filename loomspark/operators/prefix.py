"""Ranks and running sums over a whole table, without a window that sees all of it in one task.

Ranks: rows are dealt by ranges of the order and sorted in each, so a row's place is its place in its range plus the rows
of the ranges before; these offsets are made from one row a range. Running sums: rows are cut into blocks of
neighbouring ranks, the blocks' sums are added up (by the same means, if there are many), and a window runs inside each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.durable import checkpoint

#: Rows that one window runs over at most.
BLOCK = 10_000


def ranked(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """The rows with their place (long, from 1). The order must leave no ties, or these are numbered in no fixed order.

    The rows are dealt and sorted once and kept in a checkpoint, so that places and offsets come from the same ranges.
    """
    dealt = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + place + 1).drop("_id", "_part", "_before")


def running_sum(rows: DataFrame, rank: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """The rows with the sum of ``value`` up to and with their own; ``rank`` numbers them from 1 without gaps."""
    keyed = rows.withColumn("_block", F.floor((F.col(rank) - 1) / block))
    sums = keyed.groupBy("_block").agg(F.sum(value).alias("_sum"))
    last = rows.agg(F.max(rank)).first()[0] or 0
    if last <= block:
        before = sums.select("_block", F.lit(0).alias("_before"))
    elif last <= block * block:
        earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # ``block`` rows at most
        before = sums.select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    else:
        upper = running_sum(checkpoint(sums.select((F.col("_block") + 1).alias("_rank"), "_sum")), "_rank", "_sum", "_upto", block)
        before = upper.select((F.col("_rank") - 1).alias("_block"), (F.col("_upto") - F.col("_sum")).alias("_before"))
    own = Window.partitionBy("_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return keyed.join(before, "_block").withColumn(name, F.col("_before") + F.sum(value).over(own)).drop("_block", "_before")
