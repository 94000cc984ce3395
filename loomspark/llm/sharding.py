"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. LPT takes groups by falling size and gives
each to the least-loaded shard, found through a heap. Groups of one size are interchangeable, so the
driver schedules *size classes* (size, number of groups), never groups: a class is split into runs
``(class, first rank, last rank, shard)`` and every group finds its shard from its rank in its class.
Sizes keep ``precision`` significant bits, so there are at most ``2**precision * 64`` classes whatever
the input; at the default 12 bits a class is exact up to 4,095 bytes and within 1/4,096 above that.

Ranks and slots come from two-level counting (a salted sub-bucket, then its offset), so neither a
class nor a shard is ever sorted as a whole in one task.

Defined cases: a null text has size 8 (no bytes) and a null CRC, and null texts are one group; an
empty text is a group like any other; repeated rows are kept and get slots of their own; an empty
table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

CLASS_BITS = 12
SUB_BUCKETS = 1024


def schedule(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """LPT over (size, count) classes: runs (size, first rank, last rank, shard), ranks from 0.

    A class of many equal groups takes O(shards) heap steps: once the loads lie within one size of
    each other the rest goes round robin, which is what one-by-one LPT would do.
    """
    heap = [(0, s) for s in range(shards)]
    runs: list[tuple[int, int, int, int]] = []
    for size, count in sorted(classes, reverse=True):
        rank = 0
        while rank < count:
            left = count - rank
            if left > shards and heap[0][0] + size > max(heap)[0]:
                each = left // shards
                for load, s in sorted(heap):
                    runs.append((size, rank, rank + each - 1, s))
                    rank += each
                heap = [(load + each * size, s) for load, s in heap]
                heapq.heapify(heap)
                continue
            load, s = heapq.heappop(heap)
            ahead = heap[0][0] if heap else load + left * size
            take = min(left, max(1, -(-(ahead - load) // size)))
            runs.append((size, rank, rank + take - 1, s))
            rank += take
            heapq.heappush(heap, (load + take * size, s))
    return runs


def _ranked(df: DataFrame, key: str, order: list[str], out: str, sub_buckets: int) -> DataFrame:
    """Gapless rank from 0 within ``key``, without sorting a key in one task."""
    df = df.withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(sub_buckets)).cast("int"))
    counts = df.groupBy(key, "_sub").count()
    offsets = counts.select(key, "_sub", (F.sum("count").over(Window.partitionBy(key).orderBy("_sub")) - F.col("count")).alias("_offset"))
    inner = Window.partitionBy(key, "_sub").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(inner)).join(offsets, [key, "_sub"]).withColumn(out, F.col("_offset") + F.col("_rn") - 1).drop("_sub", "_rn", "_offset")


def shard(docs: DataFrame, shards: int = 24, class_bits: int = CLASS_BITS, sub_buckets: int = SUB_BUCKETS) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with size, text_crc32, shard and slot."""
    raw = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"")).alias("group"),
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    # the lowest bits beyond class_bits significant ones are dropped
    step = f"shiftleft(1L, greatest(cast(ceil(log2(bytes + 1)) as int) - {class_bits}, 0))"
    groups = checkpoint(groups.select("group", F.expr(f"bytes - pmod(bytes, {step})").alias("class")))
    classes = groups.groupBy("class").count().collect()  # bounded by 2**class_bits * 64
    runs = schedule([(r["class"], r["count"]) for r in classes], shards)
    spark = docs.sparkSession
    table = spark.createDataFrame(runs, "class long, first long, last long, shard int").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("first", "last", "shard"))).alias("runs"))
    ranked = _ranked(groups, "class", ["group"], "rank", sub_buckets)
    placed = ranked.join(F.broadcast(table), "class").select(  # a row for each class: bounded as above
        "group", F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") <= r["last"])), 1)["shard"].alias("shard")
    )
    out = rows.join(placed, "group")
    out = _ranked(out.select("doc_id", "size", "text_crc32", "shard", F.xxhash64("group").alias("g")), "shard", ["g", "doc_id"], "slot", sub_buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
