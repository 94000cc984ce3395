"""Fusion of ranked legs: reciprocal ranks (RRF) or min-max normalised sums (CombSUM).

A leg is (chunk_id, score) and has at most its limit of rows, so its window without partitions is bounded.
Legs are added in the order given, so equal inputs give equal sums.
"""

from __future__ import annotations

from enum import Enum
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalar import min_max, rrf


class Fusion(str, Enum):
    RRF = "rrf"
    SCORE = "score"


def ranked(leg: DataFrame) -> DataFrame:
    return leg.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def leg_weights(leg: DataFrame, mode: Fusion) -> DataFrame:
    """chunk_id, w: what a leg adds to a chunk."""
    if Fusion(mode) is Fusion.RRF:
        return ranked(leg).select("chunk_id", rrf(F.col("rank")).alias("w"))
    whole = Window.partitionBy()
    return leg.select("chunk_id", min_max(F.col("score"), F.min("score").over(whole), F.max("score").over(whole)).alias("w"))


def fuse(legs: list[DataFrame], mode: Fusion = Fusion.RRF) -> DataFrame:
    """chunk_id, score over the union of the legs; a chunk that a leg lacks gets 0 from it."""
    rows = reduce(DataFrame.unionByName, [leg_weights(leg, mode).withColumn("leg", F.lit(i)) for i, leg in enumerate(legs)])
    each = [F.coalesce(F.max(F.when(F.col("leg") == i, F.col("w"))), F.lit(0.0)) for i in range(len(legs))]
    return rows.groupBy("chunk_id").agg(reduce(lambda a, b: a + b, each).alias("score"))


def fuse_batch(legs: list[DataFrame], mode: Fusion = Fusion.RRF) -> DataFrame:
    """Legs (query_id, chunk_id, score, rank) -> query_id, chunk_id, score: ``fuse`` for each query."""
    own = Window.partitionBy("query_id")  # a leg's limit of rows
    weight = rrf(F.col("rank")) if Fusion(mode) is Fusion.RRF else min_max(F.col("score"), F.min("score").over(own), F.max("score").over(own))
    rows = reduce(DataFrame.unionByName, [leg.select("query_id", "chunk_id", weight.alias("w"), F.lit(i).alias("leg")) for i, leg in enumerate(legs)])
    each = [F.coalesce(F.max(F.when(F.col("leg") == i, F.col("w"))), F.lit(0.0)) for i in range(len(legs))]
    return rows.groupBy("query_id", "chunk_id").agg(reduce(lambda a, b: a + b, each).alias("score"))
