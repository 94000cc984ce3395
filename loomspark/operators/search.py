"""Hybrid search: two legs, fusion, and the gate after the pool is cut.

The order matters. Each leg is cut to its limit before visibility is looked at, so that hidden notes take
their places in the pool and what comes back tells nothing about them; a result may be short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.blockmax import Postings
from loomspark.operators.fusion import Fusion, fuse
from loomspark.operators.vector import cosine_leg

DEFAULT_K, MAX_RESULTS, OVERFETCH = 8, 25, 4  # fixed values


def clamp(k: int) -> int:
    return max(0, min(k, MAX_RESULTS))


def search(chunks: DataFrame, postings: Postings, query: str, vector: list[float], visible: DataFrame, k: int = DEFAULT_K, mode: Fusion = Fusion.RRF) -> DataFrame:
    """chunks (chunk_id, note_path, heading, text, vector), visible (note_path) -> chunk_id, note_path, heading, score, snippet, rank."""
    k = clamp(k)
    limit = k * OVERFETCH
    legs = [cosine_leg(chunks, vector, limit), postings.leg(query, limit)]
    pool = fuse(legs, mode)  # at most two limits of rows
    hits = chunks.select("chunk_id", "note_path", "heading", F.col("text").alias("snippet")).join(F.broadcast(pool), "chunk_id")
    seen = hits.join(visible.select("note_path"), "note_path", "left_semi")
    order = Window.orderBy(F.desc("score"), "chunk_id")
    return seen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("chunk_id", "note_path", "heading", "score", "snippet", "rank")


def note_results(hits: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """hits (note_path, score, snippet, rank) -> the first hit of each note, in order, k at most."""
    first = Window.partitionBy("note_path").orderBy("rank")
    best = hits.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return best.withColumn("position", F.row_number().over(Window.orderBy("rank"))).filter(F.col("position") <= clamp(k)).select("note_path", "score", "snippet", "position")
