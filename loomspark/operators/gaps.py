"""Gaps: pairs of notes that are similar and not linked, ranked; and dismissals of such pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.scalar import pair_signature, round4, top_folder
from loomspark.operators.graph import undirected
from loomspark.operators.prefix import ranked

THRESHOLD, MAX_SCORE, K, HUB_DEGREE = 0.6, 0.92, 8, 40  # fixed values


def gap_candidates(similar: DataFrame, e: DataFrame, threshold: float = THRESHOLD, max_score: float = MAX_SCORE) -> DataFrame:
    """similar (note, other, score), already cut to each note's top k -> unlinked pairs inside the band (both ends count)."""
    own = similar.filter((F.col("note") != F.col("other")) & F.col("score").between(threshold, max_score))
    und = undirected(e)
    keyed = own.withColumn("u", F.least("note", "other")).withColumn("v", F.greatest("note", "other"))
    return keyed.join(und, ["u", "v"], "left_anti").select("note", "other", "score")


def rank_pairs(similar: DataFrame, e: DataFrame, degree: DataFrame, dismissed: DataFrame | None = None, threshold: float = THRESHOLD, max_score: float = MAX_SCORE, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """Each unordered pair once, with its higher score and that direction (sorted where both are equal) -> a, b, score, rank.

    Order: pairs without a hub, then across folders, then by unrounded score, then by name.
    """
    own = gap_candidates(similar, e, threshold, max_score).withColumn("sig", pair_signature(F.col("note"), F.col("other")))
    if dismissed is not None:
        own = own.join(dismissed.select("sig"), "sig", "left_anti")
    keyed = own.groupBy(F.least("note", "other").alias("u"), F.greatest("note", "other").alias("v")).agg(F.max("score").alias("score"), F.max_by("note", F.struct("score", F.when(F.col("note") < F.col("other"), 1).otherwise(0))).alias("a"))
    pairs = keyed.select("a", F.when(F.col("a") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("b"), "score")
    hub = degree.filter(F.col("degree") >= hub_degree).select(F.col("node"))
    pairs = pairs.join(hub.select(F.col("node").alias("a"), F.lit(True).alias("ha")), "a", "left").join(hub.select(F.col("node").alias("b"), F.lit(True).alias("hb")), "b", "left")
    keys = pairs.select("a", "b", "score", F.coalesce("ha", "hb", F.lit(False)).alias("hubby"), (top_folder(F.col("a")) == top_folder(F.col("b"))).alias("same"))
    placed = ranked(keys, ["hubby", "same", F.desc("score"), "a", "b"])
    return placed.select("a", "b", round4("score").alias("score"), "rank")


def active_dismissals(records: DataFrame, hashes: DataFrame) -> DataFrame:
    """records (a, a_hash, b, b_hash), hashes (note_path, sha1) of visible notes -> sig of pairs whose notes are both unchanged."""
    good = records.dropna(subset=["a", "a_hash", "b", "b_hash"]).filter("a <> '' and b <> '' and a_hash <> '' and b_hash <> ''")
    x = hashes.select(F.col("note_path").alias("a"), F.col("sha1").alias("a_hash"))
    y = hashes.select(F.col("note_path").alias("b"), F.col("sha1").alias("b_hash"))
    return good.join(x, ["a", "a_hash"], "left_semi").join(y, ["b", "b_hash"], "left_semi").select(pair_signature(F.col("a"), F.col("b")).alias("sig")).distinct()
