"""Incremental refresh as a diff of two snapshots: which notes are added, updated, touched, unchanged, removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(prior: DataFrame, walked: DataFrame) -> DataFrame:
    """prior, walked (note_path, mtime_ns, sha256) -> note_path, class.

    Equal times mean unchanged without a look at the content; another time with the same hash is ``touched``
    (its time is written, nothing else), and counts as unchanged in the report.
    """
    p = prior.select("note_path", F.col("mtime_ns").alias("m0"), F.col("sha256").alias("h0"))
    w = walked.select("note_path", F.col("mtime_ns").alias("m1"), F.col("sha256").alias("h1"))
    kind = F.when(F.col("m1").isNull(), "removed").when(F.col("m0").isNull(), "added").when(F.col("m0") == F.col("m1"), "unchanged").when(F.col("h0") == F.col("h1"), "touched").otherwise("updated")
    return p.join(w, "note_path", "full_outer").select("note_path", kind.alias("class"))


def report(classes: DataFrame) -> DataFrame:
    n = lambda *kinds: F.count_if(F.col("class").isin(*kinds))
    return classes.agg(n("added").alias("added"), n("updated").alias("updated"), n("removed").alias("removed"), n("unchanged", "touched").alias("unchanged"))


def replace_rows(old: DataFrame, new: DataFrame, gone: DataFrame, key: str = "note_path") -> DataFrame:
    """Copy on write: old rows without those of changed or removed keys, and the new ones."""
    return old.join(gone.select(key), key, "left_anti").unionByName(new)


def staleness(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """recorded, live (note_path, sha256) -> added, changed, deleted, stale, state. Times are not looked at."""
    a = recorded.select("note_path", F.col("sha256").alias("h0"))
    b = live.select("note_path", F.col("sha256").alias("h1"))
    n = a.join(b, "note_path", "full_outer").agg(F.count_if(F.col("h0").isNull()).alias("added"), F.count_if(F.col("h0") != F.col("h1")).alias("changed"), F.count_if(F.col("h1").isNull()).alias("deleted"))
    stale = F.col("added") + F.col("changed") + F.col("deleted")
    return n.select("added", "changed", "deleted", stale.alias("stale"), F.when(stale > 0, "stale").otherwise("ready").alias("state"))
