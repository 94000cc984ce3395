"""Recent activity: which visible notes changed in the last days, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalar import cutoff, iso

DEFAULT_DAYS, DEFAULT_LIMIT, MAX_LIMIT = 7, 20, 50  # fixed values


def latest_change(commits: DataFrame, worktree: DataFrame, since: Column) -> DataFrame:
    """commits, worktree (note_path, ts) -> note_path, ts: the latest in the window from either side."""
    both = commits.select("note_path", "ts").unionByName(worktree.select("note_path", "ts"))
    return both.filter(F.col("ts") >= since).groupBy("note_path").agg(F.max("ts").alias("ts"))


def recent_activity(changes: DataFrame, visible: DataFrame, now: Column, days: int = DEFAULT_DAYS, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """changes (note_path, ts) -> note_path, modified (ISO seconds), rank. The gate comes before the limit."""
    if days <= 0 or limit <= 0:
        return changes.select("note_path", F.lit("").alias("modified"), F.lit(0).alias("rank")).limit(0)
    own = changes.filter(F.col("ts") >= cutoff(now, days)).groupBy("note_path").agg(F.max("ts").alias("ts"))
    seen = own.join(visible.select("note_path"), "note_path", "left_semi").select("note_path", F.date_trunc("SECOND", "ts").alias("ts"))
    top = seen.orderBy(F.desc("ts"), "note_path").limit(min(limit, MAX_LIMIT))
    return top.select("note_path", iso(F.col("ts")).alias("modified"), F.row_number().over(Window.orderBy(F.desc("ts"), "note_path")).alias("rank"))
