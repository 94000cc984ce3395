"""Change times of notes from git, or from the file system where git can't say."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.policy import Policy
from loomspark.sources import vault
from loomspark.sources.history import GIT_FAILED, SCHEMA, git, history


def revision(policy: Policy) -> tuple[str | None, bool | None]:
    """(HEAD, whether anything is uncommitted); None where git can't say."""
    root = str(policy.vault_root)
    head, state = git(root, "rev-parse", "HEAD"), git(root, "status", "--porcelain", "--", ".")
    return (head.strip() if head else None), (bool(state.strip()) if state is not None else None)


def by_mtime(spark: SparkSession, policy: Policy, since: datetime) -> DataFrame:
    times = vault.manifest(spark, policy).select("note_path", F.timestamp_micros(F.expr("mtime_ns div 1000")).alias("ts"))
    return times.filter(F.col("ts") >= F.lit(since))


def changes(spark: SparkSession, policy: Policy, since: datetime) -> tuple[DataFrame, DataFrame]:
    """(committed, uncommitted) as (note_path, ts), the first once a note; file times stand for both where git can't be used."""

    def kept(table: str) -> DataFrame:
        return history(spark, str(policy.vault_root), table, since).filter(policy.indexable(F.col("note_path")))

    try:
        commits = kept("commits").groupBy("note_path").agg(F.max("ts").alias("ts")).persist()
        commits.count()
        return commits, kept("worktree")
    except Exception as e:  # what a reader raises comes wrapped in several ways
        if GIT_FAILED not in str(e):
            raise
    return by_mtime(spark, policy, since), spark.createDataFrame([], SCHEMA)
