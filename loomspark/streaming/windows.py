"""Structured Streaming: windowed activity with late data, and upkeep of lexical tables by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomspark.operators.lexical import doc_lengths, postings


def activity_windows(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """events (ts, event_type) -> start, event_type, n. Works on a stream and on a table; events later than ``late`` are dropped by a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return marked.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """events (ts, user_id) -> user_id, start, end, n."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def lexical_upkeep(chunks: DataFrame, sink: Callable[[str, DataFrame, int], None]) -> DataStreamWriter:
    """A stream of new chunks (chunk_id, text) to postings and lengths; ``sink`` gets (table, rows, batch id) and must be
    idempotent by batch id. Deletions don't come through a file stream: they need the snapshot diff of ``plans.index``."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        sink("postings", postings(rows), batch_id)
        sink("doc_len", doc_lengths(rows), batch_id)

    return chunks.writeStream.foreachBatch(batch)
