"""Postings of a table of documents, built once and read by every search over it.

The index is written to the shared checkpoint folder and known by the table's files (names, sizes, times), so another table, or a
rewritten one, gets an index of its own. It holds no rows on the driver and needs none of the executors that wrote it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.blockmax import Postings, blocks_of
from loomspark.sources.durable import ensure_checkpoint_dir
from loomspark.sources.hadoop import Folder
from loomspark.sources.store import SORTED, TABLES, buckets_for

#: (application, files of the table) -> (folder, chunks, terms).
_BUILT: dict[tuple, tuple[str, int, int]] = {}


def postings_of(chunks: DataFrame, table: str) -> Postings:
    """chunks (chunk_id, text), made of the rows of one Parquet table -> their postings, from the index of that table."""
    spark = chunks.sparkSession
    files = Folder(spark, table).files("")
    key = (spark.sparkContext.applicationId, table, tuple(files))
    if key not in _BUILT:
        _BUILT[key] = _build(spark, chunks, buckets_for(4 * sum(size for _, size, *_ in files)))
    folder, n, terms = _BUILT[key]
    blocks = spark.read.schema(TABLES["postings"]).parquet(f"{folder}/postings")
    return Postings(blocks, n, terms / n if n else None)


def _build(spark: SparkSession, chunks: DataFrame, parts: int) -> tuple[str, int, int]:
    """Texts are dealt evenly to parts of a bounded size, whatever the partitions of the session: the only shuffle. A part is a bucket."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    dealt = chunks.select("chunk_id", "text").repartition(parts, "chunk_id").withColumn("bucket", F.spark_partition_id())
    columns = [c.split()[0] for c in TABLES["postings"].split(", ")]
    blocks_of(dealt).select(*columns).sortWithinPartitions(*SORTED["postings"]).write.parquet(f"{folder}/postings")
    blocks = spark.read.schema(TABLES["postings"]).parquet(f"{folder}/postings")
    terms = blocks.agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    return folder, chunks.count(), terms
