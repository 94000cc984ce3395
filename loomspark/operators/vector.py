"""The vector leg, pooled note vectors and note similarity.

Similarity of many origins with all notes is a blocked matrix product (``blocks``): the notes are never joined
with themselves, vectors stay off the driver but for a few origins, and the plan is the same for any number of them.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.scalar import cosine, norm
from loomspark.operators.blocks import top_products


def cosine_leg(chunks: DataFrame, query: list[float], limit: int) -> DataFrame:
    """chunks (chunk_id, vector) -> the ``limit`` best by cosine; nothing for a zero query."""
    if not any(query):
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    return chunks.select("chunk_id", cosine(F.col("vector"), q).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


def pooled_vectors(chunks: DataFrame) -> DataFrame:
    """chunks (note_path, vector) -> note_path, vector: the mean, normalised; zero means are left out."""
    mean = chunks.filter("vector is not null").groupBy("note_path").agg(Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>"))).alias("m"))
    flat = mean.select("note_path", vector_to_array("m").alias("v")).withColumn("n", norm(F.col("v")))
    return flat.filter("n > 0").select("note_path", F.transform("v", lambda x: x / F.col("n")).alias("vector"))


def similar_notes(pooled: DataFrame, origins: DataFrame, k: int, visible: DataFrame | None = None) -> DataFrame:
    """origins (note_path) -> note, other, score, rank: the k most similar visible notes of each. The gate comes first."""
    named = pooled.select(F.col("note_path").alias("name"), "vector")
    others = named if visible is None else named.join(visible.select(F.col("note_path").alias("name")), "name", "left_semi")
    own = named.join(origins.select(F.col("note_path").alias("name")), "name", "left_semi")
    return top_products(own, others, k, others=True).select(F.col("left").alias("note"), F.col("right").alias("other"), "score", "rank")


def _unit(v: Column) -> Column:
    v = v.cast("array<double>")
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def cosine_batch(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """chunks (chunk_id, vector), queries (query_id string, vector) -> query_id, chunk_id, score, rank: the ``limit`` best of each query; nothing for a zero query."""
    asked = queries.filter(F.exists("vector", lambda x: x != 0)).select(F.col("query_id").alias("name"), _unit(F.col("vector")).alias("vector"))
    held = chunks.filter("vector is not null").select(F.col("chunk_id").alias("name"), _unit(F.col("vector")).alias("vector"))
    return top_products(asked, held, limit).select(F.col("left").alias("query_id"), F.col("right").alias("chunk_id"), "score", "rank")
