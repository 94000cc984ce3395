"""A corpus pipeline: five stages, each one operator of loomspark.llm, each reading what the last one kept.

Stages take (spark, docs, sf_dir) and return the rows of ``docs`` that stay, with their columns; the last
returns each document's token ids. ``run`` writes every stage's result as Parquet in the shared checkpoint
folder and reads it again, so a later stage never repeats an earlier one, whatever is lost. A stage's folder is
deleted when the next one is written; the last one is the result's.

No stage keeps only part of what it is given to spare work.

Defined cases: an empty ``documents`` table gives an empty result; null and empty texts, and texts without a letter,
go at language_id; very long texts are judged and encoded whole; of rows that repeat a doc_id one stays at ngram_join
(its group's least id), and rows with a null doc_id are judged one by one there and stay, as they do elsewhere unless
they are toxic or contaminated; without labelled rows nothing is toxic, and without any ``lang`` everything goes at
language_id; extra columns, of any name, are carried to the last stage; ties follow the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import decontam, langid, ngramjoin, spiece, toxicity
from loomspark.llm.common import ensure_checkpoint_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model learns from the labelled rows of this stage's input."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language scores below 0.5, go."""
    return langid.drop_unidentified(docs, langid.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard >= 0.8 of five-word shingles the document with the least id stays."""
    return ngramjoin.one_of_each_group(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (0.8 or more of its five-word shingles) go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return spiece.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Trained models and Viterbi have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    places = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(places[k])
        docs = spark.read.parquet(places[k])
        if k:
            delete(spark, places[k - 1])
    return docs


def delete(spark: SparkSession, folder: str) -> None:
    """A folder of any file system that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
