"""Postings in blocks with bounds, and BM25 search that skips blocks which can't hold one of the best chunks.

Chunks are dealt into spans of ``SPAN`` neighbours by size (bounds are tight when the lengths of a span are alike). A block holds a
term's postings of one span, with its greatest tf and least length: whatever the corpus' statistics are by now, no posting of
the block scores more than those two give. So a block stays valid when other buckets of the index change.

A search reads the blocks' heads for its terms, adds up the bounds of each span over the terms, scores the most promising
spans, and then, exactly, all spans whose bound reaches the k-th score found; the others are skipped. All of it is one
lazy plan: the k-th score is a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.scalar import bm25_idf, bm25_term
from loomspark.functions.text import tokenize
from loomspark.operators.lexical import query_terms

SPAN = 128
#: Bounds are compared with this much room, since sums of doubles round.
ROOM = 1 - 1e-9


def lengths(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, text, bucket) -> chunk_id, bucket, len."""
    return chunks.select("chunk_id", "bucket", F.size(tokenize(F.coalesce("text", F.lit("")))).cast("long").alias("len"))


def block_postings(chunks: DataFrame, span: int = SPAN) -> DataFrame:
    """chunks (chunk_id, text, bucket; a bucket's chunks are few enough for one task) -> bucket, term, span, n, max_tf, min_len, chunk_ids, tfs, lens."""
    return blocks_of(chunks.select("bucket", "chunk_id", "text").repartition("bucket"), span)  # the only shuffle


def blocks_of(dealt: DataFrame, span: int = SPAN) -> DataFrame:
    """As ``block_postings``, of chunks each bucket of which lies in one partition.

    Texts are put in order by their size and cut into words as they pass; a task holds the words of one batch and of one span.
    """
    text = F.coalesce("text", F.lit(""))
    ordered = dealt.select(F.col("bucket").cast("int").alias("bucket"), "chunk_id", text.alias("text"), F.octet_length(text).alias("size")).sortWithinPartitions("bucket", "size", "chunk_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, place = [], None, 0  # slices of the span that is open; its bucket; chunks of the bucket so far
        for batch in batches:
            at, buckets = 0, batch.column("bucket").to_numpy()
            while at < batch.num_rows:
                if buckets[at] != now:
                    if held:
                        yield _blocks(held, now, (place - 1) // span)
                    held, now, place = [], int(buckets[at]), 0
                end = min(at + span - place % span, int(np.searchsorted(buckets, now, "right")))
                held.append(batch.slice(at, end - at))
                place, at = place + end - at, end
                if place % span == 0:
                    yield _blocks(held, now, place // span - 1)
                    held = []
        if held:
            yield _blocks(held, now, (place - 1) // span)

    words = ordered.select("bucket", "chunk_id", tokenize(F.col("text")).alias("w"))
    return words.mapInArrow(cut, "bucket int, term string, span long, n int, max_tf long, min_len long, chunk_ids array<string>, tfs array<long>, lens array<long>")


def _blocks(held: list[pa.RecordBatch], bucket: int, number: int) -> pa.RecordBatch:
    """held (chunk_id, w: words), the chunks of one span -> its blocks."""
    rows = pa.Table.from_batches(held).combine_chunks()
    rows = rows.take(pc.sort_indices(rows.column("chunk_id")))
    ids, words = (rows.column(c).combine_chunks() for c in ("chunk_id", "w"))
    length = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    many = max(1, len(ids))
    posting, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * many + np.repeat(np.arange(len(ids)), length), return_counts=True)
    term, chunk = posting // many, posting % many
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    edge = pa.array(np.r_[first, len(term)].astype(np.int32))
    listed = lambda values: pa.ListArray.from_arrays(edge, values)
    lens = length[chunk]
    reduced = lambda f, values: f.reduceat(values, first) if len(first) else values
    columns = {
        "bucket": pa.array(np.full(len(first), bucket, np.int32)),
        "term": coded.dictionary.take(pa.array(term[first])),
        "span": pa.array(np.full(len(first), bucket * (1 << 32) + number, np.int64)),
        "n": pa.array(np.diff(np.r_[first, len(term)]).astype(np.int32)),
        "max_tf": pa.array(reduced(np.maximum, tf).astype(np.int64)),
        "min_len": pa.array(reduced(np.minimum, lens)),
        "chunk_ids": listed(ids.take(pa.array(chunk))),
        "tfs": listed(pa.array(tf.astype(np.int64))),
        "lens": listed(pa.array(lens)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def flat(blocks: DataFrame) -> DataFrame:
    """A row for each posting: term, chunk_id, tf, len."""
    zipped = blocks.select("term", F.explode(F.arrays_zip("chunk_ids", "tfs", "lens")).alias("p"))
    return zipped.select("term", F.col("p.chunk_ids").alias("chunk_id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))


def weighted(blocks: DataFrame, terms: list[str], n_docs: int | Column) -> DataFrame:
    """The blocks of the terms, with the terms' idf. The filter on term reaches the scan; there is one weight for each query term."""
    own = blocks.filter(F.col("term").isin(terms))
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    idf = own.groupBy("term").agg(F.sum("n").alias("df")).select("term", bm25_idf(n, F.col("df")).alias("idf"))
    return own.join(F.broadcast(idf), "term")


def _scores(weights: DataFrame, avg_len: Column) -> DataFrame:
    """chunk_id, score: a chunk's terms are added in order of term, so equal chunks score equally."""
    parts = weights.select("term", "idf", F.explode(F.arrays_zip("chunk_ids", "tfs", "lens")).alias("p"))
    part = F.struct("term", bm25_term(F.col("idf"), F.col("p.tfs"), F.col("p.lens"), avg_len).alias("w"))
    summed = parts.groupBy(F.col("p.chunk_ids").alias("chunk_id")).agg(F.sort_array(F.collect_list(part)).alias("ps"))  # at most a row for each term
    return summed.select("chunk_id", F.aggregate("ps", F.lit(0.0), lambda s, p: s + p["w"]).alias("score")).filter("score > 0")


def live_spans(weights: DataFrame, avg_len: Column, limit: int, first: int) -> DataFrame:
    """(span, bound) of the spans that may hold one of the ``limit`` best chunks."""
    bound = F.sum(bm25_term(F.col("idf"), F.col("max_tf"), F.col("min_len"), avg_len))
    bounds = weights.groupBy("span").agg(bound.alias("bound"))
    best = bounds.orderBy(F.desc("bound"), "span").limit(first).select("span")
    found = _scores(weights.join(F.broadcast(best), "span", "left_semi"), avg_len).orderBy(F.desc("score"), "chunk_id").limit(limit)  # ``first`` spans
    least = found.agg(F.when(F.count("*") >= limit, F.min("score")).otherwise(0.0)).scalar()
    return bounds.filter(F.col("bound") >= least * ROOM)


def top_chunks(blocks: DataFrame, n_docs: int | Column, avg_len: float | Column | None, query: str, limit: int, first: int | None = None) -> DataFrame:
    """blocks (as ``block_postings``) -> chunk_id, score: the ``limit`` best by BM25, as ``lexical.bm25_leg`` finds them."""
    weights = weighted(blocks, query_terms(query), n_docs)
    avg = avg_len if isinstance(avg_len, Column) else F.lit(float(avg_len or 0.0))
    live = live_spans(weights, avg, limit, first or max(2, -(-4 * limit // SPAN)))
    return _scores(weights.join(live.select("span"), "span", "left_semi"), avg).orderBy(F.desc("score"), "chunk_id").limit(limit)


@dataclass(frozen=True)
class Postings:
    """Blocks of a corpus and its statistics."""

    blocks: DataFrame
    n_docs: int
    avg_len: float | None

    def leg(self, query: str, limit: int) -> DataFrame:
        return top_chunks(self.blocks, self.n_docs, self.avg_len, query, limit)


def count_blocks(blocks: DataFrame, n_docs: int, avg_len: float, query: str, limit: int, first: int = 2) -> tuple[int, int]:
    """(blocks scored in the end, blocks of the query's terms)."""
    weights = weighted(blocks, query_terms(query), n_docs)
    live = live_spans(weights, F.lit(avg_len), limit, first)
    return weights.join(live.select("span"), "span", "left_semi").count(), weights.count()
