"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame operations only.

Both sides become sets of five-word shingles (A-Z lower-cased, words between white space). Documents
may be far larger than an item, so similarity of whole sketches is useless; what is sought is
*containment* |item & document| / |item| >= threshold. Therefore only items are sketched: an item keeps
the ``sketch`` least values of one 64-bit hash of its shingles (bottom-k MinHash), and a document's whole
shingle set is probed with them. Items are partitioned by size: a partition has its own number of
sketch values and its own number of hits that make a candidate, the largest for which an item
contained to the threshold is missed with probability below ``miss`` (a binomial tail; sizes up to
``sketch`` are searched with all their shingles and lose nothing). A candidate is then verified by
counting the shingles, as strings, that the document holds.

Scale: the document side is a scan with a map-side filter; it is never shuffled as text unless the
candidate ids outgrow ``broadcast_rows``. The sketch table is broadcast only while it has at most
``broadcast_rows`` rows and is joined by shuffle beyond that. Hits are pre-aggregated per document
and item, so an item contained in a third of all documents is spread over all tasks.

Defined cases: null or empty texts, on either side, have no shingles and match nothing; a text of fewer
than ``n`` words is one shingle of all its words; repeated rows with one id count as one document whose
set is the union; rows with a null id, on either side, are one document or item for each different text, and are
matched, reported and dropped like others; ids may be of any type that can be grouped; very long texts are read whole;
ties have no influence; extra columns, of any name, are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), "[ \\t-\\r]+"), lambda w: w != "")


def shingle_hashes(w: str, n: int) -> Column:
    """Hashes of the runs of n words of the array column ``w``; of the whole when it is shorter."""
    parts = ", ".join(f"{w}[i + {k}]" for k in range(n))
    return F.expr(f"case when size({w}) >= {n} then transform(sequence(0, size({w}) - {n}), i -> xxhash64({parts})) when size({w}) > 0 then array(xxhash64(array_join({w}, ' '))) else array() end")


def shingle_strings(w: str, n: int) -> Column:
    return F.expr(f"case when size({w}) >= {n} then transform(sequence(0, size({w}) - {n}), i -> concat_ws(' ', {', '.join(f'{w}[i + {k}]' for k in range(n))})) when size({w}) > 0 then array(array_join({w}, ' ')) else array() end")


def hits_needed(k: int, threshold: float, miss: float) -> int:
    """The most hits among k sketch values that an item contained to the threshold lacks with probability below miss."""
    tail = 0.0
    for r in range(k + 1):
        tail += comb(k, r) * threshold**r * (1 - threshold) ** (k - r)
        if tail > miss:
            return max(1, r)
    return k


def item_sketches(items: DataFrame, n: int, threshold: float, sketch: int, miss: float) -> DataFrame:
    """(item_id, n_item, needed, h): a row for each sketch value, partitioned by item size."""
    sized = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.array_sort(F.array_distinct(shingle_hashes("w", n))).alias("hs")).filter("size(hs) > 0")
    full = [max(1, ceil(threshold * k - 1e-9)) for k in range(sketch + 1)]
    needed = F.when(F.size("hs") <= sketch, F.element_at(F.array(*map(F.lit, full)), F.size("hs") + 1)).otherwise(F.lit(hits_needed(sketch, threshold, miss)))
    return sized.select("item_id", F.size("hs").alias("n_item"), needed.alias("needed"), F.explode(F.slice("hs", 1, sketch)).alias("h"))


def keyed(rows: DataFrame, id_: str) -> DataFrame:
    """(key, text): the id, and a hash of the text where the id is null. Structs with equal nulls are equal in groups and joins."""
    return rows.select(F.struct(F.col(id_).alias("id"), F.when(F.col(id_).isNull(), F.xxhash64("text")).alias("of")).alias("key"), "text")


def _contained(docs: DataFrame, items: DataFrame, n: int, threshold: float, sketch: int, miss: float, broadcast_rows: int) -> DataFrame:
    """docs (key, text), items (key, text) -> doc, item (keys), n_shared, n_item."""
    items = items.filter("text is not null").withColumnRenamed("key", "item_id")
    docs = docs.withColumnRenamed("key", "doc_id")
    probes = checkpoint(item_sketches(items, n, threshold, sketch, miss))
    small = probes.count() <= broadcast_rows
    by_hash = probes.groupBy("h").agg(F.collect_list(F.struct("item_id", "needed")).alias("at"))
    if small:
        by_hash = F.broadcast(by_hash)
    found = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(shingle_hashes("w", n)).alias("h")).join(by_hash, "h").select("doc_id", "h", F.explode("at").alias("i"))
    candidates = checkpoint(found.groupBy("doc_id", F.col("i.item_id").alias("item_id"), "h").agg(F.first("i.needed").alias("needed")).groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.first("needed").alias("needed")).filter("hits >= needed").select("doc_id", "item_id"))

    ids = candidates.select("doc_id").distinct()
    if candidates.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    texts = docs.join(ids, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    doc_shingles = texts.select("doc_id", F.explode(F.array_distinct(shingle_strings("w", n))).alias("s"))
    item_shingles = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.array_distinct(shingle_strings("w", n)).alias("ss"))
    item_rows = item_shingles.select("item_id", F.size("ss").alias("n_item"), F.explode("ss").alias("s"))
    if small:  # an item has at most as many shingles as words
        item_rows = F.broadcast(item_rows) if item_rows.count() <= broadcast_rows else item_rows
    shared = doc_shingles.join(item_rows, "s").groupBy("doc_id", "item_id", "s").agg(F.first("n_item").alias("n_item")).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.first("n_item").cast("long").alias("n_item"))
    return shared.filter(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9).join(candidates, ["doc_id", "item_id"], "left_semi")


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, sketch: int = 24, miss: float = 1e-7, broadcast_rows: int = 500_000) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, item_id, n_shared, n_item, containment, for containment >= threshold."""
    found = _contained(keyed(docs, "doc_id"), keyed(items, "item_id"), n, threshold, sketch, miss, broadcast_rows)
    return found.select(F.col("doc_id.id").alias("doc_id"), F.col("item_id.id").alias("item_id"), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, sketch: int = 24, miss: float = 1e-7, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item."""
    found = _contained(keyed(docs, "doc_id"), keyed(items, "item_id"), n, threshold, sketch, miss, 500_000)
    gone = checkpoint(found.select("doc_id.id", "doc_id.of").distinct())
    small = gone.count() <= broadcast_rows
    ids, texts = gone.filter("id is not null").select(F.col("id").alias("doc_id")), gone.filter("id is null").select("of")
    kept = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti")
    if texts.isEmpty():
        return kept
    own = F.when(kept["doc_id"].isNull(), F.xxhash64(kept["text"]))
    return kept.join(F.broadcast(texts) if small else texts, own == texts["of"], "left_anti")
