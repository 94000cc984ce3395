"""The recall@k harness: evaluation of a golden query set, and comparison of two reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalar import recall

#: Texts that are looked through at once.
ROWS = 1000


def evaluate(golden: DataFrame, retrieved: DataFrame) -> DataFrame:
    """golden (query, expect array, k), retrieved (query, note_path, rank: by note) -> query, recall, found, missed."""
    got = retrieved.groupBy("query").agg(F.collect_set(F.struct("rank", "note_path")).alias("got"))  # the retriever's limit each; ``golden`` is read once
    near = F.transform(F.filter("got", lambda x: x["rank"] <= F.col("k")), lambda x: x["note_path"])
    rows = golden.join(got, "query", "left").withColumn("got", F.coalesce(near, F.array().cast("array<string>")))
    r, found, missed = recall(F.col("expect"), F.col("got"))
    return rows.select("query", r.alias("recall"), found.alias("found"), missed.alias("missed"))


def _pieces(text: Column) -> Column:
    return F.split(text, "[ \\t-\\r]+")


def _runs(k: int) -> Column:
    """The distinct hashes of the runs of k words in array ``w``."""
    return F.array_distinct(F.expr(f"case when size(w) >= {k} then transform(sequence(0, size(w) - {k}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(k))})) else array() end"))


def containing(docs: DataFrame, items: DataFrame, n: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, item_id of each two rows whose text contains the item's.

    The inner words of an item, white space on both sides, are whole words of every text that contains it. An item of
    at least ``n`` is sought by a run of n (the one that the fewest items have), others by their longest; texts
    found are verified. Items without an inner word are compared with every text. Up to ``broadcast_rows`` items are sought
    in one scan of the texts, without a shuffle; more are joined.
    """
    items = items.filter("text is not null").select("item_id", F.col("text").alias("part"), _pieces(F.col("text")).alias("w"))
    bare, whole = items.filter("size(w) <= 2").select("item_id", "part"), items.filter("size(w) > 2")
    out = docs.join(bare, F.contains("text", "part")).select("doc_id", "item_id")
    inner = whole.select("item_id", F.xxhash64("part").alias("t"), F.expr("slice(w, 2, size(w) - 2)").alias("w"))

    every = inner.filter(F.size("w") >= n).select("item_id", "t", F.explode(_runs(n)).alias("h"))
    rarest = Window.partitionBy("item_id", "t").orderBy("shared", "h")
    rare = every.join(every.groupBy("h").agg(F.count("*").alias("shared")), "h").withColumn("r", F.row_number().over(rarest)).filter("r = 1").select("item_id", "t", "h")
    few = inner.filter(F.size("w") < n).select("item_id", "t", F.expr("xxhash64(array_max(transform(w, x -> struct(length(x) as n, x as x))).x)").alias("h"))
    parts = whole.select("item_id", "part", F.xxhash64("part").alias("t"), F.expr("slice(w, 2, size(w) - 2)").alias("w"))
    if parts.count() <= broadcast_rows:
        keys = parts.join(rare.unionByName(few).distinct(), ["item_id", "t"])
        k = F.least(F.size("w"), F.lit(n))
        long, one = F.expr(f"get(filter(transform(sequence(1, greatest(1, size(w) - {n - 1})), i -> slice(w, i, {n})), x -> xxhash64({', '.join(f'get(x, {j})' for j in range(n))}) = h), 0)"), F.expr("array(array_max(transform(w, x -> struct(length(x) as n, x as x))).x)")
        got = keys.select("item_id", "part", F.when(k == n, long).otherwise(one).alias("run")).toArrow()  # broadcast_rows rows at most
        return out.unionByName(_sought(docs, got, items.schema["item_id"].dataType.simpleString())) if got.num_rows else out
    return out.unionByName(_joined(docs, parts, rare, n, n)).unionByName(_joined(docs, parts, few, 1, n))


def _sought(docs: DataFrame, items: pa.Table, kind: str) -> DataFrame:
    """docs (doc_id, text), items (item_id, part, run: words that every text with the part has) -> doc_id, item_id, by one scan."""
    ids, parts, runs = items.column("item_id").combine_chunks(), items.column("part").to_pylist(), items.column("run").to_pylist()
    words = pa.array(sorted({w for run in runs for w in run}), pa.string())
    number = {w: i + 1 for i, w in enumerate(words.to_pylist())}
    prime = np.uint64(0x9E3779B97F4A7C15)

    def key(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        with np.errstate(over="ignore"):
            for c in columns:
                h = (h ^ c) * prime
                h ^= h >> np.uint64(29)
        return h

    tables = []  # for each length of run: length, keys in order, the items of each
    for k in sorted({len(run) for run in runs}):
        own = np.array([i for i, run in enumerate(runs) if len(run) == k])
        keys = key([np.array([number[runs[i][j]] for i in own], np.uint64) for j in range(k)])
        order = np.argsort(keys, kind="stable")
        tables.append((k, keys[order], own[order]))
    shared = docs.sparkSession.sparkContext.broadcast((ids, parts, words, tables))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, words, tables = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                w = b.column("w")
                size = pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                # 0: in no run
                at = pc.fill_null(pc.add(pc.index_in(w.flatten(), value_set=words), 1), 0).to_numpy(zero_copy_only=False).astype(np.uint64)
                row = np.repeat(np.arange(b.num_rows), size)
                pairs = []
                for k, keys, own in tables:
                    m = len(at) - k + 1
                    if m <= 0:
                        continue
                    start = np.flatnonzero(np.logical_and.reduce([at[j : j + m] > 0 for j in range(k)]) & (row[:m] == row[k - 1 :]))
                    h = key([at[start + j] for j in range(k)])
                    left, right = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
                    many = right - left
                    place = np.repeat(left - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    pairs.append(np.repeat(row[start], many) * len(parts) + own[place])
                found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
                at_row, item = found // len(parts), found % len(parts)
                texts = {r: b.column("text")[int(r)].as_py() for r in np.unique(at_row)}
                good = np.array([parts[i] in texts[r] for r, i in zip(at_row, item)], dtype=bool)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at_row[good])), ids.take(pa.array(item[good]))], ["doc_id", "item_id"])

    return docs.select("doc_id", "text", _pieces(F.col("text")).alias("w")).mapInArrow(seek, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind}")


def _joined(docs: DataFrame, parts: DataFrame, keys: DataFrame, k: int, n: int) -> DataFrame:
    keys = keys.select("h", "item_id").distinct()
    own = docs.select("doc_id", F.filter(_pieces(F.col("text")), lambda w: w != "").alias("w")).select("doc_id", F.explode(_runs(k)).alias("h"))
    found = own.join(keys, "h").select("doc_id", "item_id").distinct()
    part = parts.filter(F.size("w") >= n if k == n else F.size("w") < n).select("item_id", "part")
    return docs.join(found, "doc_id").join(part, "item_id").filter(F.contains("text", "part")).select("doc_id", "item_id")


def mean_recall(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"), F.count("*").alias("n_queries"))


def diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """baseline, current (position, query, recall) -> queries in both, in baseline order; the current side's last row of a query wins."""
    last = Window.partitionBy("query").orderBy(F.desc("position"))
    now = current.withColumn("n", F.row_number().over(last)).filter("n = 1").select("query", F.col("recall").alias("current_recall"))
    out = baseline.select("position", "query", F.col("recall").alias("baseline_recall")).join(now, "query")
    return out.select("position", "query", "baseline_recall", "current_recall", (F.col("current_recall") - F.col("baseline_recall")).alias("delta"))


def regressions(d: DataFrame) -> DataFrame:
    return d.filter("delta < 0")
