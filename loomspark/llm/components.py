"""Connected components of a distributed edge list, by alternating large-star and small-star rounds.

Before each round every task replaces its edges, ``ROWS_PER_TASK`` of them at most, by a star forest of the
same components. Where all edges fit one such task that forest is the answer; else a round follows: two
aggregations and two joins, all keyed by a vertex, so a hub's edges are pre-aggregated
for its minimum and may be split by a skewed join; no neighbourhood is ever collected. A round's edges
are written to the shared checkpoint folder, which cuts the lineage and survives lost executors.
The number of rounds is logarithmic in practice; the loop ends when a round changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpoint

ROWS_PER_TASK = 100_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """The frame in as few tasks as so many rows need: each task of a stage leaves files of its own behind, however few its rows."""
    return df.coalesce(1 + rows // ROWS_PER_TASK)


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return packed(packed(both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")), n).distinct(), n)


def _small_star(e: DataFrame, n: int) -> DataFrame:
    """Edges point from the larger to the smaller vertex."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    linked = e.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return packed(packed(linked.unionByName(least.select("a", F.col("m").alias("b"))), n).distinct(), n)


def least_linked(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n vertices reaches by the links i - j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for end in (i, j, root[i], root[j]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _forests(e: DataFrame, rows: int) -> DataFrame:
    """Edges (a, b) -> a star forest of each task's edges: every vertex but the least of a task's component, with that least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in ("a", "b")] for b in batches if b.num_rows]
        if parts:
            a, b = (np.concatenate(v) for v in zip(*parts))
            ids, at = np.unique(np.r_[a, b], return_inverse=True)
            root = least_linked(at[: len(a)], at[len(a) :], len(ids))
            own = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"])

    return packed(e, rows).mapInArrow(bounded(run), "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (id, component): every vertex that isn't the least of its component, with that least one.

    Null ends link nothing; repeated edges, loops and ties have no influence; no edges give an empty result.
    """
    own = edges.filter("a <> b")
    e = checkpoint(own.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows, state = e.count(), None
    for _ in range(most_rounds):
        one = rows < ROWS_PER_TASK
        e = checkpoint(_forests(e, rows))
        if one:
            break
        rows = e.count()
        e = checkpoint(_small_star(_large_star(packed(e, rows), rows), rows))
        new = _state(e)
        rows = new[0]
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components didn't settle")
    return packed(e, rows).select(F.col("a").alias("id"), F.col("b").alias("component"))
