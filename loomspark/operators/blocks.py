"""The k best partners of many rows by a product, block by block in numpy; only the best are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEW_LEFT, LEFT_ROWS, PIECE = 4096, 16_384, 4096


class Best:
    """The k best (score, name) of each group, by score and then name, over any number of blocks."""

    def __init__(self, k: int):
        self.k = k
        self.group, self.score, self.name = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)

    def add(self, scores: np.ndarray, names: np.ndarray, groups: np.ndarray | None = None) -> None:
        """scores: groups (by number, all in order by default) x names; -inf is no partner."""
        if not scores.size:
            return
        if scores.shape[1] > self.k:
            enough = np.partition(scores, -self.k, axis=1)[:, -self.k]
            own = (scores >= enough[:, None]) & (scores > -np.inf)
        else:
            own = scores > -np.inf
        group, at = np.nonzero(own)
        group = group if groups is None else groups[group]
        group, score, name = np.r_[self.group, group], np.r_[self.score, scores[own]], np.r_[self.name, names[at]]
        by_name = pc.rank(pa.array(name, pa.string()), tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.lexsort((by_name, -score, group))
        group, score, name = group[order], score[order], name[order]
        first = np.searchsorted(group, group)
        keep = np.arange(len(group)) - first < self.k
        self.group, self.score, self.name = group[keep], score[keep], name[keep]


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _names(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def _add(best: Best, left: dict, matrix: np.ndarray, part: pa.RecordBatch, others: bool) -> None:
    for lo in range(0, part.num_rows, PIECE):
        names = _names(part.column("name").slice(lo, PIECE))
        scores = matrix @ _matrix(part.column("vector").slice(lo, PIECE)).T
        if others:
            for j, n in enumerate(names):
                if n in left:
                    scores[left[n], j] = -np.inf
        best.add(scores, names)


def _rows(best: Best, names: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names[best.group], pa.string()), pa.array(best.name, pa.string()), pa.array(best.score, pa.float64())], ["left", "right", "score"])


def top_products(left: DataFrame, right: DataFrame, k: int, others: bool = False, few: int = FEW_LEFT, left_rows: int = LEFT_ROWS) -> DataFrame:
    """left, right (name string, vector) -> left, right, score, rank: the k right rows with the greatest inner product for each left row.

    ``others``: a row isn't its own partner. Ties go to the name that sorts first. Up to ``few`` left rows are broadcast and multiplied with all
    right ones; more meet by clusters (``pivots``), in parts of ``left_rows`` at most, and pairs of clusters that can't give a partner are skipped.
    """
    count = left.count()
    schema = "left string, right string, score double"
    if count <= few:
        got = left.select("name", "vector").toArrow()  # ``few`` rows at most
        names = _names(got.column("name"))
        matrix = _matrix(got.column("vector").combine_chunks()) if count else np.zeros((0, 0))
        shared = left.sparkSession.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            best, at = Best(k), {n: i for i, n in enumerate(names)}
            for b in batches:
                if len(names):
                    _add(best, at, matrix, b, others)
            yield _rows(best, names)

        found = right.select("name", "vector").mapInArrow(run, schema)
    else:
        from loomspark.operators import pivots

        found = pivots.top_products(left, right, k, others, left_rows)
    w = Window.partitionBy("left").orderBy(F.desc("score"), "right")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
