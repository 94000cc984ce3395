"""The k greatest inner products of many rows with many, exactly, without making most of them.

Rows of both sides are dealt to the nearest of some pivots. For u near pivot p and v near pivot q, <u, v> <= <p, q> + |u - p| |q| +
|u| |v - q| (Cauchy-Schwarz), so two clusters have a bound. First each left cluster meets the right clusters with the greatest <p, q>
that hold enough rows; that gives each left row k partners and a least score. Then it meets every other right cluster whose
bound reaches the least of these; in the task, only rows whose own bound <u, q> + |u| radius(q) reaches their own least are multiplied.
Bounds are compared with a little room, since products round.

Scale: pivots (the square root of the right rows, ``MOST`` at most, chosen far apart among four times as many) and what is known of their clusters go through the driver; rows never do.
Clusters travel in blocks of about ``block_rows`` rows, larger ones in a grid of parts, so no task holds many rows and none is copied
more often than there are blocks. The work is rows x pivots, and the
products of clusters that can't be told apart; where vectors have no clusters at all, that is all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.blocks import PIECE, Best, _matrix, _names, _rows
from loomspark.sources.durable import checkpoint

MOST, BLOCK_ROWS, ROOM = 4096, 16_384, 1e-9


def spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, each the farthest from those chosen before; fewer if the others are all equal to one of them."""
    chosen, gap = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def _assigned(rows: DataFrame, shared) -> DataFrame:
    """name, vector -> also c (number of the nearest pivot), gap (distance to it), norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        square = (pivots * pivots).sum(1)
        for b in batches:
            for lo in range(0, b.num_rows, PIECE):
                part = b.slice(lo, PIECE)
                x = _matrix(part.column("vector"))
                c = (square[None] - 2 * (x @ pivots.T)).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c), pa.array(np.linalg.norm(x - pivots[c], axis=1)), pa.array(np.linalg.norm(x, axis=1))], ["name", "vector", "c", "gap", "norm"])

    return checkpoint(rows.select("name", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "name string, vector array<double>, c long, gap double, norm double"))


def _by_cluster(rows: DataFrame, pivots: int, **columns) -> dict[str, np.ndarray]:
    """Aggregates of each cluster, by its number; a row for each pivot comes to the driver."""
    out = {k: np.zeros(pivots) for k in columns}
    for r in rows.groupBy("c").agg(*(v.alias(k) for k, v in columns.items())).collect():
        for k in columns:
            out[k][r["c"]] = r[k]
    return out


def _blocks(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring clusters go into one block while it has at most ``block_rows`` rows -> (block of each cluster, parts of each block)."""
    block, rows = np.zeros(len(sizes), np.int64), []
    for x, n in enumerate(sizes):
        if rows and rows[-1] + n <= block_rows:
            rows[-1] += n
        else:
            rows.append(n)
        block[x] = len(rows) - 1
    return block, np.maximum(1, np.ceil(np.array(rows) / block_rows)).astype(np.int64)


def _met(left: DataFrame, right: DataFrame, meet_: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], radius: np.ndarray, shared, k: int, others: bool, block_rows: int) -> DataFrame:
    """left (name, vector, c, norm, least), right (name, vector, c), meet_ (which clusters meet) -> left, right, score of the best k of each left row in each two blocks.

    Clusters travel in blocks, so a row is copied once for each block of the other side that holds a cluster which it is to meet.
    """
    spark = left.sparkSession
    (block_a, cut_a), (block_b, cut_b) = (_blocks(n, block_rows) for n in sizes)
    a, b = np.unique(np.stack([block_a[np.nonzero(meet_)[0]], block_b[np.nonzero(meet_)[1]]]), axis=1)
    pairs = pa.table({"a": a, "b": b, "cut_a": cut_a[a], "cut_b": cut_b[b]})
    of = lambda block, name: F.broadcast(spark.createDataFrame(pa.table({"c": np.arange(len(block)), name: block})))  # noqa: E731  a row for each pivot
    meetings = F.broadcast(spark.createDataFrame(pairs))  # the square of the blocks, of which there are no more than pivots
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("name"), F.col(n))
    l = left.join(of(block_a, "a"), "c").join(meetings, "a").select("a", "b", own("cut_a").alias("i"), F.explode(upto("cut_b")).alias("j"), F.lit(0).alias("side"), "c", "name", "vector", "norm", "least")  # noqa: E741
    r = right.join(of(block_b, "b"), "c").join(meetings, "b").select("a", "b", F.explode(upto("cut_a")).alias("i"), own("cut_b").alias("j"), F.lit(1).alias("side"), "c", "name", "vector", F.lit(0.0).alias("norm"), F.lit(0.0).alias("least"))
    far = spark.sparkContext.broadcast((radius, meet_))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, (radius, allowed) = shared.value, far.value
        at, parts, best = None, [], None
        for b in batches:
            key = np.stack([b.column(n).to_numpy() for n in ("a", "b", "i", "j", "side", "c")])
            key[5, key[4] == 0] = 0  # left rows come together, right ones by cluster
            edge = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]) if b.num_rows else []
            for lo, hi in zip(edge, [*edge[1:], b.num_rows]):
                cell, part, c = tuple(key[:4, lo]), b.slice(lo, hi - lo), key[5, lo]
                if cell != at:
                    if best is not None:
                        yield _rows(best, names)
                    at, parts, best = cell, [], None
                if key[4, lo] == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if best is None:
                    matrix = np.concatenate([_matrix(p.column("vector")) for p in parts])
                    norm, least, cluster = (np.concatenate([p.column(n).to_numpy() for p in parts]) for n in ("norm", "least", "c"))
                    names = np.concatenate([_names(p.column("name")) for p in parts])
                    best, place = Best(k), {n: x for x, n in enumerate(names)}
                bound = matrix @ pivots[c] + norm * radius[c]
                live = np.flatnonzero(allowed[cluster, c] & (bound >= least - ROOM * (1 + np.abs(bound))))
                if not len(live):
                    continue
                row = np.full(len(names), -1)
                row[live] = np.arange(len(live))
                for start in range(0, part.num_rows, PIECE):
                    piece = part.slice(start, PIECE)
                    right_names = _names(piece.column("name"))
                    scores = matrix[live] @ _matrix(piece.column("vector")).T
                    if others:
                        for x, n in enumerate(right_names):
                            if (y := place.get(n, -1)) >= 0 and row[y] >= 0:
                                scores[row[y], x] = -np.inf
                    best.add(scores, right_names, live)
        if best is not None:
            yield _rows(best, names)

    return l.unionByName(r).repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j", "side", "c").mapInArrow(meet, "left string, right string, score double")


def top_products(left: DataFrame, right: DataFrame, k: int, others: bool = False, block_rows: int = BLOCK_ROWS, counts: dict | None = None) -> DataFrame:
    """left, right (name string, vector) -> left, right, score: rows that hold the k greatest products of each left row (and some that don't).

    ``others``: a row isn't its own partner. ``counts``, if given, gets the products of clusters that met and of all rows.
    """
    spark, schema = left.sparkSession, "left string, right string, score double"
    n = min(MOST, ceil(sqrt(right.count())))
    drawn = right.orderBy(F.xxhash64("name"), "name").limit(4 * n).select(F.col("vector").cast("array<double>").alias("vector")).toArrow()["vector"].combine_chunks()
    if not len(drawn) or left.isEmpty():
        return spark.createDataFrame([], schema)
    at = spread_out(_matrix(drawn), n)
    shared = spark.sparkContext.broadcast(at)
    a, b = _assigned(left, shared), _assigned(right, shared)
    of_left = _by_cluster(a, len(at), n=F.count("*"), gap=F.max("gap"), norm=F.max("norm"))
    of_right = _by_cluster(b, len(at), n=F.count("*"), gap=F.max("gap"))
    sizes, radius = (of_left["n"], of_right["n"]), of_right["gap"]
    products, length = at @ at.T, np.linalg.norm(at, axis=1)
    used = np.flatnonzero(sizes[0])

    first = np.zeros_like(products, bool)
    held = np.flatnonzero(sizes[1])
    for x in used:
        order = held[np.argsort(-products[x, held], kind="stable")]
        enough = np.searchsorted(np.cumsum(sizes[1][order]), k + others)
        first[x, order[: enough + 1]] = True
    start = checkpoint(_met(a.withColumn("least", F.lit(float("-inf"))), b, first, sizes, radius, shared, k, others, block_rows))

    place = F.row_number().over(Window.partitionBy("left").orderBy(F.desc("score"), "right"))
    kth = start.withColumn("place", place).filter(F.col("place") == k).select(F.col("left").alias("name"), F.col("score").alias("least"))
    known = checkpoint(a.join(kth, "name", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))))
    least = _by_cluster(known, len(at), least=F.min("least"))["least"]
    bound = products + of_left["gap"][:, None] * length[None] + of_left["norm"][:, None] * radius[None]
    then = (bound >= least[:, None] - ROOM * (1 + np.abs(bound))) & ~first & (sizes[0] > 0)[:, None] & (sizes[1] > 0)[None]
    if counts is not None:
        area = sizes[0][:, None] * sizes[1][None]
        counts |= {"made": int(area[first | then].sum()), "all": int(area.sum())}
    if not then.any():
        return start
    return start.unionByName(checkpoint(_met(known, b, then, sizes, radius, shared, k, others, block_rows)))
