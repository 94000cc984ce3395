"""Vector codes: product quantisation in integers, with partial-distance search for the nearest entries.

A component x becomes floor(4096 * x). A vector is cut into ``parts`` consecutive parts of equal length, and each
part position has a codebook of ``entries`` entries, which starts as that part of the vectors with the least ids.
Each round assigns every part to its nearest entry and replaces each entry by the floored mean of its parts;
entries that no part chose stay. After the last round parts are assigned again: the code.

Nearest entries are found by partial distances. The dimensions of a codebook are taken in descending order of its
variance, so distances grow early; entries come one after the other, and a mask keeps, of all the vectors of a batch,
those whose accumulated integer distance doesn't exceed (strictly) their best complete distance so far. Ties go to
the lower index. All arithmetic is in integers, so results don't depend on how rows are dealt.

Scale: every round is one scan without a shuffle of vectors: a task returns the sums and counts of its own parts, at
most parts x entries x dimensions numbers, which are added up by key. Codebooks (the same number of values, whatever
the number of rows) go through the driver; vectors and codes never do. Sums by label join codes again: broadcast
if the labels number at most ``broadcast_rows`` (they are counted), else by shuffle, where adaptive execution splits a hot label.

Defined cases: vectors that are null or hold nulls, NaN or infinities are dropped, and so are empty vectors and those
whose length isn't that of the first vector kept (by id); if ``parts`` doesn't divide the length, vectors are filled up with
zeros, which changes no distance; components saturate at +-2^26 (x = +-16,384), so distances fit 64 bits; with fewer
rows than entries the codebooks are as short as the table; a null id comes after all others; of equal ids the
lesser vector (as an array) comes first, and each row has its code; null labels are one label; an empty
table gives an empty result; extra columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpoint

SCALE, LIMIT = 4096, 1 << 26


def integers(v: pa.Array, parts: int) -> np.ndarray:
    """(rows, dims) int64 of a list array whose rows have one length; filled up to a multiple of ``parts``."""
    n, flat = len(v), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64).reshape(n, -1)
    short = -x.shape[1] % parts
    return np.pad(x, ((0, 0), (0, short))) if short else x


def spread(book: np.ndarray) -> np.ndarray:
    """Dimensions of a codebook (entries, dims) by descending variance, ties by position. Exact: k * sum(c^2) - sum(c)^2 as Python integers."""
    c = book.astype(object)
    var = len(book) * (c * c).sum(0) - c.sum(0) ** 2
    return np.array(sorted(range(book.shape[1]), key=lambda d: (-var[d], d)), np.int64)


def nearest(x: np.ndarray, book: np.ndarray, counts: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of ``book`` (entries, dims) for each row of x (rows, dims).

    ``counts``, if given, gets [products made, products of a full search].
    """
    order = spread(book)
    xs, cs = np.ascontiguousarray(x[:, order].T), book[:, order]  # a row for each dimension
    best, at, made = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    for j in range(len(book)):
        live, acc = np.arange(len(x)), np.zeros(len(x), np.int64)
        for d in range(len(order)):
            gap = xs[d][live] - cs[j, d]
            acc += gap * gap
            made += len(live)
            if j:
                within = acc <= best[live]  # what exceeds the best complete distance can't win any more
                if not within.all():
                    live, acc = live[within], acc[within]
                    if not len(live):
                        break
        if not j:
            best[:] = acc
        else:
            less = acc < best[live]  # an equal distance stays with the lower index
            best[live[less]], at[live[less]] = acc[less], j
    if counts is not None:
        counts[0] += made
        counts[1] += x.size * len(book)
    return at, best


def _assigner(books: np.ndarray):
    """books (parts, entries, dims): rows of integers -> indexes, distances, each (rows, parts)."""
    parts, _, dims = books.shape

    def assign(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = [nearest(x[:, p * dims : (p + 1) * dims], books[p]) for p in range(parts)]
        return np.stack([g[0] for g in got], 1), np.stack([g[1] for g in got], 1)

    return assign


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, label) of the rows whose vectors hold finite numbers only."""
    v = F.col("embedding")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.select("vec_id", v.alias("v"), label.alias("label")).filter(v.isNotNull() & (F.size(v) > 0) & finite)


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> tuple[np.ndarray | None, int]:
    """(parts, entries, dims): the parts of the vectors with the least ids, None without rows; and the first one's length."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    if not len(first):
        return None, 0
    length = len(first[0])
    x = integers(first.filter(pc.equal(pc.list_value_length(first), length)), parts)
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2), length


def one_round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """New codebooks: the floored means of what chose each entry."""
    parts, entries, dims = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, total, count = _assigner(books), np.zeros((parts, entries, dims), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = integers(b.column("v"), parts)
            index, _ = assign(x)
            for p in range(parts):
                count[p] += np.bincount(index[:, p], minlength=entries)
                np.add.at(total[p], index[:, p], x[:, p * dims : (p + 1) * dims])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p * entries + e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["at", "n", "sums"])

    parts_of = rows.select("v").mapInArrow(bounded(sums), "at long, n long, sums array<long>").select("at", "n", F.posexplode("sums").alias("d", "s"))
    new = books.copy()
    for r in parts_of.groupBy("at", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow().to_pylist():
        new[r["at"] // entries, r["at"] % entries, r["d"]] = r["s"] // r["n"]
    return new


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, np.ndarray | None]:
    """vectors (vec_id, embedding, label if any) -> the rows to be coded (vec_id, v, label), and codebooks (parts, entries, dims)."""
    rows = usable(vectors)
    books, length = first_codebooks(rows, parts, entries)
    if books is None:
        return rows.limit(0), None
    rows = rows.filter(F.size("v") == length)
    for _ in range(rounds):
        books = one_round(rows, books)
    return rows, books


def encode(rows: DataFrame, books: np.ndarray | None) -> DataFrame:
    """rows (vec_id, v, label) -> vec_id, label, code (array of indexes by part), error (squared distances summed over parts)."""
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = f"vec_id {kinds['vec_id'].simpleString()}, label {kinds['label'].simpleString()}, code array<int>, error long"
    if books is None:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assigner(books)
        for b in batches:
            if b.num_rows:
                index, far = assign(integers(b.column("v"), books.shape[0]))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(list(index.astype(np.int32)), pa.list_(pa.int32())), pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(bounded(run), schema)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(rows, parts) indexes -> the vectors that they stand for, (rows, dims), in the input's unit."""
    return np.concatenate([books[p][codes[:, p]] for p in range(books.shape[0])], 1) / SCALE


def digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """coded (..., label, error) -> the same and label_error, the errors summed over equal labels, nulls together."""
    coded = checkpoint(coded)
    sums = checkpoint(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    small = F.broadcast(sums) if sums.count() <= broadcast_rows else sums
    return coded.join(small, coded["label"].eqNullSafe(small["of"])).drop("of")
