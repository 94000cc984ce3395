"""Scalar Columns: paths, signatures, hashes, vectors, scores, times."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B, RRF_OFFSET = 1.2, 0.75, 60  # fixed values of the ranking formulas


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat_ws("#", path, index.cast("string"))


def top_folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("")


def _escaped(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def pair_signature(a: Column, b: Column) -> Column:
    """One name for an unordered pair of paths; a path with a pipe gets the escaped form."""
    plain = ~a.contains("|") & ~b.contains("|")
    x, y = _escaped(a), _escaped(b)
    return F.when(plain, F.concat_ws("|", F.lit("weaklink"), F.least(a, b), F.greatest(a, b))).otherwise(F.concat_ws("|", F.lit("weaklink2"), F.least(x, y), F.greatest(x, y)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def bm25_idf(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def bm25_term(idf: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def rrf(rank: Column) -> Column:
    return 1 / (F.lit(float(RRF_OFFSET)) + rank)


def min_max(score: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (score - low) / (high - low)).otherwise(1.0)


@F.pandas_udf(T.DoubleType())
def round4(x: pd.Series) -> pd.Series:
    """Rounding of the binary value to four places, half to even, as IEEE doubles read exactly."""
    return x.map(lambda v: None if v is None else round(v, 4))


def cutoff(now: Column, days: int) -> Column:
    return F.date_trunc("SECOND", now) - F.make_dt_interval(F.lit(days))


def iso(ts: Column) -> Column:
    """ISO seconds with +00:00; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def recall(expect: Column, got: Column) -> tuple[Column, Column, Column]:
    """(recall, found, missed); repeats in ``expect`` count, and its order is kept."""
    found = F.filter(expect, lambda e: F.array_contains(got, e))
    missed = F.filter(expect, lambda e: ~F.array_contains(got, e))
    return F.size(found) / F.size(expect), found, missed
