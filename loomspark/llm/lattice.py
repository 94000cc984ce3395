"""Embedding near-duplicates by E8 lattice hashing.

In each of several tables a vector is projected at random onto blocks of eight dimensions, each block is
scaled and decoded to the nearest point of the E8 lattice, and the points together name a cell. A vector
is a *member* of its own cell and a *probe* of the neighbouring cells that lie nearest to it (a step along
one of the 240 shortest lattice vectors in one block, ranked by the distance to the vector). Vectors that
meet in a cell, unless both are probes, are candidates and are verified by cosine in double precision.

First only the names of cells and the ids of vectors are shuffled; cells that can give no pair (fewer than two
vectors, or probes alone) end there, and vectors travel, in their own precision, to the cells that are left.

Equal vectors are one class and are never expanded: a class counts with its number of rows. A pair that
meets several times is counted in one place, the first cell that both would name, which either side can
work out from the two vectors; so counts need no shuffle of pairs, and each cell sends back one row for a
vector with its number of links and a spanning forest for the components. Cells with more than ``most``
records are cut into a grid of blocks, with the records of a block copied along its row and column, so no
task holds a large cell; every pair is still compared.

``plan`` picks blocks, scale, probes and tables for the number of vectors, from measured recall: at
cosine 0.9, the hardest case, each plan finds over 0.99 of the pairs in expectation (0.9988 for the
smallest), and more above; tests compare with brute force.

Defined cases: vectors that are null, empty or zero, or hold nulls, NaN or infinities, link with nothing;
vectors of different lengths are not compared; repeated rows are vectors of their own, linked with each
other; ties have no influence; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpoint, mix64
from .components import components, least_linked


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


STEPS = _shortest()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    f = np.rint(y)
    odd = np.flatnonzero(f.sum(1) % 2)
    gap = y[odd] - f[odd]
    worst = np.abs(gap).argmax(1)
    f[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return f


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (D8, or D8 shifted by halves) to each row."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def plan(n: int) -> tuple[int, float, int, int]:
    """(blocks, scale, probes, tables) for n vectors."""
    if n <= 200_000:
        return 1, 0.26, 4, 4
    if n <= 20_000_000:
        return 2, 0.26, 12, 9
    return 3, 0.30, 12, 18


def cells(unit: np.ndarray, blocks: int, scale: float, probes: int, tables: int) -> np.ndarray:
    """rows x tables x (1 + probes): the hashed cell of each unit vector, then the cells it probes."""
    n, dim = unit.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    weights = np.random.default_rng(99).integers(1, 1 << 62, (blocks, 8), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for t in range(tables):
        rng = np.random.default_rng(1000 * dim + t)
        if dim >= 8 * blocks:
            proj = np.linalg.qr(rng.standard_normal((dim, 8 * blocks)))[0] * np.sqrt(dim / 64)
        else:
            proj = rng.standard_normal((dim, 8 * blocks)) / 8
        key = np.full(n, np.uint64(dim * 4096 + t), np.uint64)
        gains, steps = [], []
        with np.errstate(over="ignore"):
            key = mix64(key)
            for b in range(blocks):
                y = unit @ proj[:, 8 * b : 8 * b + 8] / scale
                c = nearest_e8(y)
                twice = np.rint(2 * c).astype(np.int64).astype(np.uint64)
                key = key + (twice * weights[b]).sum(1, dtype=np.uint64)
                gains.append(2 - 2 * (y - c) @ STEPS.T)
                steps.append((np.rint(2 * STEPS).astype(np.int64).astype(np.uint64) * weights[b]).sum(1, dtype=np.uint64))
            out[:, t, 0] = mix64(key)
            if probes:
                best = np.argsort(np.hstack(gains), axis=1, kind="stable")[:, :probes]
                out[:, t, 1:] = mix64((key[:, None] + np.concatenate(steps)[best]).ravel()).reshape(n, probes)
    return out


def unit_rows(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors as doubles) for each length of the vectors of an Arrow list array."""
    dims = vectors.value_lengths().to_numpy()
    out = []
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        v = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
        v = v / np.abs(v).max(1, keepdims=True)  # no overflow in squares
        out.append((at, v / np.sqrt((v * v).sum(1, keepdims=True))))
    return out


def _first_meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first cell that both of each pair name, at least one as a member. x, y: pairs x tables x cells."""
    big = np.uint64(0xFFFFFFFFFFFFFFFF)
    ox, oy = x[:, :, 0], y[:, :, 0]
    at_x = np.where((y == ox[:, :, None]).any(2), ox, big)
    at_y = np.where((x == oy[:, :, None]).any(2), oy, big)
    cell = np.minimum(at_x, at_y)
    first = (cell != big).argmax(1)
    return cell[np.arange(len(cell)), first]


def near_duplicates(vectors: DataFrame, least: float = 0.9, most: int = 4096, broadcast_rows: int = 500_000, params: tuple[int, float, int, int] | None = None) -> DataFrame:
    """vectors (vec_id, embedding) -> a row for each: vec_id, n_links, component_id, kept."""
    values = F.col("embedding").cast("array<double>")
    whole = F.coalesce(F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("v"), F.col("embedding").alias("raw")).withColumn("ok", whole & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", "ok", F.when(F.col("ok"), F.col("raw")).alias("v"), F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2"))
    classes = checkpoint(rows.filter("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    count = classes.count()
    blocks, scale, probes, tables = params or plan(count)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep = b.column("rep").to_numpy()
            for at, unit in unit_rows(b.column("v")):
                keys = cells(unit, blocks, scale, probes, tables).reshape(len(at), -1)
                w = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(w) % (1 + probes) > 0, len(at))), pa.array(np.repeat(rep[at], w))], ["cell", "probe", "rep"])

    named = classes.select("rep", "v").mapInArrow(bounded(name), "cell long, probe boolean, rep long")
    size = F.count("*")
    live = named.groupBy("cell").agg(size.alias("n"), F.count_if(~F.col("probe")).alias("members")).filter("n > 1 and members > 0")
    live = checkpoint(live.select("cell", F.ceil(F.col("n") / most).cast("int").alias("cut")))
    met = named.join(F.broadcast(live) if live.count() <= broadcast_rows else live, "cell")
    mine = F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int")
    dealt = met.join(classes.select("rep", "n", "v"), "rep").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    dealt = dealt.select("cell", F.least("mine", "other").alias("gi"), F.greatest("mine", "other").alias("gj"), "mine", "probe", "rep", "n", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cell, gi, gj, parts):
            mine, probe, rep, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
            if len(rep) < 2 or probe.all():
                return None
            ((_, unit),) = unit_rows(pa.concat_arrays([p[4] for p in parts]))  # a cell's vectors are of one length
            ii, jj = [], []
            member = np.flatnonzero(~probe)
            for lo in range(0, len(member), 512):
                i = member[lo : lo + 512]
                close = unit[i] @ unit.T >= least
                a, b = np.nonzero(close)
                a = i[a]
                ok = (rep[a] < rep[b]) | (probe[b] & (rep[a] != rep[b]))  # members of both kinds once
                if gi != gj:
                    ok &= mine[a] != mine[b]
                ii.append(a[ok])
                jj.append(b[ok])
            i, j = np.concatenate(ii), np.concatenate(jj)
            if not len(i):
                return None
            used, at = np.unique(np.r_[i, j], return_inverse=True)
            named = cells(unit[used], blocks, scale, probes, tables)
            at_i, at_j = at[: len(i)], at[len(i) :]
            own = np.zeros(len(i), bool)
            for lo in range(0, len(i), 50_000):
                s = slice(lo, lo + 50_000)
                own[s] = _first_meeting(named[at_i[s]], named[at_j[s]]).view(np.int64) == cell
            at_i, at_j = at_i[own], at_j[own]
            if not len(at_i):
                return None
            n_used = n[used]
            total = np.bincount(at_i, n_used[at_j], len(used)) + np.bincount(at_j, n_used[at_i], len(used))
            root = least_linked(at_i, at_j, len(used))
            live = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(rep[used][live]), pa.array(total[live].astype(np.int64)), pa.array(rep[used][root[live]])], ["rep", "links", "root"])

        at, parts = None, []
        for b in batches:
            cell, gi, gj = (b.column(c).to_numpy() for c in ("cell", "gi", "gj"))
            cols = [b.column("mine").to_numpy(), b.column("probe").to_numpy(zero_copy_only=False), b.column("rep").to_numpy(), b.column("n").to_numpy()]
            v = b.column("v")
            edge = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (gi[1:] != gi[:-1]) | (gj[1:] != gj[:-1])]) if len(cell) else []
            for lo, hi in zip(edge, [*edge[1:], len(cell)]):
                key = (cell[lo], gi[lo], gj[lo])
                if key != at:
                    if parts and (out := links(*at, parts)) is not None:
                        yield out
                    at, parts = key, []
                parts.append([*(c[lo:hi] for c in cols), v.slice(lo, hi - lo)])
        if parts and (out := links(*at, parts)) is not None:
            yield out

    met = dealt.repartition("cell", "gi", "gj").sortWithinPartitions("cell", "gi", "gj").mapInArrow(bounded(compare), "rep long, links long, root long")
    met = checkpoint(met.groupBy("rep", "root").agg(F.sum("links").alias("links")))
    labels = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = met.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("k1", "k2", "rep", "n").join(linked, "rep", "left").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = named.select("k1", "k2", F.lit(True).alias("ok"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "ok", "k1", "k2").join(named, ["k1", "k2", "ok"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
