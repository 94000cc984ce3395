"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its distinct ``n``-word shingles, as 64-bit hashes. Documents with equal sets
form a *class*, named by a hash of the set; copies are never expanded. Shingles are ordered rarest first
(any total order is right for prefix filtering, so frequencies come from a sketch of 2**SKETCH_BITS counters,
counted over all documents; it is broadcast as one byte a counter). Two sets with Jaccard >= t share a
shingle among the first ``|x| - ceil(t |x|) + 1`` of each, so

1. classes meet in the buckets of their prefix shingles. A bucket of up to ``bucket`` classes gives all its
   pairs that pass the length filter and the positional filter (what is left of either set after the
   shared shingle bounds the overlap). In a larger one a record is paired with three others only: the two
   *pivots* of the bucket (its first records by position: they hold the least of their own, so they are the
   likeliest partners of all) and the record before it. Its records are kept for steps 4 and 5. Buckets that
   the sketch knows to be very large are salted.
2. Pairs are deduplicated and pass the suffix filter: sizes of 64 hash partitions of either set bound the
   overlap from above.
3. Each class is verified with its likeliest partner (by that bound) and the components of these links are
   found; then the likeliest pair of each two components is, for some rounds; and then every pair that is
   left *between different components*: a pair inside one component can't change the result.
4. The records of large buckets in which components still mix are paired again with pivots and neighbours,
   now of other components and with other salts, while that finds links (``rounds`` times at most).
5. Where components still share a large bucket, every record that isn't of the bucket's largest component
   is held against all records of other components there, in a grid of cells of bounded size, and the pairs that
   pass the filters are verified. So no link between components is lost, while a group of n near copies costs
   about n verifications, not n squared.

Verification ships a class's text once to the smaller partner of each of its pairs, streams it past the
partner's set there, and counts the intersection of the two hash sets exactly. Large fans of one partner
are salted.

Defined cases: null or empty texts have an empty set (0 shingles) and link with nothing; a text of fewer
than n words is one shingle of all its words; a null doc_id links with nothing; rows with one doc_id are
one vertex and keep their rows, also where their texts differ; doc_id is of an integer type or a string of
digits, and any other type or text is an error; ties have no influence; extra columns are ignored; an empty
table gives an empty result. Set and shingle identity rests on 64-bit hashes (128 bits for classes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, chunks, lower_bytes, mix64, run_hashes, span_hashes, bounded, word_spans
from .components import components, packed

SKETCH_BITS, SLICES, PARTS = 22, 256, 64
LOG_STEP = float(np.log(1.1))  # a count c is kept as round(log(1 + c) / LOG_STEP), one byte
FULL = 65_535  # a partition of this size or more: no bound


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (hash, document) of each document, by document and then hash."""
    low = lower_bytes(raw)
    start, end, doc = word_spans(low, off)
    words = span_hashes(low, start, end)
    h, d = run_hashes(words, doc, n)
    count = np.bincount(doc, minlength=len(off) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = count[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        with np.errstate(over="ignore"):
            for i in range(n - 1):
                more = count[short] > i
                whole[more] = mix64((whole[more] ^ words[first[more] + i]) * np.uint64(0xE7037ED1A0B428DB))
        h, d = np.concatenate([h, whole]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        keep = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
        h, d = h[keep], d[keep]
    return h, d


def _class_keys(h: np.ndarray, d: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, two 64-bit hashes of the set) of each document."""
    size = np.bincount(d, minlength=docs)
    k1, k2 = np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
    if len(h):
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        with np.errstate(over="ignore"):
            k1[d[cut]] = np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), cut)
            k2[d[cut]] = np.add.reduceat(mix64(h ^ np.uint64(0x14057B7EF767814F)), cut)
    return size, mix64(k1 + size.astype(np.uint64)), mix64(k2)


def _partition_sizes(h: np.ndarray, d: np.ndarray, docs: int) -> np.ndarray:
    """How many shingles of each document fall into each of PARTS hash partitions, FULL at most."""
    return np.bincount(d * PARTS + (h & np.uint64(PARTS - 1)).astype(np.int64), minlength=docs * PARTS).reshape(docs, PARTS).clip(0, FULL).astype("<u2")


def _squeeze(counts: np.ndarray) -> bytes:
    """Counts as compressed byte planes."""
    planes = np.ascontiguousarray(counts, "<i8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _spread(b: bytes) -> np.ndarray:
    n = (1 << SKETCH_BITS) // SLICES
    planes = np.frombuffer(pa.decompress(b, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document (payload null), and rows with slices of each task's frequency sketch (slice >= 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        for part, raw, off in chunks(batches):
            m = len(off) - 1
            h, d = shingle_sets(raw, off, n)
            np.add.at(sketch, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            size, k1, k2 = _class_keys(h, d, m)
            sizes = _partition_sizes(h, d, m)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([s.tobytes() for s in sizes], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                names,
            )
        if sketch.any():
            packed = [_squeeze(x) for x in np.split(sketch, SLICES)]
            no = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([no, no, no, no, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names)

    names = ["doc_id", "n_shingles", "k1", "k2", "sizes", "slice", "payload"]
    return docs.select("doc_id", "text").mapInArrow(bounded(run), "doc_id long, n_shingles long, k1 long, k2 long, sizes binary, slice int, payload binary")


def _frequencies(parts: DataFrame, groups: int = 8) -> np.ndarray:
    """Sum of the tasks' sketches, on a log scale: 2**SKETCH_BITS bytes, whatever the input. Added up in two levels."""

    def add(last: bool):
        def done(s: int, total: np.ndarray) -> pa.RecordBatch:
            out = np.rint(np.log1p(total) / LOG_STEP).clip(0, 255).astype(np.uint8).tobytes() if last else _squeeze(total)
            return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([out], pa.binary())], ["slice", "payload"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, None
            for b in batches:
                for s, p in zip(b.column("slice").to_pylist(), b.column("payload")):
                    if s != at and total is not None:
                        yield done(at, total)
                    x = _spread(p.as_py())
                    at, total = s, x if s != at else total + x
            if total is not None:
                yield done(at, total)

        return bounded(run)

    parts = parts.select("slice", "payload").withColumn("g", F.pmod(F.xxhash64("payload"), F.lit(groups)).cast("int"))
    some = parts.repartition("slice", "g").sortWithinPartitions("slice").select("slice", "payload").mapInArrow(add(False), "slice int, payload binary")
    whole = some.repartition("slice").sortWithinPartitions("slice").mapInArrow(add(True), "slice int, payload binary")
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for r in whole.collect():  # SLICES rows
        out[r["slice"]] = np.frombuffer(r["payload"], np.uint8)
    return out.ravel()


def _least_overlap(x, y, percent: int):
    """The least intersection size of sets of sizes x and y with Jaccard >= percent / 100."""
    return -((-percent * (x + y)) // (100 + percent))


#: A record's key is its shingle plus salt * SALT; size, position and salt share one long.
SALT = 0x632BE59BD9B4E019


def _pack(size: np.ndarray, pos: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return (size.astype(np.int64) << 36) | (pos.astype(np.int64) << 8) | salt.astype(np.int64)


def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 36, (x >> 8) & 0xFFFFFFF, x & 0xFF


def _prefix_records(docs: DataFrame, n: int, percent: int, frequency: np.ndarray, salt_rows: int) -> DataFrame:
    """(key, k, x): a row for each shingle in the prefix of each class, rarest shingles first."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)  # 2**SKETCH_BITS bytes
    mean = float(np.expm1(frequency * LOG_STEP).mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        salts_of = np.clip((np.expm1(np.arange(256) * LOG_STEP) - mean) // salt_rows + 1, 1, 255).astype(np.int64)  # from an estimate of a shingle's own count
        seen: set[int] = set()  # copies inside a task are dropped before the shuffle
        for _, raw, off in chunks(batches):
            m = len(off) - 1
            h, d = shingle_sets(raw, off, n)
            size, k1, _ = _class_keys(h, d, m)
            fresh = np.zeros(m, bool)
            for i, k in enumerate(k1.tolist()):
                if size[i] and k not in seen:
                    fresh[i] = True
                    if len(seen) < 200_000:
                        seen.add(k)
            own = fresh[d]
            h, d = h[own], d[own]
            bucket = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            order = np.lexsort((h, freq[bucket], d))
            h, d, bucket = h[order], d[order], bucket[order]
            first = np.searchsorted(d, np.arange(m))
            position = np.arange(len(d)) - first[d]
            least = -((-percent * size) // 100)
            keep = position < (size - least + 1)[d]
            h, d, bucket, position = h[keep], d[keep], bucket[keep], position[keep]
            salts = salts_of[freq[bucket]]
            salt = np.where(salts > 1, (k1[d] % salts.astype(np.uint64)).astype(np.int64) + 1, 0).clip(0, 255)
            with np.errstate(over="ignore"):
                key = h + salt.astype(np.uint64) * np.uint64(SALT)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(k1[d].view(np.int64)), pa.array(_pack(size[d], position, salt))], ["key", "k", "x"])

    return docs.select("text").mapInArrow(bounded(run), "key long, k long, x long")


def _passes(sx, px, sy, py, percent: int):
    """Length and positional filters of a pair that shares a shingle at positions px and py."""
    need = _least_overlap(sx, sy, percent)
    return (100 * np.minimum(sx, sy) >= percent * np.maximum(sx, sy)) & (np.minimum(sx - px, sy - py) >= need)


def _few_partners(cut: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of each run (they begin at ``cut``): a row with the run's first row, with its first row of another component, and with the row before."""
    n = len(c)
    at = np.arange(n)
    length = np.diff(np.r_[cut, n])
    first = np.repeat(cut, length)
    second = np.repeat(np.minimum.reduceat(np.where(c != c[first], at, n), cut), length) if n else first
    i, j = np.concatenate([at, at, at[1:]]), np.concatenate([first, second, np.where(first[1:] == at[1:], at[1:], at[:-1])])
    ok = (j < n) & (j != i)
    i, j = i[ok], j[ok]
    ok = c[i] != c[j]
    return i[ok], j[ok]


def _distinct_pairs(a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Each pair once, the lesser end first; ``more`` columns are kept by pair."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return [a[keep], b[keep], *(m[order][keep] for m in more)]


def _by_run(batches: Iterator[pa.RecordBatch], names: list[str], run_of: int, lead: Callable, piece: int = 50_000) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of whole runs (equal values of the first ``run_of`` columns), and whether the first run goes on from before.

    A very long run comes in pieces, each of which begins with the rows ``lead`` picks from the one before.
    """
    held, going = None, False
    for b in batches:
        now = [b.column(c).to_numpy() for c in names]
        if not len(now[0]):
            continue
        if held is not None:
            now = [np.concatenate(v) for v in zip(held, now)]
        other = np.flatnonzero(np.logical_or.reduce([v != v[-1] for v in now[:run_of]]))
        first = int(other[-1]) + 1 if len(other) else 0
        if first:
            yield [v[:first] for v in now], going
            going = False
        held = [v[first:] for v in now]
        if len(held[0]) > piece:
            yield held, going
            keep = lead(held)
            held, going = [v[keep] for v in held], True
    if held is not None:
        yield held, going


def _lead(c: np.ndarray) -> np.ndarray:
    """The rows of a run that the rest of it needs: its pivots and its last row."""
    other = np.flatnonzero(c != c[0])
    return np.unique(np.r_[0, other[:1], len(c) - 1])


def _candidates(records: DataFrame, percent: int, bucket: int) -> DataFrame:
    """(kind, a, b, s, x): kind 0 are pairs of classes a < b, kind 1 the records (class a, shingle s, x) of large or salted buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, k, x), going in _by_run(batches, ["key", "k", "x"], 1, lambda v: _lead(v[1])):
            new = np.r_[True, (key[1:] != key[:-1]) | (k[1:] != k[:-1])]  # copies of a class lie side by side
            key, k, x = key[new], k[new], x[new]
            size, pos, salt = _unpack(x)
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[cut, len(key)])
            big = (np.repeat(length, length) > bucket) | (salt > 0)
            if going:
                big[: length[0]] = True
            left = np.where(big, 0, np.repeat(cut + length, length) - np.arange(len(key)))
            ends = []
            for gap in range(1, bucket):
                i = np.flatnonzero(left > gap)
                if not len(i):
                    break
                ends.append((i, i + gap))
            hot = np.flatnonzero(big)
            if len(hot):
                i, j = _few_partners(np.flatnonzero(np.r_[True, key[hot][1:] != key[hot][:-1]]), k[hot])
                ends.append((hot[i], hot[j]))
            i, j = (np.concatenate([e[v] for e in ends] or [np.zeros(0, np.int64)]) for v in (0, 1))
            ok = _passes(size[i], pos[i], size[j], pos[j], percent)
            a, b = _distinct_pairs(k[i[ok]], k[j[ok]])
            m, g = len(a), len(hot)
            z = np.zeros(m, np.int64)
            with np.errstate(over="ignore"):
                s = (key[hot].view(np.uint64) - salt[hot].astype(np.uint64) * np.uint64(SALT)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.zeros(m, np.int32), np.ones(g, np.int32)]), pa.array(np.r_[a, k[hot]]), pa.array(np.r_[b, np.zeros(g, np.int64)]), pa.array(np.r_[z, s]), pa.array(np.r_[z, x[hot]])], ["kind", "a", "b", "s", "x"])

    return records.repartition("key").sortWithinPartitions("key", F.expr("shiftright(x, 8) & 268435455"), "k").mapInArrow(bounded(run), "kind int, a long, b long, s long, x long")


PAIRS = "a long, b long, ca long, cb long"


def _nominated(mixed: DataFrame, percent: int, number: int, salt_rows: int) -> DataFrame:
    """mixed (s, k, c, size, pos) -> pairs of classes of different components: each record with its bucket's pivots and the record before, salted anew in each round."""
    n = mixed.groupBy("s").agg(F.floor(F.count("*") / salt_rows).cast("int").alias("extra"))
    dealt = mixed.join(n, "s").withColumn("salt", F.pmod(F.xxhash64("k", F.lit(number)), F.col("extra") + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (s, salt, k, c, size, pos), _ in _by_run(batches, ["s", "salt", "k", "c", "size", "pos"], 2, lambda v: _lead(v[3])):
            i, j = _few_partners(np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (salt[1:] != salt[:-1])]), c)
            ok = _passes(size[i], pos[i], size[j], pos[j], percent)
            i, j = i[ok], j[ok]
            i, j = np.where(k[i] < k[j], i, j), np.where(k[i] < k[j], j, i)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in _distinct_pairs(k[i], k[j], c[i], c[j])], ["a", "b", "ca", "cb"])

    return dealt.repartition("s", "salt").sortWithinPartitions("s", "salt", "pos", "k").select("s", "salt", "k", "c", "size", "pos").mapInArrow(bounded(run), PAIRS).distinct()


def _all_across(mixed: DataFrame, percent: int, block: int) -> DataFrame:
    """mixed (s, k, c, size, pos) -> all pairs of classes of different components that share a bucket and pass the filters.

    A pair has an end outside the bucket's largest component. These *minor* records form the rows of a grid, all records its columns.
    """
    by_c = mixed.groupBy("s", "c").agg(F.count("*").alias("n"))
    sizes = by_c.groupBy("s").agg(F.sum("n").alias("n"), F.max_by("c", F.struct("n", "c")).alias("major"), F.max("n").alias("most"))
    cut = lambda n: F.ceil(n / F.lit(block)).cast("int")
    sizes = sizes.select("s", "major", cut(F.col("n")).alias("wide"), cut(F.col("n") - F.col("most")).alias("high"))
    rows = mixed.join(sizes, "s")
    own = F.xxhash64("k")
    minor = rows.filter("c <> major").select("*", F.lit(True).alias("minor"), F.pmod(own, F.col("high")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"))
    every = rows.select("*", F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), F.pmod(own, F.col("wide")).alias("j"))
    names = ["s", "i", "j", "minor", "k", "c", "size", "pos"]
    cells = minor.select(*names).unionByName(every.select(*names), allowMissingColumns=False).withColumn("i", F.col("i").cast("long")).withColumn("j", F.col("j").cast("long"))

    def compare(rows: list[np.ndarray]) -> list[np.ndarray]:
        minor, k, c, size, pos = rows
        low, all_ = np.flatnonzero(minor), np.flatnonzero(~minor)
        ends = []
        for lo in range(0, len(low), 256):
            i = low[lo : lo + 256]
            ok = (c[i][:, None] != c[all_]) & _passes(size[i][:, None], pos[i][:, None], size[all_], pos[all_], percent)
            x, y = np.nonzero(ok)
            ends.append((i[x], all_[y]))
        i, j = (np.concatenate([e[v] for e in ends] or [np.zeros(0, np.int64)]) for v in (0, 1))
        i, j = np.where(k[i] < k[j], i, j), np.where(k[i] < k[j], j, i)
        return _distinct_pairs(k[i], k[j], c[i], c[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            if not len(cols[0]):
                continue
            edge = np.flatnonzero(np.r_[True, np.logical_or.reduce([v[1:] != v[:-1] for v in cols[:3]])])
            for lo, hi in zip(edge, [*edge[1:], len(cols[0])]):
                cell = tuple(v[lo] for v in cols[:3])
                if cell != at and parts:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in compare([np.concatenate(v) for v in zip(*parts)])], ["a", "b", "ca", "cb"])
                    parts = []
                at = cell
                parts.append([v[lo:hi] for v in cols[3:]])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in compare([np.concatenate(v) for v in zip(*parts)])], ["a", "b", "ca", "cb"])

    return cells.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j").mapInArrow(bounded(run), PAIRS).distinct()


def _suffix_filter(percent: int):
    """Keeps pairs whose partition sizes allow the overlap they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sa, sb = (b.column(c).to_numpy().astype(np.int64) for c in ("sa", "sb"))
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, PARTS).astype(np.int64) for c in ("pa", "pb"))
            x, y = (np.where(v == FULL, 1 << 40, v) for v in (x, y))
            bound = np.minimum(np.minimum(x, y).sum(1), np.minimum(sa, sb))
            keep = bound >= _least_overlap(sa, sb, percent)
            names = ["a", "b", "ka", "kb", "ca", "cb"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(bound / (sa + sb - bound))], [*names, "ratio"]).filter(pa.array(keep))

    return run


def _verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int, fan: int = 512, broadcast_rows: int = 2_000_000) -> DataFrame:
    """pairs (a, b of doc_ids; ka, kb their classes) -> (a, b) with Jaccard >= percent / 100, counted exactly. b is the partner that others stream past.

    A row is used only where its text has the class that the pair names.
    """
    fans = pairs.groupBy("b", "kb").agg(F.floor(F.count("*") / fan).cast("int").alias("extra"))
    salted = pairs.join(fans, ["b", "kb"]).select("a", "b", "ka", "kb", F.pmod(F.xxhash64("ka"), F.col("extra") + 1).cast("int").alias("salt"))
    leaders = fans.select(F.lit(None).cast("long").alias("a"), "b", F.col("kb").alias("ka"), "kb", F.explode(F.sequence(F.lit(0), F.col("extra"))).alias("salt"))
    both = salted.withColumn("doc_id", F.col("a")).unionByName(leaders.withColumn("doc_id", F.col("b")))
    need = checkpoint(both)
    size, texts = need.count(), docs.filter("doc_id is not null").select("doc_id", "text")
    if size <= broadcast_rows // 10:  # some 10 MB: texts go straight to their partners
        need = F.broadcast(need)
    else:
        ids = need.select("doc_id").distinct()
        texts = texts.join(F.broadcast(ids) if size <= broadcast_rows else ids, "doc_id", "left_semi")
    rows = texts.join(need, "doc_id").select("b", "kb", "salt", F.col("a").isNotNull().alias("member"), "a", "ka", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader = None, None
        for part, raw, off in chunks(batches):
            h, d = shingle_sets(raw, off, n)
            own_class = _class_keys(h, d, len(off) - 1)[1].view(np.int64).tolist()
            cut = np.searchsorted(d, np.arange(len(off)))
            bs, kbs, salts, members, aa, kas = (part.column(c).to_pylist() for c in ("b", "kb", "salt", "member", "a", "ka"))
            out_a, out_b = [], []
            for i in range(len(bs)):
                if own_class[i] != kas[i]:  # another text of that id
                    continue
                own = h[cut[i] : cut[i + 1]]
                if not members[i]:
                    at, leader = (bs[i], kbs[i], salts[i]), own.copy()
                elif at == (bs[i], kbs[i], salts[i]) and len(own) and len(leader):
                    same = len(np.intersect1d(own, leader, assume_unique=True))
                    if 100 * same >= percent * (len(own) + len(leader) - same):
                        out_a.append(aa[i])
                        out_b.append(bs[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.repartition("b", "kb", "salt").sortWithinPartitions("b", "kb", "salt", "member").mapInArrow(bounded(run), "a long, b long")


def join_components(docs: DataFrame, n: int = 5, percent: int = 80, bucket: int = 24, salt_rows: int = 20_000, likely_rounds: int = 3, few: int = 2000, rounds: int = 3, block: int = 4096) -> DataFrame:
    """docs (doc_id, text) -> a row for each: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = checkpoint(_signatures(docs, n))
    frequency = _frequencies(signed.filter("slice is not null"))
    signed = signed.filter("slice is null").drop("slice", "payload")
    live = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = checkpoint(live.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("sizes").alias("sizes")))

    found = checkpoint(_candidates(_prefix_records(docs, n, percent, frequency, salt_rows), percent, bucket))
    named = classes.select("k1", "rep", "size", "sizes")

    def with_both(pairs: DataFrame) -> DataFrame:
        """Pairs of classes (a, b; ca, cb their components, if known) to pairs of doc_ids a > b and their classes ka, kb, after the suffix filter.

        ``ratio`` bounds their similarity from above.
        """
        x = named.select(F.col("k1").alias("a"), F.col("rep").alias("ra"), F.col("size").alias("sa"), F.col("sizes").alias("pa"))
        y = named.select(F.col("k1").alias("b"), F.col("rep").alias("rb"), F.col("size").alias("sb"), F.col("sizes").alias("pb"))
        both = pairs.join(x, "a").join(y, "b").filter("ra <> rb")
        ends = ["ca", "cb"] if "ca" in pairs.columns else [F.col("ra").alias("ca"), F.col("rb").alias("cb")]
        first = F.col("ra") > F.col("rb")
        ids = [F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("ka"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("kb")]
        return both.select(*ids, *ends, "sa", "sb", "pa", "pb").mapInArrow(bounded(_suffix_filter(percent)), "a long, b long, ka long, kb long, ca long, cb long, ratio double")

    def label(df: DataFrame, of: str, name: str) -> DataFrame:
        return df.join(labels.select(F.col("id").alias(of), F.col("component").alias("_c")), of, "left").withColumn(name, F.coalesce("_c", of)).drop("_c")

    def across(pairs: DataFrame, rows: int) -> tuple[DataFrame, int]:
        """The pairs between components, ``rows`` at most, and their number."""
        one = packed(label(pairs.select("a", "b", "ka", "kb", "ratio"), "a", "ca"), rows)
        own = checkpoint(packed(label(one, "b", "cb").filter("ca <> cb"), rows))
        count = own.count()
        return packed(own, count), count

    def link(edges: DataFrame) -> int:
        """Join the components that the edges link; the number of edges between components."""
        nonlocal labels
        edges = checkpoint(edges)
        own = edges.count()
        if own:
            labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(edges.select("a", "b")))
        return own

    def settle(pairs: DataFrame, first_by: list) -> int:
        """Link components by all pairs, the likeliest first: of each ``first_by``, then of each two components, then the rest. The number of links found."""
        count, links = pairs.count(), 0
        left = packed(pairs, count)
        for r in range(likely_rounds):
            if count <= few:
                break
            likely = left.groupBy(*(first_by if r == 0 else between)).agg(F.max_by(F.struct("a", "b", "ka", "kb"), F.struct("ratio", -F.col("b"), -F.col("a"), "ka", "kb")).alias("p")).select("p.*")
            links += link(_verify(likely, docs, n, percent))
            left, count = across(left, count)
        if count:
            links += link(_verify(left.select("a", "b", "ka", "kb"), docs, n, percent))
        return links

    between = [F.least("ca", "cb"), F.greatest("ca", "cb")]
    labels = docs.sparkSession.range(0).select("id", F.col("id").alias("component"))
    several = live.groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo <> hi").select("doc_id")
    link(live.join(several, "doc_id", "left_semi").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    settle(checkpoint(with_both(found.filter("kind = 0").select("a", "b").distinct())), ["a"])

    hot = found.filter("kind = 1").select("s", F.col("a").alias("k"), F.shiftright("x", 36).alias("size"), F.expr("shiftright(x, 8) & 268435455").alias("pos")).distinct()
    hot = hot.join(named.select(F.col("k1").alias("k"), "rep"), "k")
    for number in range(rounds + 1):
        hot = label(hot, "rep", "c")
        spread = hot.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("s")
        hot = checkpoint(hot.join(spread, "s", "left_semi"))  # a bucket of one component stays one
        if hot.isEmpty():
            break
        mixed = hot.select("s", "k", "c", "size", "pos")
        if number < rounds and settle(checkpoint(with_both(_nominated(mixed, percent, number, salt_rows))), between):
            hot = hot.drop("c")
            continue
        settle(checkpoint(with_both(_all_across(mixed, percent, block))), between)
        break
    ends = label(classes.select("k1", "k2", "rep"), "rep", "c").select("k1", "k2", "c")
    return signed.join(ends, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of docs, with all their columns, less all but the document with the least id of each group.

    Rows with a null doc_id stay; of rows that share a doc_id one stays.
    """
    found = checkpoint(join_components(docs, n, percent))
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, "doc_id", "left_anti")
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
