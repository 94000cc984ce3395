"""Language-model scoring with a log-frequency Bloom filter.

Tokens are words (A-Z lower-cased) and one end for each text. Counts of all unigrams and bigrams of the
training texts are aggregated exactly, by hash, and only then quantised: a count's level is the number of
thresholds 1, 2, 3, 4, 6, 8, 12, 16, 23, ... (powers of sqrt 2) that it reaches. An n-gram of level q enters the
filter q times, as (n-gram, 1) ... (n-gram, q); a look-up probes (n-gram, 1), (n-gram, 2), ... until one is
missing. The filter is cut into segments by the n-gram's hash, so each reducer makes the bits of its own
segments and no partial filters are merged. A segment has ``ENTRY_BITS`` bits an entry and there is one for about
``SEGMENT_BYTES`` of training text, so the filter grows with the distinct n-grams at every size, its rate of false
positives doesn't depend on the size, and no task or broadcast ever holds the whole.

Probabilities are smoothed and come from probes alone:

    P1(w)   = (c(w) - D) / Z for known w, D V / Z for an unknown one (absolute discounting)
    P(w|u)  = L min(c(u w), c(u), c(w)) / c(u) + (1 - L) P1(w) where u is known, else P1(w)

with c the quantised counts, V the number of distinct tokens and Z the sum of their quantised counts.

Scores need counts of every token and bigram, of which there may be more than any broadcast should hold. Blocks
of documents send their distinct tokens and bigrams to the reducer of the segment, which holds the segment's
filter for the probes and sums the tokens' exact counts for the base score. It sends both back to the block, whose
tokens travel as numbers of its distinct tokens, the frequent ones first. So texts are never shuffled, and a frequent
token or bigram costs an entry per block.

``fit`` and ``score`` do this apart, for a model that is kept or scores other texts. Where the training texts are among
those to be scored, ``fit_score`` does both in one exchange: a block sends its trained counts along with what it asks,
the segment's reducer makes the filter from them before it probes it, and each answer carries the segment's share of N,
V and Z. The filter is the same, bit by bit; texts are tokenised once, and neither counts nor filters are sent or kept
on their own.

Defined cases: a null text is empty: one token, the end; texts of any length are scored whole; doc_id is of an integer
type or a string of digits (any other is an error) and may be null; ties have no influence; repeated
rows are scored one by one; with no training text N = V = 0; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpoint, chunks, lower_bytes, mix64, span_hashes, word_spans

END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
DISCOUNT, WEIGHT, PROBES, TAIL_BYTES = 0.5, 0.3, 3, 5
BLOCK_WORDS = 1_000_000
ENTRY_BITS, SEGMENT_BYTES, TASK_SEGMENTS = 16, 1 << 25, 4
THRESHOLDS = np.unique(np.ceil(2.0 ** (np.arange(0, 120) / 2) - 1e-9))
_MIDDLE = np.r_[0.0, (THRESHOLDS[:-1] + THRESHOLDS[1:] - 1) / 2, THRESHOLDS[-1]]


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(THRESHOLDS, counts, "right")


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each token: the words of each text and its end."""
    low = lower_bytes(raw)
    start, end, doc = word_spans(low, off)
    n = len(off) - 1
    tok, of = np.empty(len(start) + n, np.uint64), np.empty(len(start) + n, np.int64)
    at = np.arange(len(start)) + doc
    ends = np.cumsum(np.bincount(doc, minlength=n)) + np.arange(n)
    tok[at], of[at] = span_hashes(low, start, end), doc
    tok[ends], of[ends] = END, np.arange(n)
    return tok, of


def contexts(tok: np.ndarray, of: np.ndarray) -> np.ndarray:
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    first = np.r_[True, of[1:] != of[:-1]]
    prev[first] = START
    return prev


def pair_hash(prev: np.ndarray, tok: np.ndarray, segment_bits: int) -> np.ndarray:
    """Hash of a bigram: the segment's bits and 8 * TAIL_BYTES more, the rest zero."""
    with np.errstate(over="ignore"):
        h = mix64(prev * np.uint64(0x9FB21C651E98DF25) + mix64(tok ^ np.uint64(0x2545F4914F6CDD1D)))
    drop = np.uint64(64 - segment_bits - 8 * TAIL_BYTES)
    return (h >> drop) << drop


def bit_positions(h: np.ndarray, j: int, size: int) -> list[np.ndarray]:
    """The PROBES positions of (n-gram, j) in its segment of ``size`` bits."""
    with np.errstate(over="ignore"):
        g = mix64(h + np.uint64(j) * np.uint64(0xD1B54A32D192ED03))
        step = (g >> np.uint64(32)) | np.uint64(1)
        return [((g + np.uint64(i) * step) % np.uint64(size)).astype(np.int64) for i in range(PROBES)]


def probed(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Level of each n-gram by repeated membership probes of its segment (packed bits)."""
    levels, alive, j = np.zeros(len(h), np.uint8), np.arange(len(h)), 1
    while len(alive) and j < len(THRESHOLDS):
        hit = np.ones(len(alive), bool)
        for p in bit_positions(h[alive], j, 8 * len(bits)):
            hit &= (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 > 0
        alive = alive[hit]
        levels[alive] = j
        j += 1
    return levels


@dataclass
class CountFilter:
    segments: DataFrame  # seg, bits (packed)
    segment_bits: int  # log2 of the number of segments
    n_tokens: int  # N, exact
    n_distinct: int  # V, exact
    z: float  # sum of the quantised unigram counts
    texts: int

    def count(self, h: np.ndarray) -> np.ndarray:
        """Quantised count of each of a few n-grams; reads their segments to the driver."""
        seg, levels = (h >> np.uint64(64 - self.segment_bits)).astype(np.int64), np.zeros(len(h), np.uint8)
        for r in self.segments.filter(F.col("seg").isin(np.unique(seg).tolist())).toLocalIterator():
            own = seg == r["seg"]
            levels[own] = probed(np.frombuffer(r["bits"], np.uint8), h[own])
        return _MIDDLE[levels]


def log_probability(c: np.ndarray, cuw: np.ndarray, of: np.ndarray, n: int, n_distinct: int, z: float, texts: int) -> np.ndarray:
    """log10 probability of each of n texts, from the quantised counts of each token and its bigram."""
    p1 = np.where(c > 0, c - DISCOUNT, DISCOUNT * n_distinct) / max(z, 1.0)
    first = np.r_[True, of[1:] != of[:-1]]
    cu = np.empty_like(c)
    cu[1:] = c[:-1]
    cu[first] = texts
    mle = np.minimum(cuw, np.minimum(cu, c)) / np.maximum(cu, 1)
    p = np.where(cu > 0, WEIGHT * mle + (1 - WEIGHT) * p1, p1)
    return np.bincount(of, np.log10(np.maximum(p, 1e-300)), n)


def _merged(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[cut], np.add.reduceat(c, cut) if len(cut) else c


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(slices, tokens, documents) of about BLOCK_WORDS tokens and fewer than 65,536 documents."""
    parts, toks, ofs, docs, words = [], [], [], 0, 0
    for part, raw, off in chunks(batches):
        m = len(off) - 1
        for lo in range(0, m, 30_000):
            o = off[lo : lo + 30_001]
            tok, of = tokens(raw[o[0] : o[-1]], o - o[0])
            if parts and (docs + len(o) - 1 > 65_000 or words + len(tok) > BLOCK_WORDS):
                yield parts, np.concatenate(toks), np.concatenate(ofs)
                parts, toks, ofs, docs, words = [], [], [], 0, 0
            parts.append(part.slice(lo, len(o) - 1))
            toks.append(tok)
            ofs.append(of + docs)
            docs, words = docs + len(o) - 1, words + len(tok)
    if parts:
        yield parts, np.concatenate(toks), np.concatenate(ofs)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(x), width], "<u4").tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    n, width = np.frombuffer(b, "<u4", 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(b[8:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _pack_hashes(h: np.ndarray, segment_bits: int, tail: int) -> bytes:
    """Sorted hashes of one segment, of which ``tail`` bits follow the segment's, as differences."""
    return _pack(np.diff((h << np.uint64(segment_bits)) >> np.uint64(64 - tail), prepend=np.uint64(0)))


def _unpack_hashes(b: bytes, segment: int, segment_bits: int, tail: int) -> np.ndarray:
    rest = np.cumsum(_unpack(b), dtype=np.uint64)
    return (np.uint64(segment) << np.uint64(64 - segment_bits)) | (rest << np.uint64(64 - segment_bits - tail))


def _by_count(seen: np.ndarray) -> np.ndarray:
    """Tokens by falling count: small numbers are frequent then, and pack well."""
    return np.argsort(-seen, kind="stable")


def segments_for(spark, size: int) -> int:
    """log2 of the number of segments for ``size`` bytes of training text."""
    return int(np.ceil(np.log2(max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), size / SEGMENT_BYTES))))


def tasks_for(spark, segment_bits: int) -> int:
    """Tasks that share the segments: ``TASK_SEGMENTS`` each at most."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << segment_bits) // TASK_SEGMENTS)


def _edges(h: np.ndarray, segment_bits: int) -> np.ndarray:
    """Where each segment begins in sorted hashes, and their number."""
    return np.searchsorted(h >> np.uint64(64 - segment_bits), np.arange((1 << segment_bits) + 1, dtype=np.uint64))


def _filter(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], entry_bits: int) -> tuple[np.ndarray, tuple[int, int, float]]:
    """Packed bits of a segment's filter and its share of N, V and Z, from the (hashes, counts) of its unigrams and bigrams."""
    entries = [(h, level(c)) for h, c in (one, two)]
    bits = np.zeros(max(1024, entry_bits * int(sum(q.sum() for _, q in entries))), bool)
    for h, q in entries:
        j = 1
        while len(h):
            for p in bit_positions(h, j, len(bits)):
                bits[p] = True
            j += 1
            h, q = h[q >= j], q[q >= j]
    return np.packbits(bits), (int(one[1].sum()), len(one[0]), float(_MIDDLE[entries[0][1]].sum()))


def _size(train: DataFrame) -> tuple[int, int]:
    """Bytes and number of the training texts."""
    size, texts = train.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), F.count("*")).first()
    return size or 0, texts


def fit(train: DataFrame) -> CountFilter:
    """train (text) -> the filter, from all rows."""
    spark = train.sparkSession
    size, texts = _size(train)
    s = segments_for(spark, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tok, of in _blocks(batches):
            for kind, h in ((1, tok), (2, pair_hash(contexts(tok, of), tok, s))):
                u, c = np.unique(h, return_counts=True)
                tail = 64 - s if kind == 1 else 8 * TAIL_BYTES
                cut = _edges(u, s)
                live = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(live.astype(np.int32)), pa.array(np.full(len(live), kind, np.int32)), pa.array([_pack_hashes(u[cut[i] : cut[i + 1]], s, tail) for i in live], pa.binary()), pa.array([_pack(c[cut[i] : cut[i + 1]]) for i in live], pa.binary())],
                    ["seg", "kind", "h", "c"],
                )

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(seg, rows):
            counted = []
            for kind in (1, 2):
                own = [r for r in rows if r[0] == kind]
                h = [_unpack_hashes(r[1], seg, s, 64 - s if kind == 1 else 8 * TAIL_BYTES) for r in own]
                counted.append(_merged(np.concatenate([*h, np.zeros(0, np.uint64)]), np.concatenate([*(_unpack(r[2]) for r in own), np.zeros(0, np.uint64)]).astype(np.int64)))
            bits, stats = _filter(*counted, ENTRY_BITS)
            return pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([bits.tobytes()], pa.binary()), *(pa.array([x], pa.float64() if i == 2 else pa.int64()) for i, x in enumerate(stats))], ["seg", "bits", "n", "v", "z"])

        at, rows = None, []
        for b in batches:
            for seg, kind, h, c in zip(b.column("seg").to_pylist(), b.column("kind").to_pylist(), b.column("h"), b.column("c")):
                if seg != at and rows:
                    yield make(at, rows)
                    rows = []
                at = seg
                rows.append((kind, h.as_py(), c.as_py()))
        if rows:
            yield make(at, rows)

    counted = train.select("text").mapInArrow(bounded(count), "seg int, kind int, h binary, c binary")
    made = checkpoint(counted.repartition(tasks_for(spark, s), "seg").sortWithinPartitions("seg").mapInArrow(bounded(reduce), "seg int, bits binary, n long, v long, z double"))
    n, v, z = made.agg(F.sum("n"), F.sum("v"), F.sum("z")).first()
    return CountFilter(made.select("seg", "bits"), s, n or 0, v or 0, z or 0.0, texts)


def score(docs: DataFrame, model: CountFilter) -> DataFrame:
    """docs (doc_id, text, trained boolean) -> doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    return _scored(docs, model.segment_bits, model.texts, model)


def fit_score(docs: DataFrame) -> DataFrame:
    """``score(docs, fit(docs.filter("trained")))``, in one exchange."""
    size, texts = _size(docs.filter("trained"))
    return _scored(docs, segments_for(docs.sparkSession, size), texts, None)


def _scored(docs: DataFrame, s: int, texts: int, model: CountFilter | None) -> DataFrame:
    """Without a model, segments make their filters from the trained texts."""
    fitting, known_totals = model is None, model and (model.n_tokens, model.n_distinct, model.z)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        names = ["seg", "block", "ids", "tokens", "seen", "at", "h", "c", "g", "d", "bits"]
        for number, (parts, tok, of) in enumerate(_blocks(batches)):
            n = sum(p.num_rows for p in parts)
            ids = np.concatenate([p.column("doc_id").cast(pa.int64()).fill_null(-(1 << 63)).to_numpy() for p in parts])
            trained = np.concatenate([p.column("trained").fill_null(False).to_numpy(zero_copy_only=False) for p in parts])
            u, at, seen = np.unique(tok, return_inverse=True, return_counts=True)
            c = np.bincount(at, trained[of], len(u))
            g, which = np.unique(pair_hash(contexts(tok, of), tok, s), return_inverse=True)
            d = np.bincount(which, trained[of], len(g)) if fitting else None
            edge, pair = _edges(u, s), _edges(g, s)
            live = np.arange(1 << s) if fitting else np.flatnonzero(np.diff(edge) + np.diff(pair))  # every segment fitted has totals to send back
            k = len(live) + 1
            where = (partition * 40_503 + number) % (1 << s)
            head = (ids.tobytes(), _pack(np.bincount(of, minlength=n)), _pack(seen), _pack(np.argsort(_by_count(seen))[at]))
            sent = ([_pack_hashes(u[edge[i] : edge[i + 1]], s, 64 - s) for i in live], [_pack(c[edge[i] : edge[i + 1]]) for i in live], [_pack_hashes(g[pair[i] : pair[i + 1]], s, 8 * TAIL_BYTES) for i in live], [_pack(d[pair[i] : pair[i + 1]]) if fitting else None for i in live])
            yield pa.RecordBatch.from_arrays(
                [pa.array([where, *live.tolist()], pa.int32()), pa.array([partition << 32 | number] * k, pa.int64())]
                + [pa.array([x, *[None] * (k - 1)], pa.binary()) for x in head]
                + [pa.array([None, *x], pa.binary()) for x in sent]
                + [pa.nulls(k, pa.binary())],
                names,
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "seg", "ids", "tokens", "seen", "at", "h", "counts", "levels", "pairs", "n", "v", "z"]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 8, pa.int64(), pa.int64(), pa.float64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)

        def trained_pairs(seg, rows):
            for _, _, _, tails, d in rows:
                c = _unpack(d).astype(np.int64)
                yield _unpack_hashes(tails, seg, s, 8 * TAIL_BYTES)[c > 0], c[c > 0]

        def groups(seg, rows):
            """Rows of about BLOCK_WORDS bigrams together: (first, end, their bigrams)."""
            lo, tails, size = 0, [], 0
            for hi, r in enumerate(rows, 1):
                tails.append(_unpack_hashes(r[3], seg, s, 8 * TAIL_BYTES))
                size += len(tails[-1])
                if size >= BLOCK_WORDS or hi == len(rows):
                    yield lo, hi, tails
                    lo, tails, size = hi, [], 0

        def make(seg, bits, rows):
            hs = [_unpack_hashes(r[1], seg, s, 64 - s) for r in rows]
            u, c = _merged(np.concatenate(hs), np.concatenate([_unpack(r[2]) for r in rows]).astype(np.int64))
            if fitting:
                bits, totals = _filter((u[c > 0], c[c > 0]), _merged(*map(np.concatenate, zip(*trained_pairs(seg, rows)))), ENTRY_BITS)
            else:
                bits, totals = np.frombuffer(bits, np.uint8) if bits is not None else np.zeros(128, np.uint8), (None, None, None)
            levels = probed(bits, u)
            for lo, hi, tails in groups(seg, rows):
                pairs = np.split(probed(bits, np.concatenate(tails)), np.cumsum([len(x) for x in tails])[:-1])
                own = [np.searchsorted(u, h) for h in hs[lo:hi]]
                yield batch([(r[0], seg, *[None] * 4, r[1], _pack(c[o]), _pack(levels[o]), _pack(p), *totals) for r, o, p in zip(rows[lo:hi], own, pairs)])

        at, bits, rows = None, None, []
        for b in batches:
            for r in zip(*(b.column(c) for c in ("seg", "block", "h", "c", "g", "d", "bits", "ids", "tokens", "seen", "at"))):
                seg, block, h, c, g, d, own = (x.as_py() for x in r[:7])
                if h is None and own is None:
                    yield batch([(block, None, *(x.as_py() for x in r[7:]), *[None] * 7)])
                    continue
                if seg != at:
                    if rows:
                        yield from make(at, bits, rows)
                    at, bits, rows = seg, None, []
                if own is not None:  # comes first
                    bits = own
                else:
                    rows.append((block, h, c, g, d))
        if rows:
            yield from make(at, bits, rows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(rows):
            head = next(r for r in rows if r["ids"] is not None)
            ids, n_tokens, seen = np.frombuffer(head["ids"], "<i8"), _unpack(head["tokens"]).astype(np.int64), _unpack(head["seen"]).astype(np.int64)
            at = _by_count(seen)[_unpack(head["at"]).astype(np.int64)]
            n = len(ids)
            of = np.repeat(np.arange(n), n_tokens)
            rows = sorted((r for r in rows if r["ids"] is None), key=lambda r: r["seg"])
            n_train, n_distinct, z = (sum(r[c] for r in rows) for c in ("n", "v", "z")) if fitting else known_totals
            words = np.concatenate([_unpack_hashes(r["h"], r["seg"], s, 64 - s) for r in rows])
            counts, levels, pairs = (np.concatenate([_unpack(r[c]) for r in rows]).astype(np.int64) for c in ("counts", "levels", "pairs"))
            tok = words[at]
            _, pair = np.unique(pair_hash(contexts(tok, of), tok, s), return_inverse=True)
            sums = np.bincount(of, np.log10(counts + 1.0)[at], n)
            known = np.bincount(of, (counts > 0)[at], n).astype(np.int64)
            scores = log_probability(_MIDDLE[levels][at], _MIDDLE[pairs][pair], of, n, n_distinct, z, texts) if n_train else np.zeros(n)
            doc = pa.array(ids, mask=ids == -(1 << 63))
            return pa.RecordBatch.from_arrays([doc, pa.array(n_tokens), pa.array(known), pa.array(np.full(n, n_train, np.int64)), pa.array(sums - n_tokens * np.log10(n_train + n_distinct + 1)), pa.array(scores)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        at, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["block"] != at and rows:
                    yield make(rows)
                    rows = []
                at = r["block"]
                rows.append(r)
        if rows:
            yield make(rows)

    asked = docs.select("doc_id", "text", "trained").mapInArrow(bounded(ask), "seg int, block long, ids binary, tokens binary, seen binary, at binary, h binary, c binary, g binary, d binary, bits binary")
    if model:
        asked = asked.unionByName(model.segments, allowMissingColumns=True)
    answered = asked.repartition(tasks_for(docs.sparkSession, s), "seg").sortWithinPartitions("seg", F.col("bits").isNull()).mapInArrow(bounded(answer), "block long, seg int, ids binary, tokens binary, seen binary, at binary, h binary, counts binary, levels binary, pairs binary, n long, v long, z double")
    return answered.repartition("block").sortWithinPartitions("block").mapInArrow(bounded(finish), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
