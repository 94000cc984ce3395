"""Toxicity: a convolutional text classifier trained in numpy.

A word (a run of letters, A-Z lower-cased) is embedded by three hashed keys: itself and its first five
and seven bytes, each with a row in its own part of one table. A key's row is found by open
addressing in a table of 64-bit fingerprints, at least four slots for each key; keys that training didn't see twice
share one row. Filters of widths 1, 2 and 3 run over the word vectors, each is max-pooled over the whole
text, and a logistic layer scores the pooled values. The first column of each part starts as the log
odds of the key, the rest at random; everything is then trained by Adagrad on the logistic loss.

At scoring time a filter's response to a word is a sum of table look-ups (the embedding rows multiplied
by the filter once, after training), so a text costs gathers and maxima and no matrix product.

Thresholds are calibrated by language. A naive Bayes guess over the same word keys, learned from the
training rows' ``lang``, names the language of a text. All labelled rows but those whose text trained the
network are scored with it, whole, and counted by language, label and logit (``BINS`` bins of ``STEP``);
each label's counts are weighted to its number of all labelled rows, so the class mix is that of the
labels at every size. They set, for each language with enough of them, the logit at which toxic documents
are told apart best, and the score is shifted so that this point maps to ``THRESHOLD``. Neither labels nor
``lang`` are inputs of a score.

The network takes at most ``max_rows`` different labelled texts (half of them toxic if there are so many), drawn by a
hash of the text, so repeated ids and copies don't add to them; of a text of over
``window`` characters a stretch of that length at a place given by a hash, and it leaves out a quarter of them:
documented bounds, for the network only. Calibration and scoring read every whole text.

Defined cases: a null or empty text, or one without letters, scores as a text of no words (a constant);
without labelled rows every score is 0; a score of exactly 0.7 is toxic; repeated rows are scored one by one; null labels
are left out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lower_bytes, release_memory, span_hashes, bounded, word_spans

THRESHOLD = 0.7
BINS, STEP = 8192, 1 / 128  # of logits, around 0; the outer two take what lies beyond
WIDTHS, FILTERS, DIM = (1, 2, 3), 6, 6
PARTS = (1 << 30, 5, 7)  # how many bytes of a word each key takes


def keys(raw: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys of each word, by part, and its document."""
    low = lower_bytes(raw)
    start, end, doc = word_spans(low, off, letters=True)
    return [span_hashes(low, start, np.minimum(end, start + cut)) ^ np.uint64(cut) for cut in PARTS], doc


class Slots:
    """Row numbers of known keys by open addressing; 0 is the row of unknown keys."""

    def __init__(self, known: np.ndarray):
        """known: distinct keys; they get the rows 1, 2, ..."""
        self.bits = max(4, int(np.ceil(np.log2(4 * len(known) + 1))))
        self.print = np.zeros(1 << self.bits, np.uint64)
        self.row = np.zeros(1 << self.bits, np.int32)
        self.size, self.steps = len(known) + 1, 0
        key, row = known, np.arange(1, self.size, dtype=np.int32)
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.row[at] == 0)
            taken, first = np.unique(at[free], return_index=True)
            own = free[first]
            self.print[taken], self.row[taken] = key[own], row[own]
            left = np.ones(len(key), bool)
            left[own] = False
            key, row, at = key[left], row[left], (at[left] + 1) & ((1 << self.bits) - 1)
            self.steps += 1

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return (k >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, k: np.ndarray) -> np.ndarray:
        at = self._slot(k)
        same = self.print[at] == k
        out = np.where(same, self.row[at], 0)
        open_ = np.flatnonzero(~same & (self.row[at] > 0))
        for _ in range(self.steps):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            same = self.print[at[open_]] == k[open_]
            out[open_[same]] = self.row[at[open_[same]]]
            open_ = open_[~same & (self.row[at[open_]] > 0)]
        return out


class ToxicityModel:
    """slots, embeddings and filters by part; the logistic layer; guess of the language and its shifts."""

    def __init__(self):
        self.ready = False

    def start(self, part_keys, fit: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 3) -> list[list[np.ndarray]]:
        """Tables and first weights from the rows ``fit``; returns the table rows of each document's words, by part."""
        rng = np.random.default_rng(seed)
        self.slots, self.emb = [], []
        pos, neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
        names = sorted(set(langs))
        self.languages = names
        code = np.array([names.index(c) for c in langs])
        self.guess: list[np.ndarray] = []
        rows: list[list[np.ndarray]] = []
        for p in range(len(PARTS)):
            every = part_keys(p)
            once = [np.unique(every[i]) for i in fit]
            flat, of = np.concatenate(once), np.repeat(np.arange(len(once)), [len(o) for o in once])
            known, inv, df = np.unique(flat, return_inverse=True, return_counts=True)
            by_count = np.argsort(-df, kind="stable")
            by_count = by_count[df[by_count] >= 2]
            s = Slots(known[by_count])
            row = s(known)[inv]
            a = np.bincount(row, y[of], s.size)
            b = np.bincount(row, 1 - y[of], s.size)
            lo = np.log((a + 1) / (pos + 2)) - np.log((b + 1) / (neg + 2))
            lo[0] = 0
            sure = (a + b) / (a + b + 4)
            e = (rng.standard_normal((s.size, DIM)) * 0.05).astype(np.float32)
            e[:, 0] = np.clip(lo * sure, -3, 4)
            if p:
                self.guess.append(np.zeros((1, len(names)), np.float32))
            else:
                table = np.stack([np.bincount(row, code[of] == k, s.size) + 0.5 for k in range(len(names))], 1)
                table = np.log(table / table.sum(0))
                table[0] = 0
                self.guess.append((table - table.mean(1, keepdims=True)).astype(np.float32))
            self.slots.append(s)
            self.emb.append(e)
            rows.append([s(k).astype(np.int32) for k in every])
        d = DIM * len(PARTS)
        self.w = [(rng.standard_normal((k, d, FILTERS)) * 0.15).astype(np.float32) for k in WIDTHS]
        for k in range(len(WIDTHS)):
            for p in range(len(PARTS)):
                self.w[k][0, p * DIM, :2] = (0.8, 0.4)
        for p in range(len(PARTS)):  # one narrow filter for each part's log odds
            self.w[0][0, :, p + 2] *= 0.2
            self.w[0][0, p * DIM, p + 2] = 1.0
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.2, np.float32)
        self.bias = np.float32(-2.0)
        self.shift: dict[int, float] = {}
        self.default_shift, self.ready = 0.0, True
        return rows

    def rows(self, ks: list[np.ndarray]) -> list[np.ndarray]:
        return [s(k) for s, k in zip(self.slots, ks)]

    def forward(self, rows: list[np.ndarray], doc: np.ndarray, n: int, trace: bool = False):
        """Pooled responses (n x filters); with trace, also the position of each maximum and the word vectors."""
        x = np.hstack([e[r] for e, r in zip(self.emb, rows)])
        pooled = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        where = np.full((n, FILTERS * len(WIDTHS)), -1, np.int64)
        for k, width in enumerate(WIDTHS):
            m = len(doc) - width + 1
            if m <= 0:
                continue
            r = sum(x[o : o + m] @ self.w[k][o] for o in range(width)) + self.b[k]
            ok = np.flatnonzero(doc[:m] == doc[width - 1 :])
            self._pool(r[ok] if len(ok) < m else r, doc[ok], ok, k, pooled, where, trace)
        return (pooled, where, x) if trace else pooled

    @staticmethod
    def _pool(r, doc, position, k, pooled, where, trace):
        if not len(doc):
            return
        cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        top = np.maximum.reduceat(r, cut, axis=0)
        at = slice(k * FILTERS, (k + 1) * FILTERS)
        pooled[doc[cut], at] = np.maximum(top, 0)
        if trace:
            size = np.diff(np.r_[cut, len(doc)])
            hit = r == np.repeat(top, size, axis=0)
            for f in range(FILTERS):
                i = np.flatnonzero(hit[:, f])
                d, first = np.unique(doc[i], return_index=True)
                where[d, k * FILTERS + f] = position[i[first]]

    def step(self, rows, doc, y, weight, cache, rate):
        n = len(y)
        pooled, where, x = self.forward(rows, doc, n, trace=True)
        z = pooled @ self.out + self.bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / n
        d_pool = g[:, None] * self.out * (pooled > 0)
        updates = [("out", self.out, pooled.T @ g + 1e-4 * self.out)]
        self.bias -= np.float32(rate * g.sum() * 0.5)
        d_emb: list[tuple[np.ndarray, np.ndarray]] = []
        for k, width in enumerate(WIDTHS):
            dw, db = np.zeros_like(self.w[k]), np.zeros_like(self.b[k])
            for f in range(FILTERS):
                c = k * FILTERS + f
                live = np.flatnonzero((where[:, c] >= 0) & (d_pool[:, c] != 0))
                if not len(live):
                    continue
                gd, at = d_pool[live, c].astype(np.float32), where[live, c]
                db[f] = gd.sum()
                for o in range(width):
                    dw[o, :, f] = gd @ x[at + o]
                    d_emb.append((at + o, gd[:, None] * self.w[k][o, :, f]))
            updates += [(f"w{k}", self.w[k], dw + 1e-5 * self.w[k]), (f"b{k}", self.b[k], db)]
        for name, value, grad in updates:
            acc = cache.setdefault(name, np.full_like(value, 1e-6))
            acc += grad * grad
            value -= rate * grad / np.sqrt(acc)
        if d_emb:
            at, grad = np.concatenate([a for a, _ in d_emb]), np.concatenate([v for _, v in d_emb])
            for p in range(len(PARTS)):
                r, inv = np.unique(rows[p][at], return_inverse=True)
                sums = np.zeros((len(r), DIM), np.float32)
                np.add.at(sums, inv, grad[:, p * DIM : (p + 1) * DIM])
                acc = cache.setdefault(f"e{p}", np.full_like(self.emb[p], 1e-6))
                acc[r] += sums * sums
                self.emb[p][r] -= rate * 0.5 * sums / np.sqrt(acc[r])

    def freeze(self) -> None:
        """Responses of each key's row to each filter tap."""
        self.taps = [np.hstack([e @ self.w[k][o, p * DIM : (p + 1) * DIM] for k, width in enumerate(WIDTHS) for o in range(width)]).astype(np.float32) for p, e in enumerate(self.emb)]

    def slim(self) -> ToxicityModel:
        """What scoring needs."""
        out = copy.copy(self)
        if self.ready:
            out.emb = out.w = None
        return out

    def logits(self, rows: list[np.ndarray], doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language guess of each of n texts, from the rows of their words' keys."""
        resp = self.taps[0][rows[0]]
        for t, r in zip(self.taps[1:], rows[1:]):
            resp += t[r]
        pooled, col = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), 0
        for k, width in enumerate(WIDTHS):
            m = len(doc) - width + 1
            if m > 0:
                r = resp[:m, col : col + FILTERS] + self.b[k]
                for o in range(1, width):
                    r += resp[o : o + m, col + o * FILTERS : col + (o + 1) * FILTERS]
                ok = np.flatnonzero(doc[:m] == doc[width - 1 :])
                self._pool(r[ok], doc[ok], ok, k, pooled, None, False)
            col += width * FILTERS
        votes = np.zeros((n, len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            votes[:, k] = np.bincount(doc, self.guess[0][rows[0], k], n)[:n]
        return pooled @ self.out + self.bias, votes.argmax(1)

    def calibrate(self, counts: np.ndarray, weight: np.ndarray, least: int = 12) -> None:
        """counts (language, label, bin of the logit), weight by label -> shift of each language's logits: the cut with the best balance of missed and wrongly flagged texts."""

        def cut(own):
            clean, toxic = own * weight[:, None]
            missed, wrong = np.r_[0, np.cumsum(toxic)], clean.sum() - np.r_[0, np.cumsum(clean)]
            i = np.flatnonzero((cost := missed + 1.5 * wrong) <= cost.min() * (1 + 1e-9) + 1e-9)
            full = np.flatnonzero(clean + toxic)  # all cuts between two bins in use are one
            i = np.unique(np.searchsorted(full, i))
            k = i[len(i) // 2]
            if k == 0:
                at = full[0] - 1 / STEP
            elif k == len(full):
                at = full[-1] + 1 + 1 / STEP
            else:
                at = (full[k - 1] + 1 + full[k]) / 2
            return float((at - BINS // 2) * STEP)

        every = counts.sum(0)
        self.default_shift = cut(every) if every.sum(1).all() else 0.0
        for k, own in enumerate(counts):
            if own.sum(1).min() >= least:
                self.shift[k] = cut(own)

    def scores(self, ks: list[np.ndarray], doc: np.ndarray, n: int) -> np.ndarray:
        if not self.ready:
            return np.zeros(n)
        z, lang = self.logits(self.rows(ks), doc, n)
        at = np.array([self.shift.get(k, self.default_shift) for k in range(max(1, len(self.languages)))])[lang]
        return 1 / (1 + np.exp(-np.clip(z - at + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def held_out(order: np.ndarray) -> np.ndarray:
    """A quarter of the rows, by their hashes; none of fewer than 40."""
    return (order % 4 == 0) & (len(order) >= 40)


def train(part_keys, y: np.ndarray, langs: list[str], order: np.ndarray, epochs: int = 5, batch: int = 64, seed: int = 3) -> ToxicityModel:
    """part_keys(p): the keys of each document's words by part p, made anew at each call, so only one part is held.

    order: a hash of each document, by which a quarter doesn't train. Thresholds are not calibrated.
    """
    model = ToxicityModel()
    if not len(y):
        return model
    fit = np.flatnonzero(~held_out(order))
    rows = model.start(part_keys, fit, y[fit], [langs[i] for i in fit])
    rng, cache = np.random.default_rng(seed), {}
    lift = np.sqrt(max(1.0, (1 - y[fit]).sum() / max(1, y[fit].sum())))
    for epoch in range(epochs):
        mixed = rng.permutation(fit)
        for at in range(0, len(mixed), batch):
            b = mixed[at : at + batch]
            joined = [np.concatenate([rows[p][i] for i in b]) for p in range(len(PARTS))]
            doc = np.repeat(np.arange(len(b)), [len(rows[0][i]) for i in b])
            model.step(joined, doc, y[b], np.where(y[b] > 0, lift, 1.0), cache, 0.05 / (1 + epoch))
    model.freeze()
    return model


def bins(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(z / STEP) + BINS // 2, 0, BINS - 1).astype(np.int64)


def histogram(docs: DataFrame, rated: DataFrame, model: ToxicityModel, trained: np.ndarray, few: bool) -> tuple[np.ndarray, np.ndarray]:
    """docs (doc_id, text), rated (doc_id, toxic) -> number of rows by guessed language, label and bin of the logit, without trained texts; number of all rows by label.

    trained: hashes of texts. Texts are never shuffled: where the labels are too many to broadcast, all texts are scored and then joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.slim(), np.sort(trained)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value
        for part, raw, off in chunks(batches):
            ks, doc = keys(raw, off)
            z, lang = m.logits(m.rows(ks), doc, len(off) - 1)
            at = np.where(np.isin(part.column("t").to_numpy(), known), -1, lang * BINS + bins(z))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(at, pa.int64())], ["doc_id", "at"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    if few:
        rows = rows.join(F.broadcast(rated.select("doc_id").distinct()), "doc_id", "left_semi")
    placed = rows.mapInArrow(bounded(place), f"doc_id {kind}, at long").join(F.broadcast(rated) if few else rated, "doc_id")
    got = placed.groupBy("at", "toxic").agg(F.count("*").alias("n")).toArrow()  # at most languages x 2 x BINS rows
    shared.destroy()
    at, toxic, n = (got.column(c).to_numpy() for c in ("at", "toxic", "n"))
    counts = np.zeros((len(model.languages), 2, BINS), np.int64)
    out = at >= 0
    counts[at[out] // BINS, toxic[out], at[out] % BINS] = n[out]
    return counts, np.bincount(toxic, n, 2)


def draw(docs: DataFrame, marks: DataFrame, max_rows: int, window: int) -> tuple[DataFrame, dict[int, int]]:
    """docs (doc_id, text, lang), marks (distinct doc_id, toxic) -> (t, h, toxic, text, lang) of different texts, drawn by hash, about 1.2 times as many as wanted; the number wanted by label."""
    texts = docs.filter("text is not null").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("text").alias("t"))
    counted = texts.select("doc_id", "t").join(marks, "doc_id").groupBy("toxic").agg(F.approx_count_distinct("t", 0.02).alias("n"))
    n = {r["toxic"]: r["n"] for r in counted.collect()}
    pos = min(n.get(1, 0), max_rows // 2)
    want = {1: pos, 0: min(n.get(0, 0), max_rows - pos)}
    part = F.pmod(F.xxhash64("t", F.lit(11)), F.lit(1_000_000))
    share = {k: min(1_000_000, 1_200_000 * want[k] // max(1, n.get(k, 0)) + 1) for k in want}
    drawn = texts.filter(part < max(share.values())).join(marks, "doc_id").filter(part < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    h = F.xxhash64("t", F.lit(7))
    stretch = F.substring("text", F.pmod(h, F.greatest(F.length("text") - window, F.lit(0)) + 1).cast("int") + 1, F.lit(window))
    drawn = drawn.select(stretch.alias("text"), "lang", "toxic", h.alias("h"), "t")
    return drawn.groupBy("t", "h", "toxic").agg(F.min("text").alias("text"), F.min("lang").alias("lang")), want


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, window: int = 100_000, broadcast_rows: int = 500_000) -> ToxicityModel:
    """docs (doc_id, text, lang), labels (doc_id, toxic) -> model: the network from at most max_rows texts, the thresholds from all others."""
    rated = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    few = rated.count() <= broadcast_rows
    sample, want = draw(docs, F.broadcast(rated.distinct()) if few else rated.distinct(), max_rows, window)
    got = sample.toArrow()

    h, y = got.column("h").to_numpy(), got.column("toxic").to_numpy()
    chosen, seen, left = [], set(), dict(want)
    for i in np.lexsort((y, h)):
        text = got.column("text")[int(i)].as_py()
        if left[int(y[i])] > 0 and hash(text) not in seen:  # a copy teaches nothing
            seen.add(hash(text))
            left[int(y[i])] -= 1
            chosen.append(int(i))
    got = got.take(pa.array(chosen, pa.int64()))
    texts = got.select(["text"]).to_batches()

    def part_keys(p: int) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, raw, off in chunks(texts):
            ks, doc = keys(raw, off)
            cut = np.searchsorted(doc, np.arange(len(off)))
            out += [ks[p][cut[i] : cut[i + 1]].copy() for i in range(len(off) - 1)]
        return out

    order = h[chosen] & 0x7FFFFFFF
    model = train(part_keys, y[chosen].astype(np.float32), got.column("lang").to_pylist(), order)
    trained = got.column("t").to_numpy()[~held_out(order)] if held_out(order).any() else np.zeros(0, np.int64)
    del got, texts
    release_memory()
    if model.ready:
        counts, every = histogram(docs, rated, model, trained, few)
        model.calibrate(counts, every / np.maximum(1, counts.sum((0, 2))))
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model.slim())  # the keys of at most max_rows stretches of text: a bounded size

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, raw, off in chunks(batches):
            s = m.scores(*keys(raw, off), len(off) - 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(bounded(predict), f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model.slim())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, raw, off in chunks(batches):
            yield part.filter(pa.array(m.scores(*keys(raw, off), len(off) - 1) < threshold))

    return docs.mapInArrow(bounded(run), docs.schema)
