"""Ranked lexical search: variable-block-max WAND over shards of postings.

Terms are the maximal runs of ASCII letters, digits and characters outside ASCII, A-Z lower-cased. With N documents
that hold a term, L terms in all, n terms in a document, df documents of a term and tf occurrences in a document, a
term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))) and a document's length counts as m = 100 - 50 + 50 * n * N div L.
A score is the sum of w * (1,000,000,000 * tf div (1000 * tf + 20 * m)) over an item's terms, once each, in integers.

Two scans of the texts: the first counts N, L and the df of the items' terms, the second makes postings with their exact
contributions and searches them. A task's documents, in the order of their ids, form shards of at most about
``shard_postings`` postings. In a shard each term's postings are cut into blocks by dynamic programming: boundaries
minimise the sum over postings of (greatest contribution of the block - own contribution), plus a price for each block
(``price`` times the mean error of the uncut list), with blocks of at most ``longest`` postings. Then all items are searched
together, document at a time, each in a lane of its own: cursors in document order give the pivot, the first
document at which the terms' greatest contributions exceed the item's k-th best score so far; the blocks that hold the pivot
bound its score better; a document that may enter is scored, otherwise the cursors jump behind the nearest end of
a block or to the next term's cursor. What is skipped can't have a score above the k-th, so the result is exact. The best k of
each shard and item meet in two steps, by item and a part of the ids first, then by item.

Scale: texts aren't shuffled. The items' terms go to all tasks; they are made on executors and counted, and beyond
``block_terms`` (item, term) rows items are searched in several blocks, each with its own two scans; so neither the driver
nor a task ever holds more than one block. What is shuffled is k rows for each shard and item.

Defined cases: null and empty texts, and texts without a term, aren't counted in N and match nothing; items without a term have
no rows; rows that repeat an item_id are one item with all their terms; rows that repeat a doc_id are documents of their
own; a null doc_id comes after all others among equal scores, a null item_id is an item; very long texts are read whole, and
a text with more postings than a shard is a shard; equal scores rank by ascending doc_id; empty tables give an empty result;
extra columns, of any name, are ignored. Terms are compared by 64-bit hashes. Scores must stay below 2^63 / 1,000.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_TABLE, bounded, checkpoint, chunks, span_hashes, word_spans

#: Bytes of terms, A-Z lower-cased; all others as a space.
TERM_TABLE = bytes(LOWER_TABLE[b] if b >= 128 or chr(b).isalnum() else 0x20 for b in range(256))


def term_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every term, in order."""
    clean = np.frombuffer(raw.tobytes().translate(TERM_TABLE), np.uint8)
    start, end, doc = word_spans(clean, off)
    return span_hashes(clean, start, end), doc


def item_terms(items: DataFrame) -> DataFrame:
    """items (item_id, text) -> (item_id, h), once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in chunks(batches):
            h, row = term_hashes(raw, off)
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(row)), pa.array(h.view(np.int64))], ["item_id", "h"])

    return items.select("item_id", "text").mapInArrow(bounded(run), f"item_id {items.schema['item_id'].dataType.simpleString()}, h long").distinct()


def _known(h: np.ndarray, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the hashes are in the sorted vocabulary, their numbers)."""
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    ok = np.flatnonzero(vocab[at] == h)
    return ok, at[ok]


def statistics(docs: DataFrame, vocab: np.ndarray) -> tuple[int, int, np.ndarray]:
    """N, L and the df of each term of the (sorted) vocabulary, over all documents."""
    words = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, total = words.value, 0, 0
        df = np.zeros(len(known), np.int64)
        for _, raw, off in chunks(batches):
            h, doc = term_hashes(raw, off)
            if len(h):
                total += len(h)
                held += 1 + np.count_nonzero(np.diff(doc))
                ok, at = _known(h, known)
                df += np.bincount(np.unique(doc[ok] * len(known) + at) % len(known), minlength=len(known))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, term]), pa.array(np.r_[held, total, df[term]])], ["term", "n"])

    got = docs.select("text").mapInArrow(bounded(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(len(vocab), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term == -1].sum()), int(n[term == -2].sum()), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


# ---------------------------------------------------------------- a shard


def cut_blocks(impact: np.ndarray, start: np.ndarray, size: np.ndarray, price: float = 8.0, longest: int = 64) -> np.ndarray:
    """Ends (exclusive, ascending) of the blocks of all lists; list i is impact[start[i] : start[i] + size[i]], and no list is empty.

    The least sum over blocks of (length * greatest + price of a block), by dynamic programming over the ends, for all
    lists at once: column w - 1 of the windows stands for a last block of w postings.
    """
    by = np.argsort(-size, kind="stable")
    start, size = start[by], size[by]
    tops, sums = np.maximum.reduceat(impact, np.sort(start)), np.add.reduceat(impact, np.sort(start))
    place = np.searchsorted(np.sort(start), start)
    cost = price * (tops[place] - sums[place] / size)
    least = np.full((len(size), longest), np.inf)  # of the postings before the last block
    least[:, 0] = 0
    top = np.zeros((len(size), longest))
    chosen = np.ones(len(impact), np.int64)  # length of the last block of the best cut that ends here
    length = np.arange(1, longest + 1)
    for t in range(int(size[0])):
        live = int(np.searchsorted(-size, -t))  # lists of more than t postings
        x = impact[start[:live] + t].astype(np.float64)[:, None]
        top[:live, 1:] = top[:live, :-1]
        top[:live, 0] = 0
        np.maximum(top[:live], x, out=top[:live])
        total = least[:live] + top[:live] * length
        w = total.argmin(1)
        chosen[start[:live] + t] = w + 1
        found = total[np.arange(live), w] + cost[:live]
        least[:live, 1:] = least[:live, :-1]
        least[:live, 0] = found
    ends, at = [], start + size
    while len(at):
        ends.append(at)
        at = at - chosen[at - 1]
        more = at > start
        at, start = at[more], start[more]
    return np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)


class Shard:
    """Postings of documents 0 .. n_docs - 1 by term, with blocks, bounds and a rank over bitmaps."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, price: float = 8.0, longest: int = 64):
        order = np.argsort(term.astype(np.int64) * n_docs + doc)
        self.doc, self.impact, self.n_docs = doc[order].astype(np.int64), impact[order], n_docs
        self.terms, self.start, size = np.unique(term[order], return_index=True, return_counts=True)
        self.end = self.start + size
        self.top = np.maximum.reduceat(self.impact, self.start)
        ends = cut_blocks(self.impact, self.start, size, price, longest)
        self.block_top = np.maximum.reduceat(self.impact, np.r_[0, ends[:-1]])
        self.block_last = self.doc[ends - 1]
        self.block = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        # a bit for each document and term, and the number of postings before each word of 64 bits
        self.words = n_docs // 64 + 1
        number = np.repeat(np.arange(len(self.terms)), size)
        self.bits = np.zeros(len(self.terms) * self.words, np.uint64)
        np.bitwise_or.at(self.bits, number * self.words + (self.doc >> 6), np.uint64(1) << (self.doc & 63).astype(np.uint64))
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)[:-1]]

    def seek(self, number: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Position of the first posting of list ``number`` at or behind ``doc`` (0 .. n_docs); the list's end if there is none."""
        word = number * self.words + (doc >> 6)
        mask = (np.uint64(1) << (doc & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.bits[word] & mask)

    def search(self, lanes: list[np.ndarray], k: int, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """lanes: the terms of each item -> (lane, document, score) of each lane's k best documents with a score above 0.

        ``counts``, if given, gets the documents scored, the jumps over blocks and the documents that match.
        """
        got = []
        known = [x[np.isin(x, self.terms)] for x in lanes]
        todo = sorted((i for i in range(len(lanes)) if len(known[i])), key=lambda i: -len(known[i]))
        while todo:
            wide = len(known[todo[0]])
            n = max(1, (1 << 15) // wide)
            own, todo = todo[:n], todo[n:]
            lane, doc, score = self._together([np.searchsorted(self.terms, known[i]) for i in own], k, counts)
            got.append((np.array(own)[lane], doc, score))
        return tuple(np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3

    def _together(self, lanes: list[np.ndarray], k: int, counts: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide, past, none = max(map(len, lanes)), self.n_docs, len(self.terms)
        number = np.full((len(lanes), wide), none)
        for i, x in enumerate(lanes):
            number[i, : len(x)] = x
        end, start, top, doc = np.r_[self.end, 0], np.r_[self.start, 0], np.r_[self.top, 0], np.r_[self.doc, past]
        impact, block = np.r_[self.impact, 0], np.r_[self.block, 0]
        cursor = np.where(number < none, doc[start[number]], past)  # documents; terms that a lane lacks are at the end
        most, column = top[number], np.arange(wide)
        best, who = np.zeros((len(lanes), k), np.int64), np.full((len(lanes), k), past)
        least = np.zeros(len(lanes), np.int64)  # the k-th best score
        lane = np.arange(len(lanes))  # lanes at work; the arrays above the loop are cut with it
        while len(lane):
            ordered = np.sort(cursor * wide + column, axis=1)
            reach = np.take_along_axis(most, ordered % wide, 1).cumsum(1) > least[lane][:, None]
            pivot = np.where(reach[:, -1], ordered[np.arange(len(lane)), reach.argmax(1)] // wide, past)
            if (over := pivot >= past).any():
                left = ~over
                lane, number, cursor, most, pivot = lane[left], number[left], cursor[left], most[left], pivot[left]
                if not len(lane):
                    break
            row, col = np.nonzero(cursor <= pivot[:, None])
            num, first = number[row, col], np.flatnonzero(np.diff(row, prepend=-1))
            at = self.seek(num, pivot[row])
            there = at < end[num]
            at[~there] = len(self.doc)
            bound = np.add.reduceat(np.where(there, self.block_top[block[at]], 0), first)
            enter = bound > least[lane]
            # where to: behind the pivot if it is scored, else behind the nearest end of a block, or to the next cursor
            until = np.minimum.reduceat(np.where(there, self.block_last[block[at]], past), first) + 1
            until = np.minimum(until, np.where(cursor > pivot[:, None], cursor, past).min(1))
            hit = doc[at] == pivot[row]
            score = np.where(enter, np.add.reduceat(np.where(hit, impact[at], 0), first), 0)
            to = np.where(enter[row], at + hit, at)
            if not enter.all():
                jump = np.flatnonzero(~enter[row])
                to[jump] = self.seek(num[jump], np.minimum(until, past)[row[jump]])
            cursor[row, col] = np.where(to < end[num], doc[np.minimum(to, len(self.doc))], past)
            if len(new := np.flatnonzero(score > least[lane])):
                r = lane[new]
                out = np.where(best[r] == least[r][:, None], who[r], -1).argmax(1)  # of the least scores the last document goes
                best[r, out], who[r, out] = score[new], pivot[new]
                least[r] = best[r].min(1)
            if counts is not None:
                counts["scored"] = counts.get("scored", 0) + int(enter.sum())
                counts["jumps"] = counts.get("jumps", 0) + int((~enter).sum())
        i, j = np.nonzero(best)
        return i, who[i, j], best[i, j]


# ---------------------------------------------------------------- the search


def _shards(batches: Iterator[pa.RecordBatch], vocab: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, shard_postings: int, shard_bits: int):
    """(ids, document, term, contribution) of one shard after the other; documents are numbered in the order of their ids."""
    parts, ids, rows, postings = [], [], 0, 0

    def close():
        id_ = pa.chunked_array(ids).combine_chunks() if len(ids) > 1 else ids[0]
        order = pc.sort_indices(id_, null_placement="at_end")
        rank = np.empty(len(id_), np.int64)
        rank[order.to_numpy()] = np.arange(len(id_))
        doc, term, gain = (np.concatenate([p[k] for p in parts]) for k in range(3))
        return id_.take(order), rank[doc], term, gain

    for part, raw, off in chunks(batches):
        h, doc = term_hashes(raw, off)
        if not len(h):
            continue
        long = np.bincount(doc, minlength=part.num_rows)
        ok, at = _known(h, vocab)
        if not len(ok):
            continue
        pair, tf = np.unique(doc[ok] * len(vocab) + at, return_counts=True)
        doc, term = pair // len(vocab), pair % len(vocab)
        m = 50 + (50 * long[doc] * n_docs) // n_terms
        gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        ok = gain > 0
        held, doc = np.unique(doc[ok], return_inverse=True)
        if not len(held):
            continue
        ids.append(part.column(0).take(pa.array(held)))
        parts.append((doc + rows, term[ok], gain[ok]))
        rows, postings = rows + len(held), postings + len(doc)
        if postings >= shard_postings or rows * min(len(vocab), postings) >= shard_bits:
            yield close()
            parts, ids, rows, postings = [], [], 0, 0
    if parts:
        yield close()


def _search_block(docs: DataFrame, pairs: pa.Table, item_type: str, k: int, shard_postings: int, shard_bits: int, price: float, longest: int) -> DataFrame:
    """pairs (item_id, h) -> item_id, doc_id, score: at least the k best of each item."""
    named = pairs["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    item, h = named.indices.to_numpy(), pairs["h"].to_numpy().view(np.uint64)
    vocab, term = np.unique(h, return_inverse=True)
    n_docs, n_terms, df = statistics(docs, vocab)
    by = np.argsort(item, kind="stable")
    lanes = np.split(term[by], np.flatnonzero(np.diff(item[by])) + 1)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, weights(n_docs, df), lanes, named.dictionary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weight, own, names = shared.value
        for ids, doc, term, gain in _shards(batches, words, weight, n_docs, n_terms, shard_postings, shard_bits):
            lane, at, score = Shard(doc, term, gain, len(ids), price, longest).search(own, k)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lane)), ids.take(pa.array(at)), pa.array(score)], ["item_id", "doc_id", "score"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(bounded(run), f"item_id {item_type}, doc_id {doc_type}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = 2_000_000, shard_postings: int = 1 << 21, shard_bits: int = 1 << 28, price: float = 8.0, longest: int = 64) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank (int, from 1), doc_id, score (long): the k best documents of each item."""
    pairs = checkpoint(item_terms(items))
    blocks = -(-pairs.count() // block_terms)
    item_type = items.schema["item_id"].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"item_id {item_type}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for b in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        if own.num_rows:
            found = found.unionByName(_search_block(docs, own, item_type, k, shard_postings, shard_bits, price, longest))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.select("item_id", "doc_id", "score", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).alias("rank"))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
