"""Ranked search against plain scoring of every document."""

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest

from loomspark.llm import wand
from tests.llm.brute import LOWER


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    want = {}
    for i, text in items:
        want.setdefault(i, set()).update(terms(text))
    out = []
    for i, own in want.items():
        scored = []
        for d, t in docs:
            m = 50 + (50 * len(t) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * t.count(x)) // (1000 * t.count(x) + 20 * m)) for x in own if x in t)
            if s > 0:
                scored.append((-s, d is None, d if d is not None else 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def ours(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=repr)


def made(n=300, seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(150)] + ["Été", "ÉTÉ", "漢字", "x1", "don't", "a-b"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rng.shuffle(weights)
    docs = [(i, rng.choice([" ", "\n", "-", ", "]).join(rng.choices(vocab, weights, k=rng.choice([0, 1, 3, 20, 200])))) for i in range(n)]
    docs += [(1000 + i, docs[i % 40][1].upper()) for i in range(80)] + [(2000, None), (2001, ""), (2002, "... !"), (None, docs[3][1]), (7, docs[9][1]), (7, docs[9][1]), (2003, "w1 w2 " * 20_000)]
    items = [(j, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 8, 40])))) for j in range(25)]
    items += [(50, None), (51, ""), (52, "unheard of"), (3, "w3 w9"), (None, "w5 w6"), (53, docs[5][1])]
    return docs, items


DOC, ITEM = "score int, doc_id long, text string, item_id string", "item_id long, text string, doc_id int"


@pytest.mark.parametrize("k,options", [(50, {}), (5, {"shard_postings": 200}), (3, {"block_terms": 60, "longest": 4}), (7, {"shard_bits": 4000, "price": 0.0})])
def test_equals_plain_scoring(spark, k, options):
    docs, items = made()
    d = spark.createDataFrame([(0, *r, "clash") for r in docs], DOC).repartition(5)
    b = spark.createDataFrame([(*r, 1) for r in items], ITEM)
    got, want = ours(wand.search(d, b, k, **options)), plain(docs, items, k)
    assert len(want) > 60 and got == want


def test_empty_tables_and_ids_of_another_type(spark):
    d, b = spark.createDataFrame([("b", "one two"), ("a", "two one"), ("c", "three"), ("e", "four")], "doc_id string, text string"), spark.createDataFrame([("i", "Two")], "item_id string, text string")
    assert [(r["doc_id"], r["rank"]) for r in wand.search(d, b).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert wand.search(d.limit(0), b).count() == 0 and wand.search(d, b.limit(0)).count() == 0
    assert wand.search(d.withColumn("text", d["text"].substr(0, 0)), b).count() == 0


def cost(impact, ends, price):
    total, lo = 0.0, 0
    for hi in ends:
        total += (hi - lo) * max(impact[lo:hi]) - sum(impact[lo:hi]) + price * (max(impact) - sum(impact) / len(impact))
        lo = hi
    return total


@pytest.mark.parametrize("seed", range(6))
def test_blocks_minimise_the_error_of_the_bounds(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 11, 5)
    impact = rng.integers(1, 50, sizes.sum())
    start = np.cumsum(sizes) - sizes
    ends = wand.cut_blocks(impact, start, sizes, price=1.5, longest=6)
    for lo, n in zip(start, sizes):
        own = [int(e - lo) for e in ends if lo < e <= lo + n]
        x = impact[lo : lo + n].tolist()
        assert own[-1] == n and max(np.diff([0, *own])) <= 6
        cuts = [[*c, n] for r in range(n) for c in combinations(range(1, n), r)]
        least = min(cost(x, c, 1.5) for c in cuts if max(np.diff([0, *c])) <= 6)
        assert cost(x, own, 1.5) == pytest.approx(least)


def test_blocks_spare_scoring():
    rng = np.random.default_rng(3)
    n = 4000
    doc, term, gain = [], [], []
    for t in range(12):
        own = np.flatnonzero(rng.random(n) < 0.3)
        doc.append(own), term.append(np.full(len(own), t)), gain.append((rng.random(len(own)) ** 8 * 1000 * (1 + (own % 500 < 20) * 5)).astype(np.int64) + 1)
    doc, term, gain = map(np.concatenate, (doc, term, gain))
    counts = {}
    _, at, score = wand.Shard(doc, term, gain, n).search([np.arange(12)], 10, counts)
    total = np.bincount(doc, gain, n).astype(np.int64)
    want = sorted(range(n), key=lambda d: (-total[d], d))[:10]
    assert sorted(at.tolist()) == sorted(want) and sorted(score.tolist()) == sorted(total[want].tolist())
    assert counts["scored"] < len(np.unique(doc)) / 2 and counts["jumps"] > 0
