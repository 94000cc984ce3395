"""Batches of queries: blocks of products, batch BM25, windows of the embedder."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.operators import fusion, lexical, pivots, vector
from loomspark.operators.blocks import top_products
from loomspark.operators.embed import OnnxEmbedder


@pytest.mark.parametrize("options", [{}, {"few": 0, "left_rows": 7}, {"few": 0}])
@pytest.mark.parametrize("others", [True, False])
def test_top_products(spark, options, others):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (60, 5)).astype(float)  # many ties
    names = [f"n{i}" for i in range(60)]
    frame = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, v)], "name string, vector array<double>").repartition(3)
    got = top_products(frame.filter("name < 'n4'"), frame, 4, others, **options).collect()
    want = set()
    for i, n in enumerate(names):
        if n < "n4":
            best = sorted((-float(v[i] @ v[j]), m) for j, m in enumerate(names) if not (others and m == n))[:4]
            want |= {(n, m, -s, r + 1) for r, (s, m) in enumerate(best)}
    assert {(r["left"], r["right"], r["score"], r["rank"]) for r in got} == want
    empty = frame.filter("name = ''")
    assert top_products(empty, frame, 3, others, **options).count() == top_products(frame, empty, 3, others, **options).count() == 0


@pytest.mark.parametrize("copies", [False, True])
def test_clusters_that_can_not_give_a_partner_are_skipped(spark, copies):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    v = np.repeat(centres, 40, axis=0) + rng.normal(size=(480, 16)) * 0.02
    if copies:
        v[:200] = v[0]  # more equal rows than a part holds
    v /= np.linalg.norm(v, axis=1)[:, None]
    names = [f"n{i:03}" for i in range(480)]
    frame = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, v)], "name string, vector array<double>").repartition(3)
    counts = {}
    found = pivots.top_products(frame, frame, 5, True, 64, counts)
    w = Window.partitionBy("left").orderBy(F.desc("score"), "right")
    got = {(r["left"], r["right"]) for r in found.withColumn("r", F.row_number().over(w)).filter("r <= 5").collect()}
    exact = v @ v.T
    np.fill_diagonal(exact, -np.inf)
    score = {(r["left"], r["right"]): r["score"] for r in found.collect()}
    for i, n in enumerate(names):
        best = np.sort(exact[i])[-5:]
        assert np.allclose(sorted(score[n, m] for a, m in got if a == n), best, atol=1e-12)
    assert counts["all"] == 480 * 480 and (copies or counts["made"] < counts["all"] / 3)


def test_cosine_batch_is_cosine_leg(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{i}", rng.standard_normal(6).tolist()) for i in range(40)] + [("zero", [0.0] * 6), ("none", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<double>")
    queries = [("a", rng.standard_normal(6).tolist()), ("b", rows[3][1]), ("z", [0.0] * 6)]
    got = vector.cosine_batch(chunks, spark.createDataFrame(queries, "query_id string, vector array<double>"), 5).collect()
    for q, v in queries:
        want = fusion.ranked(vector.cosine_leg(chunks.filter("vector is not null"), v, 5)).collect()
        mine = {r["chunk_id"]: (r["rank"], r["score"]) for r in got if r["query_id"] == q}
        assert {r["chunk_id"]: r["rank"] for r in want} == {c: k for c, (k, _) in mine.items()}
        assert all(abs(mine[r["chunk_id"]][1] - r["score"]) < 1e-12 for r in want)


@pytest.mark.parametrize("batch_rows", [lexical.BATCH_ROWS, 0])
def test_bm25_batch_is_bm25_leg(spark, monkeypatch, batch_rows):
    monkeypatch.setattr(lexical, "CELLS", 40)  # many small blocks
    random.seed(3)
    words = [f"w{i}" for i in range(30)] + ["the"] * 10
    rows = [(f"c{i:03}", " ".join(random.choices(words, k=random.randint(0, 25)))) for i in range(200)] + [("copy", None), ("c900", "the the w1"), ("c901", "the the w1")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)
    post, lengths = lexical.postings(chunks), lexical.doc_lengths(chunks)
    queries = [(1, "the w1 w2 the"), (2, "w7"), (3, ""), (4, "unknown"), (5, " ".join(words)), (None, "w5 w6")]
    got = lexical.bm25_batch(post, lengths, spark.createDataFrame(queries, "query_id int, text string"), 6, batch_rows).collect()
    for q, text in queries:
        want = fusion.ranked(lexical.bm25_leg(post, lengths, text, 6)).collect()
        mine = {r["rank"]: (r["chunk_id"], round(r["score"], 9)) for r in got if r["query_id"] == q}
        if q is not None or batch_rows:
            assert mine == {r["rank"]: (r["chunk_id"], round(r["score"], 9)) for r in want}


def test_tails_of_long_texts_are_embedded(monkeypatch):
    """A session and a tokenizer of their own: the first token of a window decides its vector."""

    class Out:
        shape, name = (1, 1, 3), "input_ids"

    class Session:
        get_outputs = get_inputs = staticmethod(lambda: [Out])

        @staticmethod
        def run(_, feeds):
            assert feeds["input_ids"].shape[1] <= 512
            return [np.eye(3)[feeds["input_ids"][:, :1] % 3]]

    class Ruler:
        @staticmethod
        def encode_batch(texts):
            return [type("E", (), {"ids": [int(w) for w in t.split()]}) for t in texts]

    e = OnnxEmbedder("", "m", batch=2)
    e._loaded = Session, Ruler
    head, tail = "0 " * 512, "1 " * 512
    a, b, c, d = e.embed([head, head + tail, head + tail * 3, ""])
    assert np.allclose(a, [1, 0, 0]) and np.allclose(b, [0.5**0.5, 0.5**0.5, 0]) and c[1] > 2.9 * c[0] > 0
    assert e.embed([]).shape == (0, 3)
