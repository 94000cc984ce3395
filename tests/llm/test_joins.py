"""The n-gram join, the lattice, components."""

import random

import numpy as np
import pytest

from loomspark.llm import lattice, ngramjoin
from loomspark.llm.components import components
from tests.llm import brute

DOCS = "doc_id long, text string, k long"


def test_components(spark):
    random.seed(0)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.components({x for e in links for x in e}, links)
    assert {i: got.get(i, i) for i in want} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a long, b long")).count() == 0


def test_components_of_many_tasks(spark, monkeypatch):
    from loomspark.llm import components as module

    monkeypatch.setattr(module, "ROWS_PER_TASK", 40)
    random.seed(2)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1150)] + [(5000, i) for i in range(5001, 5100)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.components({x for e in links for x in e}, links)
    assert {i: got.get(i, i) for i in want} == want


def corpus(seed):
    """Groups of edited copies, one large, a passage that many share, and odd texts."""
    random.seed(seed)
    vocab = [f"v{i}" for i in range(3000)]
    make = lambda k: random.choices(vocab, k=k)
    docs, passage = [], make(30)
    for size in [2, 3, 5, 8, 70]:
        base = make(random.randint(20, 160))
        for _ in range(size):
            w = list(base)
            for _ in range(random.randint(0, 4)):
                w[random.randrange(len(w))] = random.choice(vocab)
            docs.append(" ".join(w))
    docs += [" ".join(make(random.randint(0, 12)) + passage) for _ in range(60)] + [" ".join(make(random.randint(1, 300))) for _ in range(60)]
    docs += [None, "", " \n", "a b", "A  b", "a b c", "one", docs[0], docs[0].upper(), "x y " * 4000]
    random.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("options", [{}, {"bucket": 2, "salt_rows": 3, "block": 8}, {"bucket": 3, "likely_rounds": 0, "rounds": 0, "block": 16}, {"bucket": 2, "few": 0}])
@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, n, percent, options):
    docs = corpus(n)
    sets = {i: brute.shingles(t, n) for i, t in docs}
    ids = list(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = brute.components(ids, links)
    frame = spark.createDataFrame([(i, t, 5) for i, t in docs], DOCS).repartition(3)
    got = ngramjoin.join_components(frame, n, percent, **options).collect()
    assert len(got) == len(docs) and len({want[i] for i in want}) < len(docs) - 60
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}


def test_one_id_with_two_texts_links_both(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, 0), (5, b, 0), (5, a + " end", 0), (7, b + " more", 0), (9, "alone", 0), (5, a + " end", 0)]
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.join_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 9}


def test_string_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([("3", text), ("12", text + " x")], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in ngramjoin.join_components(rows).collect()} == {(3, 3), (12, 3)}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ngramjoin.join_components(spark.createDataFrame([("x", text)], "doc_id string, text string")).count()


def test_large_groups_cost_in_proportion(spark, monkeypatch):
    """Pairs verified for a group of edited copies grow with the group, not with its square."""
    verified = []
    verify = ngramjoin._verify

    def counted(pairs, *rest):
        verified[-1] += pairs.count()
        return verify(pairs, *rest)

    monkeypatch.setattr(ngramjoin, "_verify", counted)
    random.seed(6)
    base = [f"w{i}" for i in range(120)]
    for size in (500, 2000):
        rows = []
        for i in range(size):
            w = list(base)
            for _ in range(random.randint(0, 2)):
                w[random.randrange(len(w))] = f"x{random.randrange(10**9)}"
            rows.append((i, " ".join(w), 0))
        verified.append(0)
        got = ngramjoin.join_components(spark.createDataFrame(rows, DOCS).repartition(4))
        assert got.filter("component_id = 0").count() == size
    assert verified[1] < 8 * 2000 and verified[1] < 6 * verified[0]


def test_one_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, 1), (2, long + " end", 2), (3, "other text", 3), (3, "other text", 3), (None, long, 4), (None, None, 5), (4, None, 6)]
    out = ngramjoin.one_of_each_group(spark.createDataFrame(rows, DOCS), 5, 80)
    assert out.columns == ["doc_id", "text", "k"]
    assert sorted((str(r["doc_id"]), r["k"]) for r in out.collect()) == sorted([("1", 1), ("3", 3), ("None", 4), ("None", 5), ("4", 6)])
    assert ngramjoin.one_of_each_group(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("size", [100, 1_000_000, 100_000_000])
@pytest.mark.parametrize("dim", [64, 384])
def test_every_plan_finds_pairs_at_the_threshold(size, dim):
    """Pairs at cosine 0.9 exactly, the hardest case: they meet in a cell that one of them is a member of."""
    rng = np.random.default_rng(size % 97 + dim)
    a, b = rng.standard_normal((2, 1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    x, y = (lattice.cells(v, *lattice.plan(size)) for v in (a, b))
    met = (y == x[:, :, :1]).any((1, 2)) | (x == y[:, :, :1]).any((1, 2))
    assert met.mean() >= 0.985  # 0.99 or more in expectation


def test_nearest_point_of_e8():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 8)) * 1.5
    c = lattice.nearest_e8(y)
    twice = np.rint(2 * c).astype(int)
    assert ((twice % 2 == 0).all(1) | (twice % 2 == 1).all(1)).all() and (c.sum(1) % 2 == 0).all()
    best = ((y - c) ** 2).sum(1)
    assert (best <= 1 + 1e-9).all()
    for step in lattice.STEPS:
        assert (best <= ((y - c - step) ** 2).sum(1) + 1e-9).all()
    assert len(lattice.STEPS) == 240 and np.allclose((lattice.STEPS**2).sum(1), 2)


@pytest.mark.parametrize("options", [{}, {"most": 40}, {"params": (2, 0.26, 12, 9)}, {"params": (3, 0.30, 12, 18), "most": 300}])
def test_near_duplicates_against_brute_force(spark, options):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 64))
    vecs = [b for b in base] + [b + rng.normal(size=64) * rng.uniform(0.05, 0.45) for b in base for _ in range(2)] + [base[0] + rng.normal(size=64) * 0.1 for _ in range(90)] + [base[5] * 3] + [base[7]] * 20
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vecs)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0] + [float("inf")] * 63, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep long").repartition(3)
    got = {r["vec_id"]: r for r in lattice.near_duplicates(frame, **options).collect()}
    u = np.array([r[1] for r in rows[: len(vecs)]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    n = np.array([got[i]["n_links"] for i in range(len(vecs))])
    assert len(got) == len(rows) and (n <= close.sum(1)).all()
    assert n.sum() >= 0.99 * close.sum()
    assert [got[1000 + i]["n_links"] for i in range(8)] == [0] * 6 + [1, 1]
    want = brute.components(range(len(vecs)), zip(*np.nonzero(close)))
    found = {i: got[i]["component_id"] for i in want}
    assert all(want[c] == want[i] and c <= i for i, c in found.items())  # no component joins what isn't linked
    sizes = {c: list(found.values()).count(c) for c in set(found.values())}
    assert all((n[i] > 0) == (sizes[found[i]] > 1) and n[i] < sizes[found[i]] for i in found)
    if n.sum() == close.sum():
        assert found == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert lattice.near_duplicates(frame.limit(0)).count() == 0
