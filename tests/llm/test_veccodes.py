"""Vector codes against plain loops over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from loomspark.llm import veccodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def plain(rows, parts=8, entries=16, rounds=6):
    """rows (vec_id, vector, label) -> ({(vec_id, code, error, label_error)}, digest)."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    if not rows:
        return [], None
    vec = [[max(-(1 << 26), min(1 << 26, math.floor(4096 * float(np.float32(x))))) for x in r[1]] for r in rows]
    for v in vec:
        v += [0] * (-len(v) % parts)
    dims = len(vec[0]) // parts
    cut = [[v[p * dims : (p + 1) * dims] for p in range(parts)] for v in vec]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            chosen = {}
            for c in cut:
                chosen.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for j, own in chosen.items():
                books[p][j] = [sum(col) // len(own) for col in zip(*own)]
    got = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in g) for g in got]
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    out = [(r[0], "".join(f"{j:02x}" for _, j in g), e, by_label[r[2]]) for r, g, e in zip(rows, got, errors)]
    return sorted(out, key=repr), hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def ours(spark, rows, schema=SCHEMA, parts=8, entries=16, rounds=6, few=100_000):
    frame = spark.createDataFrame([(*r, "clash", 5) for r in rows], schema).repartition(3)
    kept, books = veccodes.fit(frame, parts, entries, rounds)
    out = veccodes.with_label_errors(veccodes.encode(kept, books), few).collect()
    return sorted(((r["vec_id"], "".join(f"{j:02x}" for j in r["code"]), r["error"], r["label_error"]) for r in out), key=repr), veccodes.digest(books) if books is not None else None


def made(n, dims, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)], rng.choice([None, 0, 1, 1, 1])) for i in range(n)]


@pytest.mark.parametrize("n,dims,few", [(150, 16, 100_000), (9, 8, 0), (60, 13, 0)])
def test_equals_plain_loops(spark, n, dims, few):
    rows = made(n, dims, n)
    assert ours(spark, rows, few=few) == plain(rows)


def test_odd_rows(spark):
    rows = made(40, 16, 3)
    rows += [(100, None, 1), (101, [1.0, None] * 8, 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] * 16, 0), (104, [], 0), (105, [1.0] * 8, 0), (7, [0.5] * 16, 0), (7, [0.5] * 16, 0), (None, [0.25] * 16, 0), (106, [3e38] * 16, 1), (107, [-3e38] * 16, 1)]
    assert ours(spark, rows) == plain(rows)
    assert ours(spark, [(1, None, 1)]) == ([], None)
    assert ours(spark, [(5, [0.1] * 8, None)] * 20)[0] == plain([(5, [0.1] * 8, None)] * 20)[0]


def test_ties_go_to_the_lower_index_and_unused_entries_stay():
    book = np.array([[0, 0], [2, 0], [2, 0], [0, 2]])
    at, far = veccodes.nearest(np.array([[1, 0], [2, 0], [1, 1], [-5, -5]]), book)
    assert at.tolist() == [0, 1, 0, 0] and far.tolist() == [1, 0, 2, 50]


def test_partial_distances_spare_work_and_change_nothing():
    rng = np.random.default_rng(0)
    book = (rng.normal(size=(16, 8)) * np.array([900, 10, 90, 3, 50, 1, 300, 2])).astype(np.int64)
    assert veccodes.spread(book)[:3].tolist() == [0, 6, 2]
    x = book[rng.integers(0, 16, 5000)] + rng.integers(-30, 30, (5000, 8))
    counts = [0, 0]
    at, far = veccodes.nearest(x, book, counts)
    full = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (far == full.min(1)).all()
    assert counts[1] == 5000 * 16 * 8 and counts[0] < counts[1] / 2


def test_decoding_gives_the_entries():
    rng = np.random.default_rng(1)
    books = rng.integers(-4096, 4096, (4, 16, 2))
    codes = rng.integers(0, 16, (30, 4))
    back = veccodes.decode(codes, books)
    assert back.shape == (30, 8) and (back[:, 2:4] * 4096 == books[1][codes[:, 1]]).all()
