"""Sharding, decontamination, chat formatting."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomspark.llm import chatformat, decontam, sharding
from tests.llm.brute import words

DOCS = "doc_id long, text string, source string"


# ---------------------------------------------------------------- sharding


def test_shards_equal_plain_scheduling(spark):
    """End to end: the loads of one-by-one LPT over groups of equal texts; clashing names and a very long text change nothing."""
    random.seed(9)
    texts = ["t" * random.randint(0, 60) + str(random.randint(0, 9)) for _ in range(300)] + [None, None, "", "same"] * 3 + ["x" * 200_000]
    rows = [(i, t, "s", "g", 1) for i, t in enumerate(texts)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, size string, group string, shard int").repartition(3), shards=6, class_bits=40).collect()
    loads = [0] * 6
    for r in out:
        loads[r["shard"]] += r["size"]
    groups = {}
    for t in texts:
        groups[t] = groups.get(t, 0) + len(t or "") + 8
    groups[""] = groups.pop("")
    assert sorted(loads) == sorted(one_by_one(list(groups.values()), 6)) and len(out) == len(texts)



def one_by_one(sizes, shards):
    """Plain LPT: the loads that it ends with."""
    loads = [0] * shards
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return sorted(loads)


@pytest.mark.parametrize("seed", range(6))
def test_schedule_is_lpt(seed):
    random.seed(seed)
    classes = [(random.randint(1, 50), random.choice([1, 2, 3, 40, 1000])) for _ in range(random.randint(1, 30))]
    classes = list(dict(classes).items())
    shards = random.choice([1, 3, 24])
    runs = sharding.schedule(classes, shards)
    loads = [0] * shards
    for size, count in classes:
        own = sorted(r[1:] for r in runs if r[0] == size)
        at = 0
        for first, last, s in own:
            assert first == at <= last
            at = last + 1
            loads[s] += size * (last - first + 1)
        assert at == count
    plain = one_by_one([s for s, n in classes for _ in range(n)], shards)
    assert max(loads) - min(loads) <= plain[-1] - plain[0] + max(s for s, _ in classes) and sorted(loads)[-1] <= plain[-1] + max(s for s, _ in classes)


def test_shards(spark):
    random.seed(1)
    rows = [(i, random.choice([None, "", "same", "x" * random.randint(1, 300), "é" * 7]), "s") for i in range(400)] + [(7, "again", "s")] * 2
    out = sharding.shard(spark.createDataFrame(rows, DOCS), shards=5, sub_buckets=3).collect()
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((i, len((t or "").encode()) + 8) for i, t, _ in rows)
    text = dict((i, t) for i, t, _ in rows)
    home, slots = {}, {}
    for r in out:
        if r["doc_id"] != 7:
            t = text[r["doc_id"]]
            assert home.setdefault(t, r["shard"]) == r["shard"]
            assert r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


# ---------------------------------------------------------------- decontamination


def contained(docs, items, n=5, t=0.8):
    def sets(rows):
        out = {}
        for i, text in rows:
            w = words(text)
            out.setdefault(i, set()).update({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
        return out

    d, b = sets(docs), sets(items)
    return sorted((i, j, len(x & y), len(y)) for i, x in d.items() for j, y in b.items() if y and len(x & y) >= t * len(y) - 1e-9)


@pytest.mark.parametrize("few", [0, 500_000])
def test_contained_items(spark, few):
    random.seed(2)
    vocab = [f"w{i}" for i in range(400)]
    items = [(j, " ".join(random.choices(vocab, k=random.choice([1, 3, 5, 6, 20, 60])))) for j in range(30)] + [(98, None), (99, "")]
    docs = []
    for i in range(120):
        parts = random.choices(vocab, k=random.choice([0, 4, 50, 400]))
        if i % 3 == 0:
            w = items[random.randrange(30)][1].split()
            w = w[: len(w) - len(w) // 10]
            parts[len(parts) // 2 : len(parts) // 2] = w
        docs.append((i, random.choice([" ", "\t", "\n "]).join(parts).upper() if i % 2 else " ".join(parts)))
    docs += [(200, None), (201, ""), (3, docs[3][1])]
    d = spark.createDataFrame([(*r, "s") for r in docs], DOCS)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    got = decontam.contained_items(d, b, broadcast_rows=few).select("doc_id", "item_id", "n_shared", "n_item").collect()
    want = contained(docs, items)
    assert len(want) > 20 and sorted(map(tuple, got)) == want
    left = decontam.drop_contaminated(d, b)
    assert left.columns == d.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _ in docs if i not in {x[0] for x in want})
    assert decontam.contained_items(d, b.limit(0)).count() == 0 and decontam.contained_items(d.limit(0), b).count() == 0


def test_hits_needed():
    assert decontam.hits_needed(24, 0.8, 1e-7) >= 5
    assert decontam.hits_needed(3, 1.0, 1e-7) == 3


# ---------------------------------------------------------------- chat formatting

TURNS = [
    (1, 0, "user", "hi </turn> \\l \\b <part>"), (1, 1, "assistant", "a\\"), (1, 2, "assistant", "<turn:user>b"), (1, 2, "assistant", "<turn:user>b"), (1, 3, "user", None),
    (2, None, None, ""), (2, 1, "a>b", "x"), (None, 5, "assistant", "\\### Assistant: </turn> ok"), (3, 9, "user", "z" * 5000), (4, 1, "assistant", ""), (4, 2, "assistant", ""),
]


def test_chats_read_back(spark):
    frame = spark.createDataFrame([(*t, "extra") for t in TURNS], "conv_id long, turn long, role string, text string, segments string")
    chats = chatformat.format_chats(frame).withColumn("back", chatformat.read_back(F.col("formatted"))).collect()
    assert len(chats) == 5
    for c in chats:
        own = sorted(((-1 if t[1] is None else t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == c["conv_id"]))
        assert [(b["role"], b["text"]) for b in c["back"]] == [t[1:] for t in own]
        assert "".join(s["text"] for s in c["segments"]) == c["formatted"]
        loss = "".join(s["text"] for s in c["segments"] if s["loss"]).replace("\\l", "<").replace("\\b", "\\")
        assert loss == "".join(t[2] for t in own if t[1] == "assistant")
    one = next(c for c in chats if c["conv_id"] == 1)
    assert one["formatted"].count("<turn:") == 3 and one["formatted"].count("<part>") == 2
    assert chatformat.format_chats(frame.limit(0)).count() == 0


def test_null_ids_hide_no_contamination(spark):
    item = " ".join(f"i{k}" for k in range(12))
    docs = spark.createDataFrame([(None, "a " + item, "x"), (None, "clean text", "y"), (None, None, "z"), (1, item.upper() + " b", "u"), (2, "fine", "v")], "doc_id long, text string, item_id string")
    for ids in ("long", "string"):
        items = spark.createDataFrame([(None, item, 1), (None, "other item of some words here", 2)], f"item_id {ids}, text string, doc_id int")
        kept = decontam.drop_contaminated(docs, items)
        assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == ["v", "y", "z"]
        found = decontam.contained_items(docs, items).collect()
        assert sorted((r["doc_id"] or 0, r["n_shared"]) for r in found) == [(0, 8), (1, 8)] and all(r["item_id"] is None for r in found)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    items = spark.createDataFrame([("t", item)], "item_id string, text string")
    assert {r["doc_id"] for r in decontam.contained_items(named, items).collect()} == {None, "d1"}
