"""The bucketed store: what a change writes, commits of two writers, new numbers of buckets, block postings."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.engine import Engine
from loomspark.operators import blockmax, fusion, lexical
from loomspark.plans import index
from loomspark.policy import Policy
from loomspark.sources.hadoop import Folder
from loomspark.sources.store import TABLES, ConcurrentCommitError


def held(store, now):
    return {p for t in TABLES for p in store.files(t, now)}


def rows(store, spark, name, now=None):
    frame = store.read(spark, name, now)
    return sorted(map(str, (blockmax.flat(frame) if name == "postings" else frame).collect()))


def test_one_change_of_many_notes_writes_few_files(spark, vault):
    random.seed(1)
    words = [f"word{i}" for i in range(300)]
    notes = {f"d{i % 20}/n{i}.md": " ".join(random.choices(words, k=20)) + f" [[n{(i * 7) % 1000}]]" for i in range(1000)}
    root = vault(notes)
    engine = Engine(spark, Policy.for_vault(root))
    assert engine.index().added == 1000
    first = engine.store.current()
    texts = rows(engine.store, spark, "note_text", first)
    (root / "d3/n3.md").write_text("another text altogether")
    assert engine.index().updated == 1
    second = engine.store.current()
    a, b = held(engine.store, first), held(engine.store, second)
    assert len(a & b) > 0.9 * len(b) and len(b - a) == len(TABLES)
    assert rows(engine.store, spark, "note_text", first) == texts  # a reader of the old snapshot
    fresh = Engine(spark, Policy.for_vault(root, root / ".other"))
    fresh.index()
    for name in TABLES:
        assert rows(engine.store, spark, name) == rows(fresh.store, spark, name), name
    assert engine.store.statistics(second) == fresh.store.statistics(fresh.store.current())
    (root / "d3/n3.md").unlink()
    assert engine.index().removed == 1
    assert engine.store.versions() == [2, 3]  # the oldest is gone, with the files that only it named
    folder, kept = engine.store.folder(), held(engine.store, second) | held(engine.store, engine.store.current())
    assert {p for p, *_ in folder.files("data")} == kept
    assert engine.status()["state"] == "ready"


def test_two_writers_and_new_buckets(spark, vault):
    root = vault({f"n{i}.md": f"text {i} of note " * (i + 1) for i in range(12)})
    engine = Engine(spark, Policy.for_vault(root))
    engine.index()
    store, base = engine.store, engine.store.current()
    late = store.begin(spark, base, base["buckets"])
    (root / "n1.md").write_text("changed")
    engine.index()
    late.write("notes", store.read(spark, "notes", base).limit(0).withColumn("bucket", F.lit(0)), {0})
    with pytest.raises(ConcurrentCommitError):
        late.commit(engine.embedder.identity)
    assert store.current()["version"] == 2 and engine.status()["state"] == "ready"
    before = {name: rows(store, spark, name) for name in TABLES}
    (root / "new.md").write_text("a new note")
    index.refresh(spark, engine.policy, store, engine.embedder, bucket_bytes=15)
    assert store.current()["buckets"] > 4 * base["buckets"]
    assert set(before["notes"]) < set(rows(store, spark, "notes")) and engine.status()["state"] == "ready"
    (root / "new.md").unlink()
    engine.index()
    assert {name: rows(store, spark, name) for name in TABLES} == before


def test_edges_are_mended_as_a_rebuild_makes_them(spark, vault, monkeypatch):
    """Names that become ambiguous, single again, or an alias; edges of the vault as it is, and of the index after it has caught up."""
    random.seed(6)
    notes = {f"d{i % 3}/n{i}.md": f"---\naliases: [al{i % 9}]\n---\n" + " ".join(f"[[{random.choice(['n', 'al'])}{random.randint(0, 24)}]]" for _ in range(4)) for i in range(20)}
    root = vault(notes)
    engine = Engine(spark, Policy.for_vault(root))
    engine.index()
    changes = [
        {"d9/n3.md": "[[n4]]", "d0/n0.md": None},
        {"d9/n3.md": None, "d1/n1.md": "---\naliases: [al3, n24]\n---\n[[al3]] [[n5]]", "d2/n2.md": "no links"},
        {"d9/n7.md": "[[d9/n7]] [[al0]]", "x.md": "---\naliases: [n24]\n---\n"},
    ]
    pairs = lambda frame: sorted((r["src"], r["dst"]) for r in frame.collect())
    for k, change in enumerate(changes):
        for path, text in change.items():
            (root / path).parent.mkdir(exist_ok=True)
            (root / path).unlink() if text is None else (root / path).write_text(text)
        whole = Engine(spark, Policy.for_vault(root, root / f".none{k}"))  # no index: everything is read
        want = pairs(whole.edges())
        read = []
        monkeypatch.setattr(index, "contents", lambda notes, policy, of=index.contents: read.append(notes.count()) or of(notes, policy))
        assert pairs(engine.edges()) == want
        monkeypatch.undo()
        assert read == [sum(t is not None for t in change.values())]  # only what is new is read
        engine.index()
        held = engine.store.read(spark, "edges")
        assert pairs(held.select(held["note_path"].alias("src"), "dst").distinct()) == want == pairs(engine.edges())


def test_put_if_absent(spark, tmp_path):
    folder = Folder(spark, tmp_path / "x y")
    assert folder.names() == [] and folder.put_if_absent("a/one", "first")
    assert not folder.put_if_absent("a/one", "second") and folder.read("a/one") == "first" and folder.names("a") == ["one"]
    folder.delete("a")
    assert not folder.exists("a/one")


QUERIES = ["the w1 w2 the", "w7", "", "unknown", "w1 w3 w5 w7 w9 w11 w13", "the"]


@pytest.mark.parametrize("span,first", [(128, None), (4, 1), (1, 3)])
def test_blocks_find_what_the_leg_finds(spark, span, first):
    random.seed(3)
    words = [f"w{i}" for i in range(30)] + ["the"] * 10
    data = [(f"c{i:03}", " ".join(random.choices(words, k=random.randint(0, 25)))) for i in range(200)] + [("copy", None), ("c900", "the the w1"), ("c901", "the the w1")]
    chunks = spark.createDataFrame(data, "chunk_id string, text string").repartition(3).withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(3)).cast("int"))
    blocks = blockmax.block_postings(chunks, span).cache()
    post, lengths = lexical.postings(chunks), lexical.doc_lengths(chunks)
    assert sorted(map(tuple, blockmax.flat(blocks).select("term", "chunk_id", "tf").collect())) == sorted(map(tuple, post.collect()))
    n, avg = lexical.doc_stats(lengths).first()
    for q in QUERIES:
        want = fusion.ranked(lexical.bm25_leg(post, lengths, q, 7)).collect()
        got = fusion.ranked(blockmax.top_chunks(blocks, n, avg, q, 7, first)).collect()
        assert [(r["chunk_id"], r["rank"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(r["chunk_id"], r["rank"], r["score"]) for r in sorted(want, key=lambda r: r["rank"])]
    blocks.unpersist()


def test_blocks_are_skipped(spark):
    random.seed(5)
    data = [(f"c{i:04}", "rare " * (9 if i % 97 == 0 else 1) + "common " + " ".join(["pad"] * random.randint(5, 400))) for i in range(3000)]
    chunks = spark.createDataFrame(data, "chunk_id string, text string").withColumn("bucket", F.lit(0))
    blocks = blockmax.block_postings(chunks, 32).cache()
    n, avg = lexical.doc_stats(lexical.doc_lengths(chunks)).first()
    read, all_ = blockmax.count_blocks(blocks, n, avg, "rare common", 10)
    assert all_ == 2 * -(-3000 // 32) and read < all_ / 3
    blocks.unpersist()
