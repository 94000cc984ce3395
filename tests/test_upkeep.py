"""A stream of changes and deletions ends with the tables of a rebuild."""

import random

import pytest

from loomspark.operators import lexical
from loomspark.streaming import upkeep

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def test_changes_and_deletions_equal_a_rebuild(rocksdb, tmp_path):
    spark = rocksdb
    random.seed(8)
    words, source, seq, batches = [f"w{i}" for i in range(15)] + ["the"], tmp_path / "in", 0, []
    for _ in range(4):
        rows = []
        for _ in range(25):
            seq += 1
            rows.append((f"n{random.randint(0, 11)}", seq, " ".join(random.choices(words, k=random.randint(0, 8))) or None, random.random() < 0.25))
        rows += [rows[-1], (rows[-1][0], 1, "too late", False), (None, seq, "no name", False), ("nx", None, "no number", False)]
        batches.append(rows)
    schema = "note_path string, seq long, text string, deleted boolean"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{k}"))
    held, seen = [spark.createDataFrame([], upkeep.DELTAS)], []

    def keep(batch, _):
        new = spark.createDataFrame(batch.collect(), upkeep.DELTAS)  # a test's few rows
        seen.append(new.filter("n < 0").count())
        held[0] = spark.createDataFrame(upkeep.apply(held[0], new).collect(), upkeep.DELTAS)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    run = upkeep.deltas(stream).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert run.awaitTermination(300)
    finally:
        run.stop()
    last = {}
    for rows in batches:
        for note, number, text, deleted in rows:
            if note is not None and number is not None and number > last.get(note, (0,))[0]:
                last[note] = (number, text, deleted)
    notes = spark.createDataFrame([(n, t) for n, (_, t, gone) in last.items() if not gone], "chunk_id string, text string")
    post, lengths = upkeep.tables(held[0])
    assert sum(seen) > 5 and any(gone for _, _, gone in last.values())
    assert sorted(map(tuple, post.collect())) == sorted(map(tuple, lexical.postings(notes).collect()))
    assert sorted(map(tuple, lengths.collect())) == sorted(map(tuple, lexical.doc_lengths(notes).collect()))
