"""Steps that must grow no faster than the input: their plans and the sizes of their parts."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from loomspark.functions import text
from loomspark.operators import blockmax, fusion, golden, lexical
from loomspark.plans import corpus
from loomspark.plans.queries import QUERIES
from tests.conftest import SF


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_block_postings_shuffle_texts_once_and_aggregate_nothing(spark):
    """postings were exploded and grouped twice, in rows of their own."""
    rows = spark.createDataFrame([(f"c{i}", "the w1 w2 the" if i % 3 else None) for i in range(300)], "chunk_id string, text string").withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(3)).cast("int"))
    plan = _plan(blockmax.block_postings(rows, 16))
    assert plan.count("Exchange") == 1 and not re.search("Aggregate|Generate|Window", plan)


def test_index_has_parts_of_a_bounded_size(spark):
    """buckets met in the partitions of the session (4 here), however many there were."""
    chunks = spark.createDataFrame([(f"c{i}", f"w{i % 7} the") for i in range(2000)], "chunk_id string, text string")
    folder, n, terms = corpus._build(spark, chunks, 40)
    blocks = spark.read.parquet(f"{folder}/postings")
    assert (n, terms) == (2000, 4000) and len(blocks.inputFiles()) == 40
    assert blocks.agg(F.sum("n")).first()[0] == 4000 and blocks.agg(F.max("n")).first()[0] <= blockmax.SPAN


def test_bm25_texts_is_bm25_leg_without_a_shuffle_of_postings(spark, monkeypatch):
    """postings of all texts were grouped, shuffled and kept."""
    monkeypatch.setattr(lexical, "CELLS", 40)  # many small blocks
    random.seed(3)
    words = [f"w{i}" for i in range(30)] + ["the"] * 10
    rows = [(f"c{i:03}", " ".join(random.choices(words, k=random.randint(0, 25)))) for i in range(200)] + [("copy", None), ("c900", "the the w1"), ("c901", "the the w1")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)
    post, lengths = lexical.postings(chunks), lexical.doc_lengths(chunks)
    queries = [(1, "the w1 w2 the"), (2, "w7"), (3, ""), (4, "unknown"), (5, " ".join(words)), (None, "w5 w6")]
    asked = spark.createDataFrame(queries, "query_id int, text string")
    found = lexical.bm25_texts(chunks, asked, 6)
    assert "Aggregate" not in _plan(found) and "InMemory" not in _plan(found)
    got = found.collect()
    for q, words in queries:
        want = fusion.ranked(lexical.bm25_leg(post, lengths, words, 6)).collect()
        assert {r["rank"]: (r["chunk_id"], round(r["score"], 9)) for r in got if r["query_id"] == q} == {r["rank"]: (r["chunk_id"], round(r["score"], 9)) for r in want}
    assert lexical.bm25_texts(chunks.limit(0), asked, 6).count() == lexical.bm25_texts(chunks, asked.limit(0), 6).count() == 0


def test_containing_seeks_in_one_scan(spark):
    """texts were shuffled to meet the items found in them; runs were exploded."""
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "b c d e f g x"), (2, "a b c d e f g h i"), (3, None), (4, "a b  c"), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([("p", "a b c d e f g h"), ("q", "b c d"), ("q", "a b  c"), ("q", "a b  c"), ("r", "b c d e f g x")], "item_id string, text string")
    found = golden.containing(docs, items)
    assert not re.search("hashpartitioning|SortMergeJoin|Generate", _plan(found))
    want = [(1, "p"), (1, "q"), (2, "p"), (2, "q"), (2, "q"), (2, "r"), (4, "q"), (4, "q")]
    assert sorted(map(tuple, found.collect())) == want == sorted(map(tuple, golden.containing(docs, items, broadcast_rows=0).collect()))


def test_notes_are_handled_by_one_python_process_a_task_and_text_by_text(spark, monkeypatch):
    """F6, F8: bodies went through two Python processes for each task, in batches of Python strings."""
    for name in ("rendered_notes", "fence_defects"):
        assert _plan(QUERIES[name](spark, SF)).count("ArrowEvalPython") == 1
    monkeypatch.setattr(text, "PIECE", 2)
    notes = ["---\ntags: x\n---\n# a *b*", "```\nopen", None, "", "---\na: [\n---\nx"]
    made = lambda udf: udf.func(pa.array(notes)).to_pylist()
    assert made(text.render_note_udf) == ["a b", "```\nopen", "", "", "---\na: [\n---\nx"]
    assert made(text.note_defect_udf) == [None, 1, None, None, None]
    assert made(text.parse_note_udf)[0] == {"description": None, "tags": ["x"], "aliases": [], "body": "# a *b*", "error": None}
    assert len(text.parse_note_udf.func(pa.array([], pa.string()))) == 0


def test_evaluation_reads_the_golden_set_once(spark):
    """what is expected, a scan of all texts, was worked out a second time for its ``k``."""
    asked = spark.range(2).selectExpr("cast(id as string) query", "array('a', 'b', 'c') expect", "2 k")
    got = spark.createDataFrame([("0", "b", 1), ("0", "x", 2), ("0", "a", 3)], "query string, note_path string, rank int")
    rows = golden.evaluate(asked, got)
    assert _plan(rows).count("Range (") == 1
    assert sorted((r["query"], round(r["recall"], 3), r["found"], r["missed"]) for r in rows.collect()) == [("0", 0.333, ["b"], ["a", "c"]), ("1", 0.0, [], ["a", "b", "c"])]
