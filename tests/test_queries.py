import pytest

from loomspark.plans.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_chunks_equal_a_plain_loop(spark):
    from loomspark.operators.chunker import chunk_note

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(len(c.text) for r in docs for c in chunk_note(str(r["doc_id"]), r["text"], None, lambda x: -(-len(x) // 4)))
    assert sorted(r["n_chars"] for r in QUERIES["chunk_pack"](spark, SF).collect()) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_golden_item_counts(spark, tmp_path):
    """More than 1,000 items, of one word to many, are all in the reports."""
    texts = [" ".join(f"w{(i * 7 + k * k) % 997}x{i}" for k in range(9)) + f" a{i} end" for i in range(1200)]
    spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, x[3:]) for i, x in enumerate(texts)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert QUERIES["recall_at_k"](spark, str(tmp_path)).count() == 1200
    assert QUERIES["mean_recall"](spark, str(tmp_path)).first()["n_queries"] == 1200


def test_containing_equals_a_plain_loop(spark):
    from loomspark.operators.golden import containing

    words = "one two  three\tfour five six seven eight".replace("  ", " \n")
    docs = [(0, words), (1, words.upper()), (2, "x" + words + "y"), (3, ""), (4, None), (5, "two three"), (6, " one two "), (7, words + " " + words), (7, "one")]
    parts = ["one", "", "ne tw", "e two", " one two ", words, words[1:-1], "two \nthree\tfour five", " ", "eight one two", "four five six seven eight one", "ur five six seven ei", None, "absent", "o three t"]
    items = [*enumerate(parts), (5, "one"), (5, words), (5, "wo \nthree\tfo")]
    got = containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(d, i) for d, x in docs for i, p in items if x is not None and p is not None and p in x]
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(want)
