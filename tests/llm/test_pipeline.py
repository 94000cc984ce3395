"""The pipeline and the SQL of registered queries."""

import pytest

import corpus_pipeline
from loomspark.llm import spiece
from loomspark.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.llm import brute
from tests.llm.test_native import contained
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), connect(SF).sql(ORACLES[name]))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "ngram_join", "decontamination", "sentencepiece"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.schema.names == docs.schema.names
        step = spark.createDataFrame(step.collect(), step.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in step.collect()}
    ids = sorted(kept["language_id"])
    assert len(ids) > 0.7 * docs.count()
    sets = {i: brute.shingles(kept["language_id"][i], 5) for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = brute.components(ids, links)
    assert sorted(kept["ngram_join"]) == [i for i in ids if root[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {x[0] for x in contained(sorted(kept["ngram_join"].items()), items)}
    assert leaks and sorted(kept["decontamination"]) == sorted(set(kept["ngram_join"]) - leaks)
    coded = corpus_pipeline.STAGES[-1][1](spark, step, SF)
    assert {r["doc_id"]: r["text"] for r in spiece.decode(coded).collect()} == kept["decontamination"]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) == {"doc_id", "n_ids", "ids", "restored"} and out.filter("not restored").count() == 0 and out.count() > 100


def test_odd_rows_pass_through(spark):
    """Null ids, repeated rows, very long texts and clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.filter("lang = 'en'").orderBy("doc_id").first()["text"]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    long = " ".join(f"{w}{k}" for k, w in enumerate(text.split() * (1 + 300_000 // len(text))))
    odd = [(None, None), (None, ""), (None, text), (None, item + " " + text), (9_000_001, long), (9_000_001, long), (9_000_002, None), (9_000_003, " \n 123")]
    extra = ["size", "k1", "a", "h", "doc", "item_id", "score", "toxic"]
    names = [f"{c} string" for c in extra]
    more = spark.createDataFrame([(i, t, None, "s", len(t or ""), *extra) for i, t in odd], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(names)}")
    step = docs.unionByName(more, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == [*docs.columns, *extra]
        step = spark.createDataFrame(step.collect(), step.schema)
    left = [(r["doc_id"], len(r["text"])) for r in step.filter("size = 'size'").collect()]
    assert (9_000_001, len(long)) in left and left.count((9_000_001, len(long))) == 1
    assert {i for i, _ in left} <= {None, 9_000_001} and (None, len(text)) in left and (None, len(item + " " + text)) not in left
    coded = corpus_pipeline.STAGES[-1][1](spark, step, SF)
    assert coded.filter("not restored").count() == 0


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
