"""Line deduplication against a plain version."""

import random

import pytest

from loomspark.llm import linededup
from tests.llm.brute import LOWER

SCHEMA = "n_lines string, doc_id long, text string, pos int"


def plain(rows, least_docs, least_chars):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    docs = {}
    for i, text in rows:
        for line in set(map(key, (text or "").split("\n"))):
            docs.setdefault(line, set()).add(i if i is not None else ("of", text or ""))
    common = {k for k, d in docs.items() if len(k) >= max(1, least_chars) and len(d) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((i, text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def made(n=120):
    random.seed(4)
    vocab = ["All rights reserved", " all RIGHTS reserved\t", "Ünïcode Zeile", "ünïcode Zeile", "Ünïcode zeile", "x", "", "  ", "a\rb", "\x0bpage 1\x0c", "PAGE 1", "one line", "two lines", "é"]
    rows = [(i, "\n".join(random.choices(vocab, k=random.randint(1, 9)) + [f"own {random.randint(0, 60)}"] * random.randint(0, 2))) for i in range(n)]
    rows += [(200, None), (201, ""), (202, "\n"), (3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[5][1]), (None, "one line\nof a nameless text"), (None, None)]
    rows += [(203, "\n".join(f"line {i}" if i % 3 else "x" for i in range(30_000)))]
    return rows


@pytest.mark.parametrize("least_docs,least_chars,few", [(10, 1, 500_000), (10, 1, 0), (4, 3, 500_000), (1, 1, 0), (500, 1, 0)])
def test_equals_plain_version(spark, least_docs, least_chars, few):
    rows = made()
    frame = spark.createDataFrame([("clash", i, t, 7) for i, t in rows], SCHEMA).repartition(3)
    out = linededup.dedup_lines(frame, least_docs, least_chars, broadcast_rows=few)
    assert out.columns == ["doc_id", "text", "pos", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=repr)
    assert got == plain(rows, least_docs, least_chars)


def test_a_document_that_repeats_a_line_or_an_id_counts_once(spark):
    rows = [(1, "again\nagain"), (1, "again\nother"), (2, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["n_dropped"] for r in linededup.dedup_lines(frame, least_docs=3).collect()} == {0}
    assert sorted(r["text"] for r in linededup.dedup_lines(frame, least_docs=2).collect()) == ["", "", "other"]


def test_empty_table_and_ids_of_another_type(spark):
    frame = spark.createDataFrame([], "doc_id string, text string")
    assert linededup.dedup_lines(frame).count() == 0
    frame = spark.createDataFrame([(f"d{i}", "same\nown") for i in range(12)] + [("d12", "else")], "doc_id string, text string")
    assert sorted(r["text"] for r in linededup.dedup_lines(frame).collect()) == [""] * 12 + ["else"]


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(i, "same\nown") for i in range(12)], "doc_id long, text string")
    plan = linededup.dedup_lines(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan
