import pytest

from loomspark.operators import gaps, graph, neighbors


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p.split(">")) for p in pairs], "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


CHAIN = ("origin>hop1", "hop1>hop2", "hop2>hop3", "hop3>hop4", "backlinker>origin", "hop1>personal/secret", "personal/secret>downstream")


def test_walk_order(spark):
    found = neighbors.neighbors(edges(spark, *CHAIN), nodes(spark, "origin"), 9).collect()
    assert max(r["depth"] for r in found) == 3
    order = [r["node"] for r in sorted(found, key=lambda r: (r["depth"], r["direction"] == "back", r["node"]))]
    assert order == ["hop1", "backlinker", "hop2", "personal/secret", "downstream", "hop3"]
    assert {r["node"]: r["via"] for r in found}["downstream"] == "personal/secret"


def test_hidden_notes_stop_the_walk(spark):
    seen = nodes(spark, "hop1", "hop2", "hop3", "backlinker", "downstream")
    found = {r["node"] for r in neighbors.neighbors(edges(spark, *CHAIN), nodes(spark, "origin"), 3, seen).collect()}
    assert found == {"hop1", "backlinker", "hop2", "hop3"}
    assert neighbors.neighbors(edges(spark, *CHAIN), nodes(spark, "origin"), 0).count() == 0


def test_budget_is_sticky(spark):
    rows = [("a", 1, "out", 5), ("b", 1, "out", 90), ("c", 1, "back", 1), ("d", 2, "out", 0)]
    got = neighbors.with_budget(spark.createDataFrame(rows, "node string, depth int, direction string, tokens int"), 50).orderBy("rank").collect()
    assert [(r["node"], r["included"]) for r in got] == [("a", True), ("b", False), ("c", False), ("d", False)]
    zero = neighbors.with_budget(spark.createDataFrame([("z", 1, "out", 0)], "node string, depth int, direction string, tokens int"), 0)
    assert zero.first()["included"]


def test_degrees(spark):
    got = graph.degrees(nodes(spark, "a", "b", "c", "lone"), edges(spark, "a>b", "b>a", "c>c", "a>c"))
    assert {r["node"]: r["degree"] for r in got.collect()} == {"a": 2, "b": 1, "c": 3, "lone": 0}


def test_links(spark):
    notes = [
        ("brain/target.md", "", ["Friendly"]),
        ("a.md", "[[target]] [[brain/target#top|t]] [[Friendly]] [[a]] [[none]]", []),
        ("x/dup.md", "", []),
        ("y/dup.md", "[[dup]] [[x/dup.md]]", []),
    ]
    got = graph.edges(spark.createDataFrame(notes, "note_path string, text string, aliases array<string>")).collect()
    assert sorted(map(tuple, got)) == [("a.md", "brain/target.md"), ("y/dup.md", "x/dup.md")]


SIMILAR = [
    ("lo", "lo_partner", 0.60), ("below", "below_partner", 0.59), ("hi", "hi_partner", 0.92), ("above", "above_partner", 0.93),
    ("linkA", "linkB", 0.75), ("linkB", "linkA", 0.75), ("hubn", "hubpartner", 0.85), ("nonhub_x", "nonhub_y", 0.65),
    ("same/one", "same/two", 0.70), ("same/three", "other/four", 0.70), ("dup_p", "dup_q", 0.70), ("dup_q", "dup_p", 0.75),
    ("dismiss_d1", "dismiss_d2", 0.75), ("selfsim", "selfsim", 0.80), ("tie_b", "tie_a", 0.70), ("tie_a", "tie_b", 0.70),
]


def test_gaps_table(spark):
    names = sorted({n for a, b, _ in SIMILAR for n in (a, b)})
    e = edges(spark, "linkA>linkB", "hubn>hubn")
    dismissed = spark.createDataFrame([("weaklink|dismiss_d1|dismiss_d2",)], "sig string")
    got = gaps.rank_pairs(spark.createDataFrame(SIMILAR, "note string, other string, score double"), e, graph.degrees(nodes(spark, *names), e), dismissed, hub_degree=2).orderBy("rank").collect()
    assert [(r["a"], r["b"], r["score"]) for r in got] == [
        ("same/three", "other/four", 0.70), ("hi", "hi_partner", 0.92), ("dup_q", "dup_p", 0.75), ("same/one", "same/two", 0.70),
        ("tie_a", "tie_b", 0.70), ("nonhub_x", "nonhub_y", 0.65), ("lo", "lo_partner", 0.60), ("hubn", "hubpartner", 0.85),
    ]


@pytest.mark.parametrize("k", [2.675, 0.12345, 1e-9, 0.99995])
def test_round4(spark, k):
    from loomspark.functions.scalar import round4

    assert spark.createDataFrame([(k,)], "x double").select(round4("x").alias("r")).first()["r"] == round(k, 4)
