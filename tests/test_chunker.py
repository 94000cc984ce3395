import random

from loomspark.operators.chunker import CEILING, TARGET, chunk_note, pack, sections

quarter = lambda x: -(-len(x) // 4)
words = lambda x: len(x.split())


def test_constants():
    assert (CEILING, TARGET) == (512, 300)


def test_sections_partition_and_parents():
    body = "intro\n# A\nx\n## B\n```\n# not\n```\n### C ###\n## D\n# E\n"
    got = list(sections(body))
    assert "".join(t for _, _, t in got) == body
    assert [(h, p) for h, p, _ in got] == [(None, None), ("A", None), ("B", "A"), ("C ###", "A > B"), ("D", "A"), ("E", None)]


def test_skipped_levels():
    assert [(h, p) for h, p, _ in sections("### x\n# y\n## z\n")] == [("x", None), ("y", None), ("z", "y")]


def test_packing_keeps_all_and_holds_the_ceiling():
    random.seed(0)
    for body in ("x" * 10_000, "word " * 2000, "A sentence. " * 900, "\n\n".join("p " * random.randint(1, 700) for _ in range(20)), "", " \n"):
        for count in (quarter, words):
            pieces = list(pack(body, count))
            assert "".join(pieces) == body
            assert all(count(p) <= CEILING for p in pieces)


def test_description_is_whole():
    chunks = chunk_note("a.md", "# H\nbody", "d " * 3000, words)
    assert chunks[0].token_count == 3000 and chunks[0].heading is None
    assert [c.chunk_id for c in chunks] == ["a.md#0", "a.md#1"] and chunks[1].heading == "H"
    assert chunk_note("a.md", "", None, words) == []
