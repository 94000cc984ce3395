import random

import pytest

from loomspark.operators import gaps, neighbors
from loomspark.operators.prefix import ranked, running_sum


@pytest.mark.parametrize("n,block", [(0, 10), (1, 10), (57, 100), (230, 20), (300, 5)])
def test_ranks_and_running_sums(spark, n, block):
    random.seed(n)
    rows = [(i, random.choice("ab"), random.randint(0, 9)) for i in range(n)]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "i long, k string, v long").repartition(5)
    placed = ranked(frame, ["k", "i"])
    got = running_sum(placed, "rank", "v", "upto", block).orderBy("rank").collect()
    total, want = 0, []
    for place, (i, k, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        total += v
        want.append((i, k, v, place + 1, total))
    assert [(r["i"], r["k"], r["v"], r["rank"], r["upto"]) for r in got] == want


def test_no_window_without_a_partition(spark):
    """The only ones left run over a row for each partition or block."""
    import inspect

    for module in (gaps, neighbors):
        assert "Window.orderBy" not in inspect.getsource(module)
