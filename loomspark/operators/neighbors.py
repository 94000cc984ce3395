"""Neighbourhood of a note: breadth-first over out- and back-links, at most three levels, with a token budget.

Each level is one join of the frontier with the edges, checkpointed with its order. A target belongs to its first discoverer: out-links
of the whole frontier come before back-links, then the frontier's order, then the target's name. Hidden
targets count as visited but are neither returned nor walked through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.prefix import ranked, running_sum

MAX_DEPTH, DEFAULT_BUDGET = 3, 4000  # fixed values


def neighbors(e: DataFrame, origin: DataFrame, depth: int = 1, visible: DataFrame | None = None) -> DataFrame:
    """e (src, dst), origin (node; one row) -> node, depth, via, direction, position (discovery order in its level)."""
    both = e.select(F.col("src").alias("via"), F.col("dst").alias("node"), F.lit(0).alias("back")).unionByName(e.select(F.col("dst").alias("via"), F.col("src").alias("node"), F.lit(1).alias("back")))
    visited = origin.select("node")
    frontier = origin.select(F.col("node").alias("via"), F.lit(1).alias("at"))
    levels: list[DataFrame] = []
    for level in range(1, min(depth, MAX_DEPTH) + 1):
        reached = both.join(frontier, "via").join(visited, "node", "left_anti")
        first = Window.partitionBy("node").orderBy("back", "at", "via")
        found = reached.withColumn("n", F.row_number().over(first)).filter("n = 1").select("node", "via", "back", "at")
        visited = visited.unionByName(found.select("node"))
        if visible is not None:
            found = found.join(visible.select("node"), "node", "left_semi")
        found = ranked(found, ["back", "at", "node"], "position").withColumn("position", F.col("position").cast("int"))
        levels.append(found.select("node", F.lit(level).alias("depth"), "via", F.when(F.col("back") == 1, "back").otherwise("out").alias("direction"), "position"))
        frontier = found.select(F.col("node").alias("via"), F.col("position").alias("at"))
    if not levels:
        return origin.select("node", F.lit(0).alias("depth"), F.col("node").alias("via"), F.lit("out").alias("direction"), F.lit(0).alias("position")).limit(0)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def with_budget(found: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """found (node, depth, direction, tokens, ...) -> also rank and included; the first note over the budget shuts out all later ones."""
    back = F.when(F.col("direction") == "out", 0).otherwise(1)
    placed = ranked(found.withColumn("_back", back), ["depth", "_back", "node"])
    summed = running_sum(placed, "rank", "tokens", "_sum")
    return summed.withColumn("included", F.col("_sum") <= budget).withColumn("rank", F.col("rank").cast("int")).drop("_sum", "_back")
