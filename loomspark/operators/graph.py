"""The link graph: extraction and resolution of wikilinks, edges, degrees, hubs.

Resolution (assumptions where the original rules aren't public): a link's target loses its alias, heading
and block parts, and a ``.md``; it names a note by path, else by stem, else by alias, in exact case; at the
first of these with candidates, more than one candidate means no edge. Hidden or excluded notes must be
filtered out before, so that they can't make a name ambiguous.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"


def links(notes: DataFrame) -> DataFrame:
    """notes (note_path, text) -> src, target: distinct link targets, bare."""
    raw = notes.select(F.col("note_path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(TARGET), F.lit(1))).alias("t"))
    bare = F.regexp_replace(F.trim(F.regexp_replace("t", r"[#^].*$", "")), r"\.md$", "")
    return raw.select("src", bare.alias("target")).filter("target <> ''").distinct()


def catalog(notes: DataFrame) -> DataFrame:
    """notes (note_path, aliases) -> name, note_path, tier (0 path, 1 stem, 2 alias)."""
    bare = F.regexp_replace("note_path", r"(?i)\.md$", "")
    own = notes.select("note_path", F.array(F.struct(bare.alias("name"), F.lit(0).alias("tier")), F.struct(F.element_at(F.split(bare, "/"), -1).alias("name"), F.lit(1).alias("tier"))).alias("n"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    names = own.select("note_path", F.explode(F.concat("n", F.transform("aliases", lambda a: F.struct(a.alias("name"), F.lit(2).alias("tier"))))).alias("x"))
    return names.select("x.name", "note_path", "x.tier").distinct()


def resolved_names(cat: DataFrame) -> DataFrame:
    """name, note_path for names that stand for one note at their first tier."""
    tiers = cat.groupBy("name", "tier").agg(F.count("*").alias("n"), F.min("note_path").alias("note_path"))
    return tiers.groupBy("name").agg(F.min_by(F.struct("n", "note_path"), "tier").alias("x")).filter("x.n = 1").select("name", "x.note_path")


def ambiguous_names(cat: DataFrame) -> DataFrame:
    """name, n_notes for names whose first tier has several notes."""
    tiers = cat.groupBy("name", "tier").agg(F.count("*").alias("n"))
    return tiers.groupBy("name").agg(F.min_by("n", "tier").alias("n_notes")).filter("n_notes > 1")


def edges(notes: DataFrame) -> DataFrame:
    """notes (note_path, text, aliases) -> src, dst: distinct, without self-links."""
    names = resolved_names(catalog(notes))
    hit = links(notes).join(names, F.col("target") == F.col("name")).select("src", F.col("note_path").alias("dst"))
    return hit.filter("src <> dst").distinct()


def name_changes(names: DataFrame, gone: DataFrame, new_names: DataFrame) -> DataFrame:
    """names, new_names (name, note_path, tier), gone (note_path) -> name, dst: the names that stand for another note, or for none (null), when the
    names of gone notes are replaced by the new ones. Only names of these notes are looked at."""
    asked = names.join(gone, "note_path", "left_semi").select("name").unionByName(new_names.select("name")).distinct()
    held = names.join(asked, "name", "left_semi")
    before = resolved_names(held).select("name", F.col("note_path").alias("was"))
    after = resolved_names(held.join(gone, "note_path", "left_anti").unionByName(new_names)).select("name", F.col("note_path").alias("dst"))
    return before.join(after, "name", "full_outer").filter(~F.col("was").eqNullSafe(F.col("dst"))).select("name", "dst")


def mended_edges(old: DataFrame, old_links: DataFrame, names: DataFrame, gone: DataFrame, new_links: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges (src, target, dst) after a change, from those before it: only links of new notes, and links to changed names, are resolved.

    old (src, target, dst), old_links, new_links (src, target), names (name, note_path, tier; as they are after the change), gone (note_path: removed and
    changed notes), changed (as ``name_changes`` gives it).
    """
    left = gone.select(F.col("note_path").alias("src"))
    kept = old.join(left, "src", "left_anti").join(changed.select(F.col("name").alias("target")), "target", "left_anti")
    moved = old_links.join(left, "src", "left_anti").join(changed.select(F.col("name").alias("target"), "dst"), "target").filter("dst is not null")
    sought = names.join(new_links.select(F.col("target").alias("name")).distinct(), "name", "left_semi")
    fresh = new_links.join(resolved_names(sought).select(F.col("name").alias("target"), F.col("note_path").alias("dst")), "target")
    rows = reduce(DataFrame.unionByName, [f.select("src", "target", "dst") for f in (kept, moved, fresh)])
    return rows.filter("src <> dst")


def undirected(e: DataFrame) -> DataFrame:
    return e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def degrees(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """nodes (node) -> node, degree in the simple undirected graph; a self-loop counts 2, isolated nodes 0."""
    und = undirected(e)
    ends = und.select(F.explode(F.array("u", "v")).alias("node"))  # a loop gives its node twice
    count = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("node").distinct().join(count, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def hubs(deg: DataFrame, hub_degree: int = 40) -> DataFrame:
    return deg.filter(F.col("degree") >= hub_degree)


def backlinks(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("note_path"), F.col("src").alias("linked_from"))
