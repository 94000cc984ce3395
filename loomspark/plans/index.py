"""Refresh and rebuild of an index, as a plan over two snapshots."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import fence_defect_udf, parse_note_udf, render_udf
from loomspark.operators import graph
from loomspark.operators.blockmax import block_postings, lengths
from loomspark.operators.chunker import chunk_notes
from loomspark.operators.embed import Embedder
from loomspark.operators.refresh import replace_rows
from loomspark.policy import Policy
from loomspark.sources.store import BUCKET_BYTES, TABLES, Change, IndexStore, bucket_of, buckets_for
from loomspark.sources.vault import contents, manifest


@dataclass(frozen=True)
class RefreshReport:
    added: int
    updated: int
    removed: int
    unchanged: int
    defects: tuple[str, ...]
    chars_chunkable: int
    chars_embedded: int


def _parsed(raw: DataFrame) -> DataFrame:
    """raw (note_path, content) -> note_path, text, description, tags, aliases, body, error."""
    text = raw.select("note_path", F.decode("content", "UTF-8").alias("text"))
    p = text.withColumn("p", parse_note_udf("text"))
    return p.select("note_path", "text", "p.description", "p.tags", "p.aliases", F.col("p.body").alias("body"), F.col("p.error").alias("error"))


def _defects(parsed: DataFrame) -> DataFrame:
    line = fence_defect_udf("body")
    body_at = F.size(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")) - F.size(F.split("body", "\n"))
    fence = F.when(line.isNotNull(), F.concat(F.lit("unterminated code fence at line "), (line + body_at).cast("string")))
    each = parsed.select("note_path", F.explode(F.array_compact(F.array("error", fence))).alias("what"))
    return each.select(F.concat("note_path", F.lit(": "), "what").alias("defect"))


def refresh(spark: SparkSession, policy: Policy, store: IndexStore, embedder: Embedder, force: bool = False, bucket_bytes: int = BUCKET_BYTES) -> RefreshReport:
    """Bring the index up to date. Contents are read only of notes whose time differs from the recorded one, and only the
    buckets of changed and removed notes are written; ``force`` builds a new index beside the old one, which it replaces."""
    base = None if force else store.current()
    if base:
        store.check_identity(embedder.identity)
    walked = manifest(spark, policy)
    prior = store.read(spark, "notes", base) if base else spark.createDataFrame([], TABLES["notes"])
    p = prior.select("note_path", F.col("sha256").alias("h0"), F.col("mtime_ns").alias("m0"))
    joined = walked.join(p, "note_path", "left")
    maybe = contents(joined.filter("m0 is null or m0 <> mtime_ns").select("note_path", "mtime_ns", "h0"), policy)
    maybe = maybe.withColumn("sha256", F.sha2("content", 256)).cache()
    changed = maybe.filter("h0 is null or h0 <> sha256")
    touched = maybe.filter("h0 = sha256")
    removed = prior.join(walked, "note_path", "left_anti").select("note_path")
    try:
        counts = dict(zip(("added", "updated"), changed.agg(F.count_if(F.col("h0").isNull()), F.count_if(F.col("h0").isNotNull())).first()))
        counts["removed"] = removed.count()
        total, size = walked.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        counts["unchanged"] = total - counts["added"] - counts["updated"]
        if base and counts["added"] + counts["updated"] + counts["removed"] + touched.count() == 0:
            return RefreshReport(**counts, defects=(), chars_chunkable=0, chars_embedded=0)  # nothing to write
        return _write(spark, store, base, embedder, prior, changed, touched, removed, buckets_for(size, bucket_bytes), counts)
    finally:
        maybe.unpersist()


def _write(spark: SparkSession, store: IndexStore, base: dict | None, embedder: Embedder, prior: DataFrame, changed: DataFrame, touched: DataFrame, removed: DataFrame, wanted: int, counts: dict) -> RefreshReport:
    """Write the buckets that a refresh touches. An index that has outgrown its buckets four times is dealt anew."""
    buckets = base["buckets"] if base and wanted <= 4 * base["buckets"] else wanted
    every = set(range(buckets))
    whole = not base or base["buckets"] != buckets
    at = bucket_of(F.col("note_path"), buckets)
    parsed = _parsed(changed.select("note_path", "content")).cache()
    new_chunks = chunk_notes(parsed, embedder.count_tokens).cache()
    gone = changed.select("note_path").unionByName(removed).persist()
    try:
        defects = tuple(r[0] for r in _defects(parsed).orderBy("defect").collect())  # a line for each broken note
        chunkable = parsed.agg(F.sum(F.length(render_udf("body")) + F.coalesce(F.length("description"), F.lit(0)))).first()[0] or 0
        embedded = new_chunks.agg(F.sum(F.length("text"))).first()[0] or 0

        some = every if whole else {r[0] for r in gone.select(at.alias("b")).distinct().collect()}  # numbers of buckets
        timed = every if whole else some | {r[0] for r in touched.select(at.alias("b")).distinct().collect()}
        old = lambda name, which: store.read(spark, name, base, None if whole else which) if base else spark.createDataFrame([], TABLES[name])

        change = store.begin(spark, base, buckets)
        recorded = ["note_path", "sha256", "mtime_ns"]
        notes = replace_rows(old("notes", timed), changed.select(*recorded).unionByName(touched.select(*recorded)), gone.unionByName(touched.select("note_path")))
        texts = replace_rows(old("note_text", some), parsed.select("note_path", "text", "description", "tags", "aliases"), gone)
        chunks = replace_rows(old("chunks", some), new_chunks.withColumn("vector", embedder.column(F.col("text"))), gone)

        def write_chunks() -> None:
            written = change.write("chunks", chunks.withColumn("bucket", at), some).withColumn("bucket", at)
            held = lengths(written)
            _together(lambda: change.write("postings", block_postings(written), some), lambda: change.write("doc_len", held, some), lambda: change.count(held, some))

        _together(
            write_chunks,
            lambda: change.write("notes", notes.withColumn("bucket", at), timed),
            lambda: change.write("note_text", texts.withColumn("bucket", at), some),
            lambda: _write_graph(store, spark, base, change, parsed, gone, some, every, whole, at),
        )
        change.commit(embedder.identity)
    finally:
        for frame in (parsed, new_chunks, gone):
            frame.unpersist()
    return RefreshReport(**counts, defects=defects, chars_chunkable=chunkable, chars_embedded=embedded)


def _together(*jobs: Callable[[], object]) -> None:
    """Run jobs that don't wait for each other side by side; the first error is raised when all are over."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def linked(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parsed (as ``_parsed`` gives it) -> links (src, target), names (name, note_path, tier). A note whose head is broken is all text."""
    broken = F.col("error").isNotNull()
    aliases = F.when(broken | F.col("aliases").isNull(), F.array().cast("array<string>")).otherwise(F.col("aliases"))
    notes = parsed.select("note_path", F.when(broken, F.col("text")).otherwise(F.col("body")).alias("text"), aliases.alias("aliases"))
    return graph.links(notes), graph.catalog(notes)


def _write_graph(store: IndexStore, spark: SparkSession, base: dict | None, change: Change, parsed: DataFrame, gone: DataFrame, some: set[int], every: set[int], whole: bool, at: Column) -> None:
    """Links and names of the touched buckets, and the edges of these and of all notes that link to a name which now stands for something else."""
    old = lambda name, which=None: store.read(spark, name, base, which) if base else spark.createDataFrame([], TABLES[name])
    by_src = lambda frame: frame.withColumnRenamed("note_path", "src")
    new_links, new_names = linked(parsed)
    changed = graph.name_changes(old("names"), gone, new_names).persist()
    try:
        moved = by_src(old("links")).join(changed.select(F.col("name").alias("target")), "target", "left_semi")
        touched = every if whole else some | {r[0] for r in moved.select(F.col("src").alias("note_path")).select(at.alias("b")).distinct().collect()}
        names = replace_rows(old("names"), new_names, gone)
        edges = graph.mended_edges(by_src(old("edges", None if whole else touched)), by_src(old("links")), names, gone, new_links, changed)
        change.write("edges", edges.select(F.col("src").alias("note_path"), "target", "dst").withColumn("bucket", at), touched)
    finally:
        changed.unpersist()
    links = replace_rows(old("links", None if whole else some), new_links.withColumnRenamed("src", "note_path"), gone)
    own = replace_rows(old("names", None if whole else some), new_names, gone)
    _together(lambda: change.write("links", links.withColumn("bucket", at), some), lambda: change.write("names", own.withColumn("bucket", at), some))


def edges_now(spark: SparkSession, policy: Policy, store: IndexStore, walked: DataFrame) -> DataFrame:
    """src, dst between the notes of walked (note_path, mtime_ns): edges of the snapshot, mended for notes that have changed since.

    Only the contents of these are read; without a snapshot, of all.
    """
    base = store.current()
    if base is None:
        new_links, new_names = linked(_parsed(contents(walked.select("note_path"), policy)))
        names = graph.resolved_names(new_names)
        found = new_links.join(names, F.col("target") == F.col("name")).select("src", F.col("note_path").alias("dst"))
        return found.filter("src <> dst").distinct()
    edges = store.read(spark, "edges", base).withColumnRenamed("note_path", "src")
    prior = store.read(spark, "notes", base).select("note_path", F.col("mtime_ns").alias("m0"))
    changed = walked.select("note_path", "mtime_ns").join(prior, "note_path", "left").filter("m0 is null or m0 <> mtime_ns").select("note_path").persist()
    removed = prior.join(walked, "note_path", "left_anti").select("note_path")
    try:
        if changed.isEmpty() and removed.isEmpty():
            return edges.select("src", "dst").distinct()
        new_links, new_names = linked(_parsed(contents(changed, policy)))
        gone, names = changed.unionByName(removed), store.read(spark, "names", base)
        links = store.read(spark, "links", base).withColumnRenamed("note_path", "src")
        mended = graph.mended_edges(edges, links, replace_rows(names, new_names, gone), gone, new_links, graph.name_changes(names, gone, new_names))
        return mended.select("src", "dst").distinct()
    finally:
        changed.unpersist()
