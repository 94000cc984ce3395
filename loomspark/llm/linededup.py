"""Corpus-wide line deduplication, DataFrame operations only.

Texts are split at ``\\n``. A line's key is the line without white space (0x20, 0x09-0x0D) at its ends, A-Z
lower-cased. Keys are hashed to 128 bits and the distinct documents of each hash are counted; keys of at least
``least_chars`` code points that occur in at least ``least_docs`` documents lose all their lines, everywhere.
The other lines stay as they are, in their places, joined by ``\\n``.

Scale: keys are counted with map-side sums, first by key and document, then by key, so a line that every document
holds is spread over all tasks. Only hashes, ids and positions of dropped lines are shuffled, and texts once, to meet
the positions, unless these are few enough to be broadcast. The positions of a text are found by a semi-join with
the common keys, which are broadcast only when they number at most ``broadcast_rows`` (they are counted); beyond
that both sides are shuffled, and adaptive execution splits the partition of a hot key. Reassembly is linear in a
text's length: what is kept is put together from the stretches between dropped positions.

Defined cases: a null or empty text is one empty line; an empty key (a blank line) is shorter than any
``least_chars`` of 1 or more and stays; rows that repeat a doc_id count as one document, and each row is
rewritten for itself; rows with a null doc_id are one document for each different text; very long texts are read
whole; ties can't occur (the count is met or not); an empty table gives an empty result; extra columns are carried,
and columns of the input named ``n_lines`` or ``n_dropped`` are replaced by the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, checkpoint


def line_key(line: Column) -> Column:
    """Trimmed, A-Z lower-cased. ``lower`` is the same as that, and faster, for a line of ASCII characters."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def line_keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """docs (doc_id, text) -> id, of (a text's hash), doc (the document counted), pos, h1, h2: a row for each line whose key is long enough."""
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("of"), text.alias("t"))
    lines = named.select("id", "of", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line")).select("id", "of", "pos", line_key(F.col("line")).alias("key"))
    doc = F.struct(F.col("id"), F.when(F.col("id").isNull(), F.col("of")).alias("of"))
    return lines.filter(F.length("key") >= max(1, least_chars)).select("id", "of", doc.alias("doc"), "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def common_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """(h1, h2, n_docs) of the keys found in at least ``least_docs`` documents."""
    each = line_keys(docs, least_chars).select("h1", "h2", "doc").distinct()
    return each.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least_docs)


def without(lines: Column, dropped: Column) -> Column:
    """The array without the (ascending) positions: the stretches between them, one after the other."""
    bounds = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    # arrays of one struct keep the split text from being evaluated once for each stretch
    whole = F.array(F.struct(lines.alias("lines"), bounds.alias("b")))
    stretches = F.transform(whole, lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.size(w["b"]) - 1), lambda i: F.slice(w["lines"], F.get(w["b"], i - 1) + 2, F.get(w["b"], i) - F.get(w["b"], i - 1) - 1))))
    return F.get(stretches, 0)


def dedup_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, broadcast_rows: int = 500_000) -> DataFrame:
    """docs (doc_id, text, ...) -> the same rows and columns, common lines gone from text, and n_lines (before), n_dropped (long)."""
    common = checkpoint(common_lines(docs, least_docs, least_chars).select("h1", "h2"))
    met = line_keys(docs, least_chars).join(F.broadcast(common) if common.count() <= broadcast_rows else common, ["h1", "h2"], "left_semi")
    gone = met.groupBy("id", "of").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    rows = docs.toDF(*names).withColumn("t", F.coalesce(at["text"], F.lit("")))
    rows = rows.join(gone, rows[at["doc_id"]].eqNullSafe(gone["id"]) & (F.xxhash64("t") == gone["of"]), "left")
    lines = F.split("t", "\n", -1)
    kept = F.when(F.col("dropped").isNull(), F.col(at["text"])).otherwise(F.array_join(without(lines, F.col("dropped")), "\n"))
    carried = [F.col(at[c]).alias(c) if c != "text" else kept.alias("text") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*carried, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
