"""Upkeep of lexical tables by a stream of changed and deleted notes, with withdrawals of what a note said before.

A note's state is its last number, hash, length and terms. A change gives rows that add to the tables, or take away: the sums of all
rows so far are the tables of a rebuild from the notes as they are by then. So whoever keeps the tables only adds up, batch
by batch (``apply``), and N, the mean length and document frequencies follow from the same rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomspark.functions.text import tokenize

#: A row for a term of a note: by how much tf changes, and whether the posting comes (1), goes (-1) or stays (0). A row without a
#: term is for the note: by how much its length changes, and whether the note comes or goes.
DELTAS = "note_path string, term string, tf long, n long"


class NoteTerms(StatefulProcessor):
    """Changes of one note (seq, deleted, hash, words) -> rows of DELTAS. The greatest seq counts; one that isn't greater than the last is ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seq long, hash string, words long")
        self.terms = handle.getMapState("terms", "term string", "tf long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = max(rows, key=lambda r: (r["seq"], not r["deleted"], r["hash"] or ""))
        seq, old_hash, old_len = self.seen.get() if self.seen.exists() else (None, None, None)
        if seq is not None and new["seq"] <= seq:
            return
        hash_ = None if new["deleted"] else new["hash"]
        self.seen.update((new["seq"], hash_, 0 if new["deleted"] else len(new["words"])))  # deleted notes keep their number
        if hash_ == old_hash:
            return
        words = Counter() if new["deleted"] else Counter(new["words"])
        old = dict((t[0], tf[0]) for t, tf in self.terms.iterator())
        for term in sorted(words.keys() | old.keys()):
            before, now = old.get(term, 0), words.get(term, 0)
            if before != now:
                yield Row(note_path=key[0], term=term, tf=now - before, n=(now > 0) - (before > 0))
                if now:
                    self.terms.updateValue((term,), (now,))
                else:
                    self.terms.removeKey((term,))
        yield Row(note_path=key[0], term=None, tf=sum(words.values()) - (old_len or 0), n=(hash_ is not None) - (old_hash is not None))

    def close(self) -> None:
        pass


def deltas(changes: DataFrame) -> DataFrame:
    """A stream of changes (note_path, seq long, text, deleted boolean) -> a stream of DELTAS. Needs the RocksDB state store.

    Null paths and numbers are ignored; a null text is empty, a null ``deleted`` is false.
    """
    text, gone = F.coalesce("text", F.lit("")), F.coalesce("deleted", F.lit(False))
    own = changes.filter("note_path is not null and seq is not null").select("note_path", "seq", gone.alias("deleted"), F.sha2(text, 256).alias("hash"), F.when(gone, F.array().cast("array<string>")).otherwise(tokenize(text)).alias("words"))
    return own.groupBy("note_path").transformWithState(statefulProcessor=NoteTerms(), outputStructType=DELTAS, outputMode="Append", timeMode="None")


def apply(held: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of DELTAS held and new -> their sums, which may be held in their place."""
    summed = held.unionByName(new).groupBy("note_path", "term").agg(F.sum("tf").alias("tf"), F.sum("n").alias("n"))
    return summed.filter("tf <> 0 or n <> 0").select("note_path", "term", "tf", "n")


def tables(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums of DELTAS -> postings (term, chunk_id, tf) and lengths (chunk_id, len), as ``lexical`` makes them with a chunk for each note."""
    post = held.filter("term is not null").select("term", F.col("note_path").alias("chunk_id"), "tf")
    return post, held.filter("term is null").select(F.col("note_path").alias("chunk_id"), F.col("tf").alias("len"))
