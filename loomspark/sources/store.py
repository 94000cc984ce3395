"""The index store: Parquet tables in hash buckets of notes, and a manifest of files for each snapshot.

A table is cut into buckets by a hash of the note's path. A change writes the buckets that it touches, into files of
their own, and a manifest that names these and, for all other buckets, the files of the snapshot before; so what a refresh
writes is in proportion to what has changed. Manifests are numbered and the newest counts. A commit takes the number after
the one it started from, only if nobody has taken it (``put_if_absent``): of two writers one fails and changes nothing.
Readers hold the files of one manifest and see the old index or the new one, whole. Vectors are a column of ``chunks``: there is no
second file to disagree with. All files are reached through Hadoop's FileSystem, so the store may be on any that Spark knows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.embed import ModelIdentity
from loomspark.sources.hadoop import Folder, uri

SCHEMA_VERSION = 2
TABLES = {
    "notes": "note_path string, sha256 string, mtime_ns long",
    "note_text": "note_path string, text string, description string, tags array<string>, aliases array<string>",
    "chunks": "chunk_id string, note_path string, chunk_index int, heading string, parent_ref string, text string, token_count int, vector array<float>",
    "postings": "term string, span long, n int, max_tf long, min_len long, chunk_ids array<string>, tfs array<long>, lens array<long>",
    "doc_len": "chunk_id string, len long",
    "links": "note_path string, target string",
    "names": "name string, note_path string, tier int",
    "edges": "note_path string, target string, dst string",
}
#: Order of rows in a file; a query's terms then prune row groups and pages.
SORTED = {"notes": ["note_path"], "note_text": ["note_path"], "chunks": ["note_path", "chunk_index"], "postings": ["term", "span"], "doc_len": ["chunk_id"], "links": ["target"], "names": ["name"], "edges": ["note_path"]}
LEAST_BUCKETS, BUCKET_BYTES = 16, 64 << 20


class IndexIdentityError(RuntimeError):
    """The index was built with another model."""


class IndexCorruptionError(RuntimeError):
    """The index can't be trusted; a forced rebuild mends it."""


class ConcurrentCommitError(RuntimeError):
    """Another writer has committed since this one began; nothing of this commit counts."""


def bucket_of(note_path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(note_path), F.lit(buckets)).cast("int")


def buckets_for(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """How many buckets notes of so many bytes get."""
    return max(LEAST_BUCKETS, -(-size // bucket_bytes))


class IndexStore:
    def __init__(self, index_dir: str | Path):
        self.index_dir = uri(index_dir)

    def folder(self) -> Folder:
        return Folder(SparkSession.active(), self.index_dir)

    # ------------------------------------------------------------ snapshots

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder().names("manifests") if n.endswith(".json") and n[:-5].isdigit()]

    @staticmethod
    def manifest_name(version: int) -> str:
        return f"manifests/{version:012d}.json"

    def manifest(self, version: int) -> dict:
        try:
            data = json.loads(self.folder().read(self.manifest_name(version)))
            if data["schema_version"] != SCHEMA_VERSION:
                raise IndexCorruptionError("the schema version is missing or unsupported")
            if not {"snapshot", "identity", "buckets", "files", "counts", "chunks"} <= data.keys():
                raise IndexCorruptionError("the manifest is incomplete")
            return data | {"version": version}
        except (json.JSONDecodeError, KeyError, TypeError, AttributeError, UnicodeDecodeError, Py4JJavaError) as e:  # the last: a wrong checksum
            raise IndexCorruptionError(f"the manifest can't be read: {str(e)[:200]}") from e

    def current(self) -> dict | None:
        """The newest manifest, or None: {snapshot, version, identity, buckets, files: {table: {bucket: [path]}}, counts: {bucket: [chunks, terms]}, chunks}."""
        versions = self.versions()
        return self.manifest(versions[-1]) if versions else None

    def identity(self) -> ModelIdentity | None:
        now = self.current()
        try:
            return ModelIdentity(**now["identity"]) if now and now.get("identity") else None
        except TypeError as e:
            raise IndexCorruptionError("the model identity is incomplete") from e

    def check_identity(self, expected: ModelIdentity) -> None:
        own = self.identity()
        if own is not None and own != expected:
            raise IndexIdentityError(f"built with {own}, asked for {expected}; rebuild with force")

    def files(self, name: str, now: dict, buckets: set[int] | None = None) -> list[str]:
        held = now["files"].get(name, {})
        return [p for b in held if buckets is None or int(b) in buckets for p in held[b]]

    def read(self, spark: SparkSession, name: str, now: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table of a snapshot (the newest by default), or only some of its buckets."""
        now = now or self.current()
        paths = self.files(name, now, buckets) if now else []
        if not paths:
            return spark.createDataFrame([], TABLES[name])
        try:
            return spark.read.schema(TABLES[name]).parquet(*[f"{self.index_dir}/{p}" for p in paths])
        except AnalysisException as e:
            raise IndexCorruptionError(f"files of table {name} are missing from snapshot {now['snapshot']}") from e

    @staticmethod
    def statistics(now: dict | None) -> tuple[int, float | None]:
        """(chunks, mean number of terms) of a snapshot, from its manifest."""
        counts = list(now["counts"].values()) if now else []
        chunks = sum(n for n, _ in counts)
        return chunks, (sum(t for _, t in counts) / chunks if chunks else None)

    # ------------------------------------------------------------ changes

    def begin(self, spark: SparkSession, base: dict | None, buckets: int) -> Change:
        """A change of the snapshot ``base``; without one, or with another number of buckets, of an empty index."""
        versions = self.versions()
        return Change(self, spark, base, buckets, base["version"] if base else (versions[-1] if versions else 0))

    def prune(self, keep: int = 2) -> None:
        """Remove all manifests but the newest ``keep``, which readers may still hold, and the files that only the others name."""
        versions, folder = self.versions(), self.folder()

        def named(v: int) -> set[str]:
            try:
                now = self.manifest(v)
            except IndexCorruptionError:
                return set()
            return {p for t in TABLES for p in self.files(t, now)}

        if gone := versions[:-keep]:
            needed = set().union(*(named(v) for v in versions[-keep:]))
            for v in gone:
                for p in named(v) - needed:
                    folder.delete(p)
                folder.delete(self.manifest_name(v))

    def validate(self, spark: SparkSession) -> None:
        """Raise IndexCorruptionError unless rows, vectors and notes of the snapshot agree."""
        now = self.current()
        if now is None:
            return
        dim = self.identity().dim
        bad_vector = F.col("vector").isNull() | (F.size("vector") != dim) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        chunks, notes = self.read(spark, "chunks", now), self.read(spark, "notes", now)
        try:
            n, ids, bad = chunks.agg(F.count("*"), F.countDistinct("chunk_id"), F.count_if(bad_vector)).first()
            lost = chunks.join(notes, "note_path", "left_anti").limit(1).count()
            posted = self.read(spark, "postings", now).agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
        except Exception as e:
            raise IndexCorruptionError(f"the snapshot can't be read: {str(e)[:200]}") from e
        if n != now["chunks"] or ids != n or n != self.statistics(now)[0]:
            raise IndexCorruptionError("the number of chunks disagrees with the commit")
        if bad:
            raise IndexCorruptionError("vectors are missing, of the wrong size or not finite")
        if lost:
            raise IndexCorruptionError("a chunk belongs to a note that isn't recorded")
        if posted != sum(t for _, t in now["counts"].values()):
            raise IndexCorruptionError("the postings disagree with the lengths of the chunks")


class Change:
    """Buckets written for one commit. Nothing of it can be seen before ``commit``."""

    def __init__(self, store: IndexStore, spark: SparkSession, base: dict | None, buckets: int, version: int):
        self.store, self.spark, self.buckets, self.version = store, spark, buckets, version
        keep = base if base and base["buckets"] == buckets else {"files": {}, "counts": {}}
        self.held = {t: dict(keep["files"].get(t, {})) for t in TABLES}
        self.counts = dict(keep["counts"])
        self.snapshot = f"snapshot-{uuid.uuid4().hex}"

    def write(self, name: str, rows: DataFrame, touched: set[int]) -> DataFrame:
        """rows (the table's columns, bucket): all rows that the touched buckets are to hold -> the same, read from the new files."""
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        place = f"data/{name}/{self.snapshot}"
        dealt = rows.select(*columns, "bucket").repartition("bucket").sortWithinPartitions("bucket", *SORTED[name])
        dealt.write.partitionBy("bucket").parquet(f"{self.store.index_dir}/{place}")
        for b in touched:
            self.held[name].pop(str(b), None)
        for path, *_ in self.store.folder().files(place):
            self.held[name].setdefault(path.split("/bucket=")[1].split("/")[0], []).append(path)
        return self.store.read(self.spark, name, {"files": self.held, "snapshot": self.snapshot}, touched)

    def count(self, lengths: DataFrame, touched: set[int]) -> None:
        """lengths (bucket, len): chunks and terms of the touched buckets."""
        for b in touched:
            self.counts.pop(str(b), None)
        for b, n, terms in lengths.groupBy("bucket").agg(F.count("*"), F.sum("len")).collect():  # a row for each bucket
            self.counts[str(b)] = [n, terms]

    def commit(self, identity: ModelIdentity) -> str:
        manifest = {"snapshot": self.snapshot, "schema_version": SCHEMA_VERSION, "identity": asdict(identity), "buckets": self.buckets, "chunks": sum(n for n, _ in self.counts.values()), "counts": self.counts, "files": self.held}
        if not self.store.folder().put_if_absent(self.store.manifest_name(self.version + 1), json.dumps(manifest)):
            for name in TABLES:
                self.store.folder().delete(f"data/{name}/{self.snapshot}")
            raise ConcurrentCommitError(f"version {self.version + 1} has been committed by another writer")
        self.store.prune()
        return self.snapshot
