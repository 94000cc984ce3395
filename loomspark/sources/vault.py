"""The vault as a source: a listing of its notes, their bytes, and the gate, for whole vaults and for single paths.

Folders are listed and contents read on the executors, so the vault must be at the same path there; Spark's own file
sources would skip names that start with ``_``, and know no nanosecond times.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.policy import Policy
from loomspark.sources.durable import checkpoint

LISTING = "lexical_path string, canonical_path string, is_file boolean, spelling_ok boolean, mtime_ns long, size long, error string"


class VaultAccessError(PermissionError):
    """A path that isn't a readable, visible note; one message for every reason."""

    def __init__(self, path: str):
        super().__init__(f"path is not available: {path}")


class Unavailable(RuntimeError):
    """The vault can't be observed in a stable state."""


class Listings(dict):
    """Names in each folder, listed once."""

    def __missing__(self, folder: str) -> frozenset[str]:
        self[folder] = frozenset(os.listdir(folder))
        return self[folder]


def spelled_exactly(root: Path, rel: Path, listed: Listings | None = None) -> bool:
    """Whether every part of rel is the name of a directory entry, letter by letter; a step up needs none."""
    listed = Listings() if listed is None else listed
    names = [(os.path.normpath(os.path.join(root, *rel.parts[:k])), part) for k, part in enumerate(rel.parts) if part != os.pardir]
    try:
        return all(part in listed[folder] for folder, part in names)
    except OSError:
        return False


def _leads_to_folder(e: os.DirEntry) -> bool:
    try:
        return e.is_dir()
    except OSError:  # a link to itself
        return False


def _entry(root: Path, rel: str, policy: Policy, listed: Listings) -> tuple | None:
    """A row of ``listing`` for a path that is a note by its name."""
    path = root / rel
    try:
        real = path.resolve(strict=True)
        inside, stat = real.relative_to(root), real.stat()
        odd = "a link" if path.is_symlink() else None if real.is_file() else "not a regular file"
        return rel, inside.as_posix(), real.is_file(), spelled_exactly(root, inside, listed), stat.st_mtime_ns, stat.st_size, odd
    except ValueError:
        return rel, None, False, False, None, None, "a link out of the vault"
    except (OSError, RuntimeError) as e:
        return rel, None, False, False, None, None, str(e)[:200]


def listing(spark: SparkSession, policy: Policy, most: int = 2000) -> DataFrame:
    """What the vault's folders hold that is a note by its name: a row for each path, with what it leads to.

    lexical_path, canonical_path (null if it leads nowhere inside), is_file, spelling_ok, mtime_ns, size, error (why a strict
    reader refuses it; rows for folders that can't be listed have nothing else). Folders are listed on the executors, level by level: a task goes
    down from its folders until it has listed ``most`` of them, and what it hasn't reached is dealt out anew. Hidden and
    excluded folders aren't entered, links to folders aren't followed.
    """
    root = str(policy.vault_root.resolve())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, listed = Path(root), Listings()
        for b in batches:
            todo = b.column("folder").to_pylist()[::-1]
            seen = 0
            while todo and seen < most:
                folder, rows, below = todo.pop(), [], []
                seen += 1
                try:
                    with os.scandir(top / folder) as found:
                        for e in sorted(found, key=lambda e: e.name):
                            rel = f"{folder}/{e.name}" if folder else e.name
                            if e.is_dir(follow_symlinks=False):
                                if not e.name.startswith(".") and e.name not in policy.excluded_dirs:
                                    below.append(rel)
                            elif not _leads_to_folder(e) and policy.is_note(rel):
                                rows.append((*_entry(top, rel, policy, listed), None))
                except OSError as e:
                    rows.append((None, None, False, False, None, None, str(e)[:200], None))
                todo += below[::-1]
                yield _rows(rows)
            yield _rows([(None, None, False, False, None, None, None, folder) for folder in todo])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [*(c.split()[0] for c in LISTING.split(", ")), "folder"]
    folders, levels = spark.createDataFrame([("",)], "folder string"), []
    while True:
        found = checkpoint(folders.mapInArrow(run, f"{LISTING}, folder string"))
        levels.append(found.filter("folder is null").drop("folder"))
        folders = found.filter("folder is not null").select("folder")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        folders = folders.repartition("folder")


def notes_of(listed: DataFrame, policy: Policy) -> DataFrame:
    """listed -> note_path, mtime_ns, size of the notes to be indexed: what paths lead to, once, if both ends are notes inside the vault."""
    good = listed.filter(F.col("is_file") & F.col("spelling_ok") & policy.indexable(F.col("lexical_path")) & policy.indexable(F.col("canonical_path")))
    return good.groupBy(F.col("canonical_path").alias("note_path")).agg(F.max("mtime_ns").alias("mtime_ns"), F.max("size").alias("size"))


def gate(listed: DataFrame, policy: Policy, context: str | None = None) -> DataFrame:
    """listed -> note_path of every path that may be asked for: the path and what it leads to must both be notes that may be seen."""
    context = policy.active_context() if context is None else context
    ends = [policy.indexable(F.col(c)) & policy.visible(F.col(c), context) for c in ("lexical_path", "canonical_path")]
    return listed.filter(F.col("is_file") & F.col("spelling_ok") & ends[0] & ends[1]).select(F.col("lexical_path").alias("note_path"))


def manifest(spark: SparkSession, policy: Policy, strict: bool = False) -> DataFrame:
    """note_path, mtime_ns, size of the vault's notes. strict: links, other non-regular notes and errors raise Unavailable."""
    listed = listing(spark, policy)
    if strict and (bad := listed.filter("error is not null").select("error").head()):
        raise Unavailable(f"the vault holds something that can't be read as a regular note: {bad[0]}")
    return notes_of(listed, policy)


def contents(notes: DataFrame, policy: Policy) -> DataFrame:
    """notes (note_path, ...) -> the same rows and their bytes, read on the executors."""
    root = str(policy.vault_root.resolve())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                data = [Path(root, p).read_bytes() for p in part.column("note_path").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*part.schema.names, "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.schema)
    return notes.mapInArrow(run, f"{schema}, content binary")


@contextmanager
def steady(spark: SparkSession, policy: Policy) -> Iterator[DataFrame]:
    """The notes, as long as they are the same before and after; files that can't be read meanwhile are unavailable too."""
    before = manifest(spark, policy, strict=True)
    try:
        yield before
    except (PySparkException, Py4JJavaError) as e:
        raise Unavailable("a note can't be read") from e
    after = manifest(spark, policy, strict=True)
    if not (before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()):
        raise Unavailable("the vault changed meanwhile")


def resolve(rel: str, policy: Policy) -> Path:
    """The file of a note that may be seen, or VaultAccessError. Both the path asked for and the one it leads to must pass."""
    root = policy.vault_root.resolve()
    asked = Path(rel)
    if asked.is_absolute() or not rel or "\0" in rel:
        raise VaultAccessError(rel)
    try:
        real = (root / asked).resolve(strict=True)
        inside = real.relative_to(root)
        plain = Path(os.path.normpath(root / asked)).relative_to(root)
        good = real.is_file() and spelled_exactly(root, asked) and spelled_exactly(root, inside)
    except (OSError, ValueError, RuntimeError):
        raise VaultAccessError(rel) from None
    context = policy.active_context()
    if not good or not all(policy.is_note(p.as_posix()) and policy.may_see(p.as_posix(), context) for p in (plain, inside)):
        raise VaultAccessError(rel)
    return real


def visible(paths: list[str], policy: Policy) -> list[str]:
    """The paths that resolve, in their order; for the few of one result (``gate`` is the same for a whole vault)."""

    def ok(p: str) -> bool:
        try:
            resolve(p, policy)
        except VaultAccessError:
            return False
        return True

    return [p for p in paths if ok(p)]


def read_note(rel: str, policy: Policy) -> str:
    return resolve(rel, policy).read_bytes().decode("utf-8")
