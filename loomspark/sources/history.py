"""A data source for change times that git knows: ``spark.read.format("note_history")``.

Tables (option ``table``): ``commits`` has a row for each note and commit, with the committer's time, and ``worktree`` one for each note
that git status names, with its file's time. Where the session allows filters to be pushed to Python sources (``PUSHDOWN``) a filter
``ts >= x`` (or ``>``) is pushed; else the option ``since`` does the same. Git doesn't walk older commits then, and
commits are cut into ranges of ``range`` commits (an option), one partition each. Paths are below the option ``root``, which may be a
folder inside a repository; it must be at the same path on all executors. Where git fails (no repository, no commits yet, objects
missing) reading fails with GIT_FAILED; the caller decides what stands in for it.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

FORMAT, SCHEMA, GIT_FAILED = "note_history", "note_path string, ts timestamp", "GIT_FAILED"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def git(root: str, *args: str) -> str | None:
    """What git says about the folder, or None if it fails. Names that aren't UTF-8 keep their bytes as surrogates."""
    env = {k: v for k, v in os.environ.items() if k not in ("GIT_DIR", "GIT_WORK_TREE", "GIT_INDEX_FILE")} | {"GIT_NO_LAZY_FETCH": "1"}
    try:
        done = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], capture_output=True, check=True, env=env)
    except (OSError, subprocess.CalledProcessError):
        return None
    return done.stdout.decode("utf-8", "surrogateescape")


def _sure(said: str | None) -> str:
    if said is None:
        raise RuntimeError(GIT_FAILED)
    return said


class CommitRange(InputPartition):
    """Commits number ``skip`` to ``skip + count``, newest first, of those that lead to ``head``."""

    def __init__(self, head: str, skip: int, count: int):
        self.head, self.skip, self.count = head, skip, count


class HistoryReader(DataSourceReader):
    def __init__(self, root: str, table: str, size: int):
        self.root, self.table, self.size = root, table, size
        self.since: datetime | None = None
        self.strict = False  # whether ``since`` itself is outside

    def _inside(self, when: datetime) -> bool:
        return self.since is None or when > self.since or (when == self.since and not self.strict)

    def _window(self) -> list[str]:
        return [f"--since={self.since.replace(microsecond=0).isoformat()}"] if self.since else []

    def partitions(self) -> list[InputPartition]:
        if self.table == "worktree":
            return [InputPartition(0)]
        head = _sure(git(self.root, "rev-parse", "--verify", "HEAD")).strip()
        n = int(_sure(git(self.root, "rev-list", "--count", *self._window(), head, "--", ".")))
        return [CommitRange(head, k, self.size) for k in range(0, max(n, 1), self.size)]

    def _own(self, prefix: str, name: str) -> str | None:
        """A path of the repository as one below the root; None outside of it and for names that no string can hold."""
        rel = name[len(prefix) :] if name.startswith(prefix) else ""
        return rel if rel and not re.search("[\ud800-\udfff]", rel) else None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        prefix = _sure(git(self.root, "rev-parse", "--show-prefix")).rstrip("\n")
        if isinstance(partition, CommitRange):
            yield from self._commits(partition, prefix)
        else:
            yield from self._worktree(prefix)

    def _commits(self, part: CommitRange, prefix: str) -> Iterator[tuple]:
        log = _sure(git(self.root, "log", *self._window(), f"--skip={part.skip}", f"--max-count={part.count}", "--pretty=format:%x01%cI", "--name-only", "--no-renames", "-z", part.head, "--", "."))
        for commit in log.split("\x01")[1:]:
            stamp, *names = re.split("[\n\0]", commit)
            when = datetime.fromisoformat(stamp).astimezone(UTC)
            if self._inside(when):
                yield from ((rel, when) for rel in (self._own(prefix, n) for n in names) if rel)

    def _worktree(self, prefix: str) -> Iterator[tuple]:
        for entry in (git(self.root, "status", "--porcelain=v1", "-z", "--untracked-files=all", "--no-renames", "--", ".") or "").split("\0"):
            rel = self._own(prefix, entry[3:])
            try:
                when = rel and datetime.fromtimestamp(os.stat(os.path.join(self.root, rel)).st_mtime, tz=UTC)
            except OSError:  # a deleted note
                continue
            if when and self._inside(when):
                yield rel, when


class PushingReader(HistoryReader):
    """Spark refuses a reader with this method where the session doesn't allow it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, GreaterThanOrEqual | GreaterThan) and f.attribute == ("ts",):
                at, strict = f.value.astimezone(UTC), isinstance(f, GreaterThan)
                if self.since is None or (at, strict) > (self.since, self.strict):
                    self.since, self.strict = at, strict
            else:
                yield f


class NoteHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        table = self.options.get("table", "commits")
        if table not in ("commits", "worktree"):
            raise ValueError(f"no such table: {table}")
        kind = PushingReader if self.options.get("pushdown") == "true" else HistoryReader
        reader = kind(self.options["root"], table, int(self.options.get("range", 1000)))
        if self.options.get("since"):
            reader.since = datetime.fromisoformat(self.options["since"]).astimezone(UTC)
        return reader


def history(spark: SparkSession, root: str, table: str, since: datetime | None = None, size: int = 1000) -> DataFrame:
    """note_path, ts of one of the source's tables, from a time on."""
    spark.dataSource.register(NoteHistory)
    pushed = spark.conf.get(PUSHDOWN, "false")
    read = spark.read.format(FORMAT).option("root", root).option("table", table).option("range", size).option("pushdown", pushed)
    if since is None:
        return read.load()
    if pushed != "true":
        read = read.option("since", since.astimezone(UTC).isoformat())
    return read.load().filter(F.col("ts") >= F.lit(since.astimezone(UTC)))
