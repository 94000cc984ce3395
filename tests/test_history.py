"""The git source against dicts made by plain calls of git."""

import os
import subprocess
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspark.policy import Policy
from loomspark.sources import gitlog
from loomspark.sources.history import PUSHDOWN, history

NOW = datetime(2026, 6, 10, 12, tzinfo=UTC)


def git(root, *args, when=NOW):
    who = {f"GIT_{a}_{b}": "t@t" for a in ("AUTHOR", "COMMITTER") for b in ("NAME", "EMAIL")}
    env = os.environ | who | {"GIT_AUTHOR_DATE": "2001-01-01T00:00:00Z", "GIT_COMMITTER_DATE": when.isoformat()}
    return subprocess.run(["git", "-C", str(root), *args], check=True, env=env, capture_output=True).stdout.decode()


@pytest.fixture
def repository(vault):
    """A vault in a folder of a repository; 12 commits, an hour apart, the last at NOW."""
    root = vault({"deep/vault/a.md": "1", "deep/vault/b é.md": "1", "deep/vault/c.txt": "1", "other.md": "1"})
    git(root, "init", "-q")
    for k in range(12):
        name = ("deep/vault/a.md", "deep/vault/b é.md", "other.md", "deep/vault/c.txt")[k % 4]
        (root / name).write_text(f"text {k}")
        git(root, "add", name)
        git(root, "commit", "-qm", f"commit {k}", when=NOW - timedelta(hours=11 - k))
    return root / "deep/vault"


def plain(root, since):
    """(note, time) of each commit, one call of git for each."""
    out = []
    for line in git(root, "log", "--pretty=%H %cI").splitlines():
        commit, when = line.split()
        when = datetime.fromisoformat(when).astimezone(UTC)
        names = git(root, "-c", "core.quotePath=false", "show", "--name-only", "--pretty=", commit).splitlines()
        out += [(n.removeprefix("deep/vault/"), when) for n in names if n.startswith("deep/vault/") and when >= since]
    return sorted(out)


def rows(frame):
    return sorted((r["note_path"], r["ts"].astimezone(UTC)) for r in frame.collect())


@pytest.fixture
def pushed(spark, request):
    spark.conf.set(PUSHDOWN, request.param)
    yield request.param
    spark.conf.unset(PUSHDOWN)


@pytest.mark.parametrize("pushed", ["true", "false"], indirect=True)
def test_commits(spark, repository, pushed):
    root = str(repository)
    for hours in (0, 4, 30):
        since = NOW - timedelta(hours=hours)
        found = history(spark, root, "commits", since, size=2)
        want = plain(repository, since)
        assert rows(found) == want and len(want) == {0: 1, 4: 4, 30: 9}[hours]
        commits = int(git(repository, "rev-list", "--count", f"--since={since.isoformat()}", "HEAD", "--", "."))
        assert found.rdd.getNumPartitions() == max(1, -(-commits // 2))  # ranges of the commits in the window alone
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("ts#" in plan and ">=" in plan) == (pushed == "false")  # where it is pushed, no filter on the time is left
    assert rows(history(spark, root, "commits").filter(F.col("ts") > F.lit(NOW - timedelta(hours=3)))) == plain(repository, NOW - timedelta(hours=2))
    assert rows(history(spark, root, "commits")) == plain(repository, NOW - timedelta(days=9))


def test_worktree_and_what_stands_in_for_git(spark, repository, tmp_path):
    root = str(repository)
    assert rows(history(spark, root, "worktree")) == []
    (repository / "a.md").write_text("changed")
    (repository / "new é.md").write_text("new")
    (repository / "b é.md").unlink()
    at = (NOW - timedelta(hours=1)).timestamp()
    os.utime(repository / "a.md", (at, at))
    os.utime(repository / "new é.md", (at - 200_000, at - 200_000))
    assert [n for n, _ in rows(history(spark, root, "worktree"))] == ["a.md", "new é.md"]
    assert rows(history(spark, root, "worktree", NOW - timedelta(hours=2))) == [("a.md", NOW - timedelta(hours=1))]
    commits, tree = gitlog.changes(spark, Policy.for_vault(repository), NOW - timedelta(hours=30))
    assert rows(commits) == [("a.md", NOW - timedelta(hours=3)), ("b é.md", NOW - timedelta(hours=2))] and rows(tree) == [("a.md", NOW - timedelta(hours=1))]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/n.md").write_text("x")
    os.utime(tmp_path / "plain/n.md", (at, at))
    for begun in (False, True):  # no repository, then one without commits
        if begun:
            git(tmp_path / "plain", "init", "-q")
        commits, tree = gitlog.changes(spark, Policy.for_vault(tmp_path / "plain"), NOW - timedelta(hours=2))
        assert rows(commits) == [("n.md", NOW - timedelta(hours=1))] and tree.count() == 0
    with pytest.raises(Exception, match="GIT_FAILED"):
        history(spark, str(tmp_path / "plain"), "commits").count()
    with pytest.raises(Exception, match="no such table"):
        history(spark, root, "branches").count()
