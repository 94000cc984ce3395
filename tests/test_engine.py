import json
import os
import subprocess
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest

from loomspark import cli
from loomspark.engine import Engine
from loomspark.operators.embed import HashingEmbedder
from loomspark.operators.fusion import Fusion
from loomspark.policy import Policy
from loomspark.sources import files
from loomspark.sources.store import IndexCorruptionError, IndexIdentityError
from loomspark.sources.vault import VaultAccessError

NOTES = {
    "brain/target.md": "---\ndescription: about trunk_branch\naliases: [Trunk]\n---\n# Target\nuse trunk_branch with afk#1089 now\n",
    "brain/decoy.md": "branch words about many branch things\n[[target]]\n",
    "work/plan.md": "plan for the trunk and branch [[Trunk]]\n",
    "personal/diary.md": "my trunk_branch secrets\n[[plan]]\n",
    "broken.md": "---\na: [\n---\ntext\n```\nopen\n",
}


@pytest.fixture
def engine(spark, vault):
    return Engine(spark, Policy.for_vault(vault(NOTES, "work")))


def test_refresh_cycle(engine):
    root = engine.policy.vault_root
    assert engine.status()["state"] == "missing"
    r = engine.index()
    assert (r.added, r.updated, r.removed, r.unchanged) == (5, 0, 0, 0)
    assert len(r.defects) == 2 and any("unterminated code fence at line 5" in x for x in r.defects)
    assert r.chars_chunkable == r.chars_embedded
    assert engine.status()["state"] == "ready"
    snapshot = engine.store.current()["snapshot"]
    again = engine.index()
    assert engine.store.current()["snapshot"] == snapshot
    assert (again.added, again.updated, again.unchanged) == (0, 0, 5)
    (root / "brain/decoy.md").write_text("changed words\n")
    os.utime(root / "work/plan.md", (1, 1))
    (root / "broken.md").unlink()
    s = engine.status()
    assert (s["state"], s["changed_notes"], s["deleted_notes"]) == ("stale", 1, 1)
    r = engine.index()
    assert (r.added, r.updated, r.removed, r.unchanged) == (0, 1, 1, 3)
    s = engine.status()
    assert s["state"] == "ready" and s["notes"] == 4


def test_search_gate_and_teeth(engine):
    for mode in Fusion:
        hits = engine.search("afk#1089 trunk_branch", 5, mode)
        assert hits[0].note_path == "brain/target.md"
        assert all(h.note_path != "personal/diary.md" for h in hits)
    assert engine.search("trunk", 0) == [] and len(engine.search("trunk", 99)) <= 25
    assert "trunk_branch" in engine.read("brain/target.md")
    with pytest.raises(VaultAccessError):
        engine.read("personal/diary.md")
    similar = engine.similar_notes("brain/target.md", 3)
    assert similar and all(p != "personal/diary.md" for p, _ in similar)
    with pytest.raises(VaultAccessError):
        engine.similar_notes("personal/diary.md")


def test_neighbors_and_gaps(engine):
    n = engine.neighbors("brain/target.md", 3)
    assert [x.note_path for x in n.neighbors] == ["brain/decoy.md", "work/plan.md"]
    assert n.neighbors[0].content == NOTES["brain/decoy.md"] and n.context == "work"
    with pytest.raises(FileNotFoundError):
        engine.gaps()
    engine.index()
    pairs = engine.gaps(threshold=0.0, max_score=1.0)
    assert ("brain/decoy.md", "work/plan.md") in {tuple(sorted(p[:2])) for p in pairs}
    engine.dismiss("brain/decoy.md", "work/plan.md")
    assert ("brain/decoy.md", "work/plan.md") not in {tuple(sorted(p[:2])) for p in engine.gaps(threshold=0.0, max_score=1.0)}
    (engine.policy.vault_root / "work/plan.md").write_text(NOTES["work/plan.md"] + "more")
    engine.index()
    assert ("brain/decoy.md", "work/plan.md") in {tuple(sorted(p[:2])) for p in engine.gaps(threshold=0.0, max_score=1.0)}


def test_identity_and_damage(spark, engine):
    engine.index()
    other = Engine(spark, engine.policy, HashingEmbedder(32))
    assert other.status()["state"] == "identity_mismatch"
    with pytest.raises(IndexIdentityError):
        other.index()
    assert other.index(force=True).added == 5
    assert engine.status()["state"] == "identity_mismatch"
    engine.index(force=True)
    now = engine.store.current()
    manifest = Path(engine.policy.index_dir) / engine.store.manifest_name(now["version"])
    whole = manifest.read_text()
    manifest.write_text(whole.replace("a", "b", 1))
    assert engine.status()["state"] == "corrupt"  # by its checksum
    (manifest.parent / f".{manifest.name}.crc").unlink()
    manifest.write_text(json.dumps(now | {"chunks": 1}))
    assert engine.status()["state"] == "corrupt"
    manifest.write_text("{")
    assert engine.status()["state"] == "corrupt" and "force" in engine.status()["remediation"]
    with pytest.raises(IndexCorruptionError):
        engine.index()
    manifest.write_text(json.dumps(now | {"schema_version": 7}))
    assert engine.status()["state"] == "corrupt"


def _commit(root, when, *paths):
    env = os.environ | {"GIT_AUTHOR_DATE": "2001-01-01T00:00:00Z", "GIT_COMMITTER_DATE": when.isoformat(), "GIT_AUTHOR_NAME": "t", "GIT_AUTHOR_EMAIL": "t@t", "GIT_COMMITTER_NAME": "t", "GIT_COMMITTER_EMAIL": "t@t"}
    subprocess.run(["git", "-C", str(root), "add", *paths], check=True)
    subprocess.run(["git", "-C", str(root), "commit", "-qm", "c"], check=True, env=env)


def test_activity_from_git(engine):
    root, now = engine.policy.vault_root, datetime(2026, 6, 10, 12, tzinfo=UTC)
    (root / "brain/é ü.md").write_text("\n  \nfirst\n")
    assert [e.note_path for e in engine.recent_activity(now=datetime.now(UTC))]  # times of files
    subprocess.run(["git", "-C", str(root), "init", "-q"], check=True)
    _commit(root, now - timedelta(days=8), "brain/target.md")
    _commit(root, now - timedelta(days=2), "brain/decoy.md", "brain/é ü.md", "personal/diary.md")
    _commit(root, now - timedelta(days=1), "work/plan.md")
    os.utime(root / "work/plan.md", (now.timestamp(), now.timestamp()))
    os.utime(root / "broken.md", ((now - timedelta(hours=3)).timestamp(),) * 2)
    got = engine.recent_activity(7, 20, now)
    assert [(e.note_path, e.modified) for e in got] == [("broken.md", "2026-06-10T09:00:00+00:00"), ("work/plan.md", "2026-06-09T12:00:00+00:00"), ("brain/decoy.md", "2026-06-08T12:00:00+00:00"), ("brain/é ü.md", "2026-06-08T12:00:00+00:00")]
    assert [e.first_line for e in got][0] == "" and got[3].first_line == "first"
    assert len(engine.recent_activity(7, 2, now)) == 2 and engine.recent_activity(0, 2, now) == []


def test_golden_files(engine, tmp_path):
    g = tmp_path / "g.toml"
    g.write_text('[[query]]\ntext = " afk#1089 "\nexpect = ["brain/target.md", "brain/target.md"]\n[[query]]\ntext = "zebra"\nexpect = ["personal/diary.md"]\nk = 3\n')
    queries = files.load_golden(g, engine.policy.vault_root)
    engine.index()
    report = engine.golden(queries)
    assert [r.recall for r in report.rows] == [1.0, 0.0] and report.mean_recall == 0.5
    said = engine.provenance(g, queries)
    assert (said.query_count, said.note_count, said.fusion, said.model_dim) == (2, 5, "rrf", 64) and said.vault_revision is None
    assert files.report_from_dict(json.loads(files.to_json(files.GoldenReport(report.rows, report.mean_recall, said)))).provenance == said
    back = files.report_from_dict(json.loads(files.to_json(report)) | {"more": 1})
    assert back == report
    assert {d["delta"] for d in engine.diff(back, report)} == {0.0}
    with pytest.raises(ValueError, match="rows"):
        files.report_from_dict({"mean_recall": 1})
    for bad in ('[[query]]\ntext = ""\nexpect=["a"]', '[[query]]\ntext = "a"\nexpect=[]', '[[query]]\ntext="a"\nexpect=["b"]\nk=0', "", '[[query]]\ntext="a"\nexpect=["../x"]', '[[query]]\ntext="a"\nexpect=["no.md"]'):
        g.write_text(bad)
        with pytest.raises(ValueError):
            files.load_golden(g, engine.policy.vault_root)


def test_dismissal_store(vault):
    root = vault({"a|b.md": "1", "c.md": "2"})
    files.DismissalStore(root).add("c.md", "a|b.md")
    assert list(files.DismissalStore(root).read()) == ["weaklink2|a\\|b.md|c.md"]
    for bad in ("none.md", "../x.md"):
        with pytest.raises(ValueError):
            files.DismissalStore(root).add("c.md", bad)
    (root / files.DISMISSALS).write_text("[]")
    assert files.DismissalStore(root).read() == {}
    assert files.signature("b", "a") == "weaklink|a|b" and files.signature("x", "y|z") != files.signature("x|y", "z")


def test_cli(spark, vault, tmp_path, capsys):
    root = str(vault(NOTES, "work"))

    def run(*args):
        code = cli.main(["--vault", root, *args], spark)
        return code, capsys.readouterr().out

    assert json.loads(run("index")[1])["added"] == 5
    assert json.loads(run("search", "afk#1089", "-k", "1")[1])[0]["note_path"] == "brain/target.md"
    assert run("read", "brain/decoy.md")[1] == NOTES["brain/decoy.md"]
    assert run("read", "personal/diary.md")[0] == 1
    assert json.loads(run("status")[1])["ready"] is True
    assert json.loads(run("neighbors", "work/plan.md")[1])["origin"] == "work/plan.md"
    g = tmp_path / "g.toml"
    g.write_text('[[query]]\ntext = "afk#1089"\nexpect = ["brain/target.md"]\n')
    assert run("golden", "--file", str(g), "--min-recall", "0.9")[0] == 0
    assert run("golden", "--file", str(g), "--min-recall", "1.1")[0] == 1
    assert cli.main(["--config", str(tmp_path / "none.toml"), "status"], spark) == 2
