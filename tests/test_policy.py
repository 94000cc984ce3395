import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspark.policy import Policy, literal_names
from loomspark.sources import vault as V


@pytest.mark.parametrize("bad", ["x", [1], [""], ["."], [".."], ["a/b"], ["C:x"], ["a*"], ["a\\b"], ["a\0"], ["[a]"]])
def test_names_are_refused(bad):
    with pytest.raises(ValueError):
        literal_names(bad, "f")


def test_prefixes_may_hold_slashes():
    assert literal_names(["a/b", "a/"], "f", prefixes=True) == ("a/b", "a/")
    with pytest.raises(ValueError):
        literal_names(["a/../b"], "f", prefixes=True)


def test_toml(tmp_path):
    (tmp_path / "c.toml").write_text('vault_root = "v"\nscoped_folders = ["brain"]\n[visible_scopes]\nwork = ["work"]\n')
    p = Policy.from_toml(tmp_path / "c.toml")
    assert p.vault_root == tmp_path.resolve() / "v" and p.has_scope and p.visible_scopes == {"work": frozenset({"work"})}
    with pytest.raises(FileNotFoundError):
        Policy.from_toml(tmp_path / "none.toml")


PATHS = ["a.md", "brain/x.md", "brain/AGENTS.md", "brain/agents.md", "brain/.h.md", ".g/x.md", "skip/x.md", "work/Tasks.md.backup.md", "x.txt", "brain/B.MD", ".md", "brain/_d.md", "personal/p.md", "work/w.md"]


def test_columns_equal_the_driver_rule(spark):
    p = Policy(Path("/"), Path("/"), excluded_dirs=frozenset({"skip"}), scoped_folders=("brain", "work"), excluded_filenames=("AGENTS.md",), excluded_path_prefixes=("work/Tasks.md",))
    for q in (p, Policy(Path("/"), Path("/"))):
        rows = spark.createDataFrame([(x,) for x in PATHS], "p string").select("p", q.indexable(F.col("p")).alias("i"), q.visible(F.col("p"), "work").alias("v"), q.visible(F.col("p"), "unknown").alias("u")).collect()
        for r in rows:
            assert r["i"] == q.is_note(r["p"])
            assert r["v"] == q.may_see(r["p"], "work")
            assert r["u"] == q.may_see(r["p"], "unknown")


def test_contexts(vault):
    notes = {"brain/b.md": "", "personal/p.md": "", "work/w.md": ""}
    for context, n in (("personal", 3), ("work", 2), ("", 1), ("elsewhere", 1)):
        root = vault(notes, context)
        assert len(V.visible(sorted(notes), Policy.for_vault(root))) == n


def test_resolution(spark, vault, tmp_path):
    root = vault({"brain/b.md": "x", "personal/p.md": "y", "_d.md": "z"}, "work")
    p = Policy.for_vault(root)
    (root / "personal" / "link.md").symlink_to(root / "brain" / "b.md")
    (root / "out.md").symlink_to(tmp_path / "elsewhere.md")
    (tmp_path / "elsewhere.md").write_text("o")
    assert V.read_note("brain/b.md", p) == "x" and V.read_note("_d.md", p) == "z"
    for bad in ("personal/p.md", "personal/link.md", "out.md", "../elsewhere.md", str(root / "brain/b.md"), "brain/B.md", "none.md", "brain", ""):
        with pytest.raises(V.VaultAccessError, match="not available"):
            V.resolve(bad, p)
    listed = V.listing(spark, p)
    assert sorted(r["note_path"] for r in V.notes_of(listed, p).collect()) == ["_d.md", "brain/b.md", "personal/p.md"]
    assert sorted(r["note_path"] for r in V.gate(listed, p).collect()) == ["_d.md", "brain/b.md"]
    with pytest.raises(V.Unavailable):
        V.manifest(spark, p, strict=True)


def test_listing_equals_a_plain_walk_and_the_gate_single_paths(spark, vault, tmp_path):
    """Folders dealt out again and again, hidden and excluded ones, links to folders, notes and nowhere."""
    notes = {f"{a}/{b}/n{k}.md": "x" for a in ("brain", "work", "personal", ".hid", "skip") for b in ("x", "_y", ".z") for k in range(3)} | {"top.md": "", "a.txt": "", "UP.MD": "", ".h.md": "", "brain/.md": "", "brain/dir.md/in.md": ""}
    root = vault(notes, "work")
    (root / "brain/to-note.md").symlink_to(root / "work/x/n0.md")
    (root / "brain/to-private.md").symlink_to(root / "personal/x/n0.md")
    (root / "personal/to-shared.md").symlink_to(root / "brain/x/n0.md")
    (root / "brain/to-hidden.md").symlink_to(root / ".hid/x/n0.md")
    (root / "brain/broken.md").symlink_to(root / "none.md")
    (root / "brain/loop.md").symlink_to(root / "brain/loop.md")
    (root / "linked").symlink_to(root / "brain")
    p = Policy.for_vault(root, excluded_dirs=("skip",))
    plain = []
    for folder, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and d != "skip"]
        plain += [os.path.relpath(os.path.join(folder, f), root) for f in files]
    plain = sorted(x for x in plain if p.is_note(x))
    for most in (1, 3, 2000):
        listed = V.listing(spark, p, most)
        assert sorted(r["lexical_path"] for r in listed.collect()) == plain
        assert sorted(r["note_path"] for r in V.gate(listed, p).collect()) == V.visible(plain, p)
    stated = {r["note_path"]: (r["mtime_ns"], r["size"]) for r in V.notes_of(listed, p).collect()}
    assert stated["work/x/n0.md"] == (os.stat(root / "work/x/n0.md").st_mtime_ns, 1) and "brain/to-note.md" not in stated
    with pytest.raises(V.Unavailable):
        V.manifest(spark, p, strict=True)


def test_a_vault_that_changes_meanwhile_is_unavailable(spark, vault):
    root = vault({"a.md": "1"})
    p = Policy.for_vault(root)
    with V.steady(spark, p) as notes:
        assert notes.count() == 1
    with pytest.raises(V.Unavailable), V.steady(spark, p):
        (root / "a.md").write_text("22")
