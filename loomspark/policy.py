"""Configuration and visibility policy: which paths are notes, who owns them, who may see them.

A policy is driver-side and immutable; its rules compile to Column predicates, so that a gate is an
ordinary filter or semi-join in a plan. The active context is read from the vault, never passed in.
"""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default owners of top-level folders and what each context may see.
CONTEXT_DIRS = {"work": "work", "personal": "personal"}
VISIBLE_SCOPES = {"personal": frozenset({"personal", "work"}), "work": frozenset({"work"})}
CONTEXT_FILE = ".vault-context"
UNKNOWN = "unknown"
INDEX_DIR = ".loomspark"

# A literal step of a relative path: no pattern characters, no drive, not "." or "..".
_STEP = r"(?!\.{1,2}(?:/|\Z))[^\\\0*?\[\]/]+"
_NAME, _PREFIX = (re.compile(rf"(?!.:){x}", re.DOTALL) for x in (_STEP, rf"{_STEP}(?:/{_STEP})*/?"))


def literal_names(values: object, name: str, prefixes: bool = False) -> tuple[str, ...]:
    """Values as literal relative names, or ValueError. Only prefixes may hold a slash."""
    if not isinstance(values, (list, tuple, set, frozenset)):
        raise ValueError(f"{name}: a list of names is needed, not {type(values).__name__}")
    form = _PREFIX if prefixes else _NAME
    if wrong := [v for v in values if not (isinstance(v, str) and form.fullmatch(v))]:
        raise ValueError(f"{name}: not plain relative names: {wrong}")
    return tuple(values)


#: The settings besides the two places, by name (fixed values: they are the keys of the file): default and form.
SETTINGS: dict[str, tuple[object, Callable]] = {
    "excluded_dirs": ((), frozenset),
    "context_dirs": (CONTEXT_DIRS, dict),
    "visible_scopes": (VISIBLE_SCOPES, lambda v: {k: frozenset(x) for k, x in v.items()}),
    "scoped_folders": ((), lambda v: frozenset(literal_names(v, "scoped_folders"))),
    "excluded_filenames": ((), lambda v: frozenset(literal_names(v, "excluded_filenames"))),
    "excluded_path_prefixes": ((), lambda v: literal_names(v, "excluded_path_prefixes", prefixes=True)),
}


def _default(name: str):
    return field(default_factory=lambda: SETTINGS[name][0])


@dataclass(frozen=True)
class Policy:
    vault_root: Path
    index_dir: Path
    excluded_dirs: frozenset[str] = _default("excluded_dirs")
    context_dirs: Mapping[str, str] = _default("context_dirs")
    visible_scopes: Mapping[str, frozenset[str]] = _default("visible_scopes")
    scoped_folders: frozenset[str] = _default("scoped_folders")
    excluded_filenames: frozenset[str] = _default("excluded_filenames")
    excluded_path_prefixes: tuple[str, ...] = _default("excluded_path_prefixes")

    def __post_init__(self):
        vars(self).update({name: form(getattr(self, name)) for name, (_, form) in SETTINGS.items()})

    @classmethod
    def for_vault(cls, root: str | Path, index_dir: str | Path | None = None, **settings) -> Policy:
        """A policy for the vault in ``root``, with an index inside it unless said otherwise."""
        root = Path(os.path.realpath(root))
        return cls(root, root / INDEX_DIR if index_dir is None else Path(index_dir), **settings)

    @classmethod
    def from_toml(cls, path: str | Path) -> Policy:
        """Places in the file are relative to the file; keys that aren't settings are ignored."""
        with open(path, "rb") as f:
            data = tomllib.load(f)
        place = lambda key: Path(os.path.realpath(Path(path).parent / data[key])) if key in data else None
        if place("vault_root") is None:
            raise KeyError("vault_root")
        return cls.for_vault(place("vault_root"), place("index_dir"), **{k: data[k] for k in SETTINGS if k in data})

    @property
    def has_scope(self) -> bool:
        return bool(self.scoped_folders or self.excluded_filenames or self.excluded_path_prefixes)

    def active_context(self) -> str:
        marker = self.vault_root / CONTEXT_FILE
        said = marker.read_text(encoding="utf-8").strip() if marker.exists() else ""
        return said or UNKNOWN

    # ------------------------------------------------------------ Columns

    def indexable(self, path: Column) -> Column:
        """Whether a vault-relative path is a note."""
        parts = F.split(path, "/")
        n = F.size(parts)
        name = F.element_at(parts, -1)
        parents = F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))
        hidden = F.exists(parents, lambda p: p.startswith(".") | p.isin(sorted(self.excluded_dirs)) if self.excluded_dirs else p.startswith("."))
        ok = F.lower(name).endswith(".md") & (F.length(name) > 3) & ~name.startswith(".") & ~hidden
        if self.scoped_folders:
            ok &= (n >= 2) & parts[0].isin(sorted(self.scoped_folders))
        if self.excluded_filenames:
            ok &= ~name.isin(sorted(self.excluded_filenames))
        for prefix in self.excluded_path_prefixes:
            ok &= ~path.startswith(prefix)
        return F.coalesce(ok, F.lit(False))

    def is_note(self, rel: str) -> bool:
        """The same rule for one path, for driver-side walks."""
        *parents, name = rel.split("/")
        return (
            name.lower().endswith(".md")
            and len(name) > 3
            and not name.startswith(".")
            and not any(p.startswith(".") or p in self.excluded_dirs for p in parents)
            and (not self.scoped_folders or (len(parents) > 0 and parents[0] in self.scoped_folders))
            and name not in self.excluded_filenames
            and not rel.startswith(self.excluded_path_prefixes)
        )

    def owner(self, path: Column) -> Column:
        """The owning scope of a path, null where it is shared."""
        if not self.context_dirs:
            return F.lit(None).cast("string")
        top = F.split(path, "/")[0]
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for folder, scope in sorted(self.context_dirs.items()):
            out = out.when(top == folder, scope)
        return out

    def visible(self, path: Column, context: str | None = None) -> Column:
        """Whether a path may surface; the context defaults to the vault's own."""
        allowed = sorted(self.visible_scopes.get(self.active_context() if context is None else context, ()))
        owner = self.owner(path)
        return owner.isNull() | (owner.isin(allowed) if allowed else F.lit(False))

    def may_see(self, rel: str, context: str) -> bool:
        owner = self.context_dirs.get(rel.split("/")[0])
        return owner is None or owner in self.visible_scopes.get(context, ())
