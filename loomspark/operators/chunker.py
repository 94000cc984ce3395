"""Chunking: notes to units for embedding, never over a hard token ceiling.

A section (between headings outside code fences) is rendered and packed greedily from paragraphs; a unit
over the ceiling is split into sentences, then words, then characters. The ruler that counts tokens is
given by the embedder. On DataFrames this is a 1:n ``mapInArrow``: one pass, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.functions.text import find_fences, render

# Fixed values.
CEILING, TARGET = 512, 300

_HEADING = re.compile(r"(#{1,6})[ \t]+(\S.*?)\s*")
_AFTER_BLANK = re.compile(r"\n{2,}")
_AFTER_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)")
_WORD = re.compile(r"\S*\s+|\S+")
Ruler = Callable[[str], int]

CHUNK_SCHEMA = "chunk_id string, note_path string, chunk_index int, heading string, parent_ref string, text string, token_count int"


@dataclass(frozen=True)
class Chunk:
    chunk_id: str
    note_path: str
    chunk_index: int
    heading: str | None
    parent_ref: str | None
    text: str
    token_count: int


def sections(body: str) -> Iterator[tuple[str | None, str | None, str]]:
    """(heading, ancestors, text) of each section; the texts join to the body."""
    lines = body.splitlines(keepends=True)
    bare = [x.rstrip("\r\n") for x in lines]
    inside = set()
    for first, last in find_fences(bare)[0]:
        inside.update(range(first, last + 1))
    starts = [(i, m) for i, x in enumerate(bare) if i not in inside and (m := _HEADING.fullmatch(x))]
    if lines and (not starts or starts[0][0] > 0):
        yield None, None, "".join(lines[: starts[0][0] if starts else len(lines)])
    path: list[tuple[int, str]] = []
    for k, (i, m) in enumerate(starts):
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        yield m[2], " > ".join(t for _, t in path) or None, "".join(lines[i : starts[k + 1][0] if k + 1 < len(starts) else len(lines)])
        path.append((depth, m[2]))


def _cut_after(pattern: re.Pattern[str], text: str) -> list[str]:
    ends = [0, *(m.end() for m in pattern.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(ends, ends[1:]) if b > a]


#: How to cut a text at each tier, from coarse to fine; only the first packs towards a target.
TIERS: list[Callable[[str], list[str]]] = [lambda t: _cut_after(_AFTER_BLANK, t), lambda t: _cut_after(_AFTER_SENTENCE, t), _WORD.findall, list]


def _stretches(text: str, count: Ruler) -> Iterator[tuple[int, int, list[int]]]:
    """(tier, start, ends): neighbouring units within the ceiling, in order of the text, each stretch from one cut.

    A unit over the ceiling is cut at the next tier in its place; one that can't be cut stands alone.
    """
    finest = len(TIERS) - 1
    todo: list[tuple[int, int, int, list[int] | None]] = [(0, 0, len(text), None)]
    while todo:
        tier, a, b, ends = todo.pop()
        if ends is not None:
            yield tier, a, ends
            continue
        edges = accumulate(map(len, TIERS[tier](text[a:b])), initial=a)
        parts: list[tuple[int, int, int, list[int] | None]] = []
        for large, units in groupby(pairwise(edges), lambda u: count(text[u[0] : u[1]]) > CEILING):
            units = list(units)
            if large:
                parts += [(tier, *u, [u[1]]) if tier == finest else (tier + 1, *u, None) for u in units]
            else:
                parts.append((tier, units[0][0], units[-1][1], [u[1] for u in units]))
        todo += reversed(parts)


def pack(text: str, count: Ruler) -> Iterator[str]:
    """Pieces of the text within the ceiling, which join to the text; those of whole paragraphs end at the target."""
    for tier, start, ends in _stretches(text, count):
        enough = TARGET if tier == 0 else CEILING + 1
        size = count(text[start : ends[0]])
        for end, after in zip(ends, [*ends[1:], None]):
            grown = count(text[start:after]) if after is not None else CEILING + 1
            if size >= enough or grown > CEILING:
                yield text[start:end]
                start = end
                grown = count(text[start:after]) if after is not None else 0
            size = grown


def chunk_note(path: str, body: str, description: str | None, count: Ruler) -> list[Chunk]:
    """The description, whole, is chunk 0 where there is one; then the packed sections."""
    units = [(None, None, description)] if description is not None else []
    for heading, parent, text in sections(body):
        units += [(heading, parent, piece) for piece in pack(render(text), count)]
    return [Chunk(f"{path}#{i}", path, i, h, p, t, count(t)) for i, (h, p, t) in enumerate(units)]


def chunk_notes(notes: DataFrame, count: Ruler) -> DataFrame:
    """notes (note_path, body, description) -> a row for each chunk."""
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                rows = [c for r in b.slice(lo, 200).to_pylist() for c in chunk_note(r["note_path"], r["body"] or "", r["description"], count)]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([getattr(c, n) for c in rows], k) for n, k in zip(names, kinds)], names)

    return notes.select("note_path", "body", "description").mapInArrow(run, CHUNK_SCHEMA)
