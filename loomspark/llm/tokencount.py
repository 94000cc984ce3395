"""Edit-aware token counts.

A document is kept as a row of *leaves*, each a run of whole pre-tokens of about ``LEAF_CHARS`` characters, under a
balanced segment tree of token counts. Byte-level BPE never merges across pre-tokens, so a count is a sum over leaves. A leaf may end only
between a character that isn't white space and one that is: the pre-token pattern has a boundary at every
such place, and whether it is one depends on these two characters alone.

An edit splits the tree around the leaves that hold the edited characters and the character on either side (the
boundary context), cuts their new text into leaves again, encodes these alone and joins the parts, so no leaf
grows with the number of edits: O(edit + leaf + log n), not O(n). The root of a joined tree is drawn in proportion
to the sizes of its halves, which keeps trees balanced in expectation. The tree's total is at all times what encoding
the whole text anew would give.

Defined cases: a null text has null counts, and edits of it are void; an empty text has no tokens; a text without white
space is one leaf; edits are (start, length, replacement) in characters of the original text, applied in
order of start, cut to the text, and where they overlap the later one starts where the earlier ended; null
or no edits leave the count as it is; repeated rows are counted one by one; an empty table gives an empty result;
extra columns are ignored. The vocabulary is a file named by a parameter and is read once per worker.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded

LEAF_CHARS = 512
CHUNK_CHARS = 1 << 20
_BOUNDARY = re.compile(r"(?<=\S)(?=\s)")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The text cut at pre-token boundaries, each leaf of ``size`` characters or a little more."""
    out, at = [], 0
    while len(text) - at > size:
        m = _BOUNDARY.search(text, at + size)
        if m is None or m.start() >= len(text):
            break
        out.append(text[at : m.start()])
        at = m.start()
    if at < len(text):
        out.append(text[at:])
    return out


class _Node:
    """A leaf of text, and the sums of the tree below it."""

    __slots__ = ("left", "length", "right", "size", "sum", "text", "tokens")

    def __init__(self, text: str, tokens: int, left: _Node | None = None, right: _Node | None = None):
        self.text, self.tokens = text, tokens
        self.hang(left, right)

    def hang(self, left: _Node | None, right: _Node | None) -> _Node:
        self.left, self.right = left, right
        self.size, self.length, self.sum = 1, len(self.text), self.tokens
        for side in (left, right):
            if side is not None:
                self.size, self.length, self.sum = self.size + side.size, self.length + side.length, self.sum + side.sum
        return self


def _build(parts: list[str], counts: list[int], lo: int, hi: int) -> _Node | None:
    if lo >= hi:
        return None
    mid = (lo + hi) // 2
    return _Node(parts[mid], counts[mid], _build(parts, counts, lo, mid), _build(parts, counts, mid + 1, hi))


def _split(node: _Node | None, at: int) -> tuple[_Node | None, _Node | None]:
    """The leaves before the leaf edge at character ``at``, and the others."""
    if node is None:
        return None, None
    before = node.left.length if node.left else 0
    if at <= before:
        low, high = _split(node.left, at)
        return low, node.hang(high, node.right)
    low, high = _split(node.right, at - before - len(node.text))
    return node.hang(node.left, low), high


class TokenTree:
    """Leaves of one document and a balanced segment tree of their token counts."""

    def __init__(self, parts: list[str], counts: list[int], count: Callable[[list[str]], list[int]], leaf: int = LEAF_CHARS):
        self.root, self.count, self.leaf = _build(parts, counts, 0, len(parts)), count, leaf
        self.reencoded, self.draw = 0, random.Random(0).random

    @property
    def total(self) -> int:
        return self.root.sum if self.root else 0

    @property
    def length(self) -> int:
        return self.root.length if self.root else 0

    @property
    def parts(self) -> list[str]:
        out, node, above = [], self.root, []
        while node or above:
            while node:
                above.append(node)
                node = node.left
            node = above.pop()
            out.append(node.text)
            node = node.right
        return out

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """Where the leaf of the character at ``at`` begins and ends."""
        node, start = self.root, 0
        while True:
            before = start + (node.left.length if node.left else 0)
            if at < before:
                node = node.left
            elif at < before + len(node.text):
                return before, before + len(node.text)
            else:
                node, start = node.right, before + len(node.text)

    def _join(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if self.draw() * (a.size + b.size) < a.size:
            return a.hang(a.left, self._join(a.right, b))
        return b.hang(self._join(a, b.left), b.right)

    def edit(self, start: int, length: int, replacement: str) -> int:
        """Replace text[start : start + length]; the new total."""
        n = self.length
        start = max(0, min(start, n))
        end = max(start, min(start + length, n))
        lo, hi = (self._leaf(max(0, start - 1))[0], self._leaf(min(end, n - 1))[1]) if n else (0, 0)
        low, rest = _split(self.root, lo)
        middle, high = _split(rest, hi - lo)
        self.root = middle
        old = self.text
        new = leaves(old[: start - lo] + replacement + old[end - lo :], self.leaf)
        self.reencoded += sum(map(len, new))
        self.root = self._join(self._join(low, _build(new, self.count(new), 0, len(new))), high)
        return self.total


def in_order(edits, length: int) -> list[tuple[int, int, str]]:
    """Edits by start, cut to the text and to what earlier ones left."""
    out, at = [], 0
    for start, size, put in sorted((max(0, e["start"] or 0), max(0, e["length"] or 0), e["replacement"] or "") for e in edits or [] if e is not None):
        end = min(start + size, length)
        start = min(max(start, at), length)
        end = max(start, end)
        out.append((start, end - start, put))
        at = end
    return out


def recount(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """docs (doc_id, text, edits array<struct<start, length, replacement>>) -> doc_id, n_tokens, n_tokens_edited, n_leaves, n_chars_reencoded."""
    path = ranks_path or default_ranks()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary

        def count(parts: list[str]) -> list[int]:
            return [len(encode(p)) for p in parts]

        for b in batches:
            ids, texts, edits = b.column("doc_id"), b.column("text"), b.column("edits")
            rows = []
            for i in range(b.num_rows):
                text = texts[i].as_py()
                if text is None:
                    rows.append((None, None, None, None))
                    continue
                parts = leaves(text)
                tree = TokenTree(parts, count(parts), count)
                before, shift = tree.total, 0
                for start, size, put in in_order(edits[i].as_py(), len(text)):
                    tree.edit(start + shift, size, put)
                    shift += len(put) - size
                rows.append((before, tree.total, len(parts), tree.reencoded))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4))], ["doc_id", "n_tokens", "n_tokens_edited", "n_leaves", "n_chars_reencoded"])

    return docs.select("doc_id", "text", "edits").mapInArrow(bounded(run), f"doc_id {kind}, n_tokens long, n_tokens_edited long, n_leaves long, n_chars_reencoded long")
