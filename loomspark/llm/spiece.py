"""SentencePiece encoding and decoding by streaming Viterbi.

Encoding finds the segmentation of a text into vocabulary pieces with the highest total score. Texts are
read as streams, many of them in step, character by character. Each stream keeps the best scores of the last
``longest`` boundaries (no piece is longer) and the backpointers since its last committed boundary. Every ``longest``
characters or more, and where streams end, the paths that survive (the backpointer chains from the boundaries that a later piece
can still start from; at an end, from that boundary alone) are followed back together: the last boundary through which
all of them pass is committed, the ids before it are given out and its rows are dropped. So ids never change
after they are given out, and memory is bounded where paths meet.

In a run of one repeated character, or of a few, they may never meet. But there the scores of the window, taken
relative to its last, soon come back, and from then on the backpointers repeat with a period as long as the run
goes on. Streams with a run of ``RUN`` characters or more are coded one by one (``Alone``): where the relative
scores have come back, which is compared exactly, the rest of the run is kept as one period of rows with its
count, and no row is made for it. The result is that of the recurrence row by row.

The pieces that end at a character come from one walk of a trie of the vocabulary for each boundary still open; a
walk ends where no piece goes on. Ties go to the longer last piece.

Some boundaries are known beforehand to be common to all paths: those between two characters that no piece
has side by side, such as the one before a U+2581 that follows another character. Texts are cut into streams
there, equal streams are coded once, and each worker remembers the ids of up to ``MEMO`` streams, so a word
that it has met before costs a look-up.

Scores: the vocabulary file on this box is a BPE model, whose scores are merge ranks r, not log
probabilities. They are read as a Zipf law, score = -ln(r + ZIPF_SHIFT): pseudo-probabilities, so that Viterbi has a
unigram model to maximise; ids may differ from those of rank-by-rank merging, decoding is exact all the same.
A character outside the vocabulary, and U+2581 itself in a text, is coded by its UTF-8 bytes, each at the
score ``BYTE_SCORE``; so every text can be encoded and comes back unchanged.

Defined cases: a null text has null ids; an empty text has no ids; texts of any length are encoded whole;
repeated rows are encoded one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, mix64, text_buffers

SPACE = "▁"
ZIPF_SHIFT, UNIT = 1000.0, 1 << 20
BYTE_SCORE, NEVER = -30 * UNIT, -(1 << 60)
CHUNK_CHARS, STREAMS, MEMO = 1 << 19, 20_000, 1 << 18
PAIR_BITS = 18
RUN = 256
LITERAL = 0x110000  # stands for a U+2581 of the text itself: a code that no piece has
_MUL = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces with scores, and a trie of them: an open-addressing table from (node, code point) to node, for steps by array."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        self.score: dict[str, tuple[int, int]] = {}
        for i in range(n):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                v = int(p[3:5], 16)
                self.byte_id[v] = i
                self.pieces[i] = bytes([v])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[i] = p.replace(SPACE, " ").encode()
                rank = min(-model.get_score(i), float(n))  # runs of blanks have no rank: the last
                self.score[p] = (-round(float(np.log(max(0.0, rank) + ZIPF_SHIFT)) * UNIT), i)
        self.longest = max(map(len, self.score), default=1)
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece spans a word boundary; texts can't be cut there")
        width = np.fromiter(map(len, self.pieces), np.int64, n)
        self.piece_width, self.piece_at = width, np.cumsum(width) - width
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        nodes, edges, ends = {"": 0}, [], {}
        for p, (score, i) in self.score.items():
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    edges.append(nodes[p[: k - 1]] << 21 | ord(p[k - 1]))
            ends[nodes[p]] = (score, i)
        pairs = np.array(sorted({p[k : k + 2] for p in self.score for k in range(len(p) - 1)}))
        self.joined = np.zeros(1 << PAIR_BITS, bool)  # by the hash of two characters side by side; a collision only cuts less
        if len(pairs):
            a, b = np.array([[ord(c) for c in p] for p in pairs], np.int64).T
            self.joined[self._pair(a, b)] = True
        self.node_score, self.node_id = np.full(len(nodes), NEVER, np.int64), np.full(len(nodes), -1, np.int32)
        for node, (score, i) in ends.items():
            self.node_score[node], self.node_id[node] = score, i
        self.bits = int(np.ceil(np.log2(max(2, len(edges))))) + 2
        self.slot_key, self.slot_node = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        key, node = np.array(edges, np.int64), np.arange(1, len(edges) + 1, dtype=np.int32)
        at, self.steps = self._slot(key), 1
        while len(key):
            free = np.flatnonzero(self.slot_key[at] < 0)
            taken, first = np.unique(at[free], return_index=True)
            own = free[first]
            self.slot_key[taken], self.slot_node[taken] = key[own], node[own]
            left = np.ones(len(key), bool)
            left[own] = False
            key, node, at = key[left], node[left], (at[left] + 1) & ((1 << self.bits) - 1)
            self.steps += 1

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b) * 0x85EBCA77 >> 20) & ((1 << PAIR_BITS) - 1)

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether all paths pass the boundary before each character."""
        out = np.ones(len(codes), bool)
        out[1:] = ~self.joined[self._pair(codes[:-1], codes[1:])]
        space = codes == ord(SPACE)
        out[1:] |= space[1:] & ~space[:-1]
        return out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * _MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node after each node and code point; 0 where no piece goes on."""
        key = node.astype(np.int64) << 21 | code
        at = self._slot(key)
        got = self.slot_key[at]
        same = got == key
        out = np.where(same, self.slot_node[at], 0)
        open_ = np.flatnonzero(~same & (got >= 0))
        for _ in range(self.steps):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.slot_key[at[open_]]
            same = got == key[open_]
            out[open_[same]] = self.slot_node[at[open_[same]]]
            open_ = open_[~same & (got >= 0)]
        return out


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def byte_ids(v: Vocabulary, char: str) -> list[int]:
    return [int(v.byte_id[b]) for b in char.encode("utf-8", "surrogatepass")]


def _utf8_size(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == LITERAL, 3, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))


class Windows:
    """The Viterbi recurrence over streams ``codes[first : first + length]``, the longest first, in step."""

    def __init__(self, v: Vocabulary, codes: np.ndarray, first: np.ndarray, length: np.ndarray):
        self.v, self.codes, self.first, self.length = v, codes, first, length
        n = len(first)
        self.base, self.back, self.pick = 0, [], []  # rows of the boundaries base + 1, base + 2, ...; a row has the streams that reach it
        self.done = np.zeros(n, np.int64)  # the last committed boundary of each stream
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.most_kept, self.next_look = 0, 2 * v.longest

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stream, boundary, id or -1 for bytes) of all pieces, in order."""
        v, n, ring = self.v, len(self.first), self.v.longest + 1
        best = np.zeros((ring, n), np.int64)  # by boundary modulo ring
        idx, start, node = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)  # open walks
        lasts = np.searchsorted(-self.length, -np.arange(int(self.length[0]) + 2), "right") if n else [0]
        for end in range(1, len(lasts) - 1):
            m = int(lasts[end])
            code = self.codes[self.first[:m] + end - 1]
            if lasts[end - 1] > m:
                own = idx < m
                idx, start, node = idx[own], start[own], node[own]
            idx, start, node = np.r_[idx, np.arange(m)], np.r_[start, np.full(m, end - 1)], np.r_[node, np.zeros(m, np.int32)]
            node = v.step(node, code[idx])
            own = np.flatnonzero(node)
            idx, start, node = idx[own], start[own], node[own]
            gain = v.node_score[node]
            at = np.flatnonzero(gain > NEVER)  # walks that are at the end of a piece; those that began first come first
            i, p = idx[at], start[at]
            s = best[p % ring, i] + gain[at]
            top = best[(end - 1) % ring, :m] + BYTE_SCORE * _utf8_size(code)
            np.maximum.at(top, i, s)
            won = np.flatnonzero(s == top[i])[::-1]
            back, pick = np.full(m, end - 1, np.int64), np.full(m, -1, np.int32)
            back[i[won]], pick[i[won]] = p[won], v.node_id[node[at[won]]]
            best[end % ring, :m] = top
            self.back.append(back)
            self.pick.append(pick)
            if len(self.back) >= self.next_look or lasts[end + 1] == 0:
                self._commit(end, int(lasts[end + 1]))
        return tuple(np.concatenate([o[k] for o in self.out] or [np.zeros(0, np.int64)]) for k in range(3))

    def _commit(self, end: int, running: int) -> None:
        """Give out what lies before the last boundary that all surviving paths share, stream by stream."""
        rows, n = len(self.back), len(self.back[0])
        self.most_kept = max(self.most_kept, rows)
        base, done, length = self.base, self.done[:n], self.length[:n]
        live = np.where(np.arange(n) < running, min(self.v.longest, end), np.where(done < length, 1, -1))
        passing = np.zeros((rows, n), np.int32)  # how many surviving paths pass each boundary
        passing[max(0, end - self.v.longest - base) :, :running] = 1
        over = np.flatnonzero(live[running:] > 0) + running
        passing[length[over] - base - 1, over] = 1
        shared = done.copy()
        for r in range(rows - 1, -1, -1):
            c = passing[r, : len(self.back[r])]
            on = np.flatnonzero(c)
            met = c[on] == live[on]
            shared[on[met]] = np.maximum(shared[on[met]], base + r + 1)
            on = on[~met]
            to = self.back[r][on]
            open_ = to > done[on]
            passing[to[open_] - base - 1, on[open_]] += c[on[open_]]
        used = np.zeros((rows, n), bool)
        new = np.flatnonzero(shared > done)
        used[shared[new] - base - 1, new] = True
        for r in range(rows - 1, -1, -1):
            on = np.flatnonzero(used[r, : len(self.back[r])])
            if len(on):
                to = self.back[r][on]
                open_ = to > done[on]
                used[to[open_] - base - 1, on[open_]] = True
                self.out.append((on, np.full(len(on), base + r + 1), self.pick[r][on]))
        self.done[:n] = shared
        if running:
            keep = int(self.done[:running].min())
            self.back, self.pick, self.base = [b[:running] for b in self.back[keep - base :]], [b[:running] for b in self.pick[keep - base :]], keep
            self.next_look = max(len(self.back) + self.v.longest, 2 * len(self.back))


def repeats(codes: np.ndarray, longest: int, least: int = RUN) -> list[tuple[int, int, int]]:
    """(period, start, end) of the stretches of at least ``least`` codes that repeat with a period of up to ``longest``."""
    out = []
    for q in range(1, min(longest, len(codes) - 1) + 1):
        differ = np.r_[-1, np.flatnonzero(codes[q:] != codes[:-q]), len(codes) - q]
        long = np.flatnonzero(np.diff(differ) + q - 1 >= least)
        out += [(q, int(differ[k]) + 1, int(differ[k + 1]) + q) for k in long]
    return out


@dataclass
class Rows:
    """Backpointers of the boundaries start + 1 .. end: the length and id of the last piece. Boundary b has row (b - origin - 1) modulo their number."""

    start: int
    end: int
    origin: int
    width: bytearray
    ids: array
    periodic: bool = False

    def down(self, b: int, ends: list[np.ndarray] | None = None, ids: list[np.ndarray] | None = None) -> int:
        """The boundary at or below ``start`` to which the path through b leads; its pieces, last first, go to ends and ids."""
        n, seen, path, names = len(self.width), {} if self.periodic else None, [], []
        while b > self.start:
            row = (b - self.origin - 1) % n
            if seen is not None and row in seen:
                above, first = seen[row]
                turn, seen = above - b, None
                times = (b - self.start) // turn
                if ends is not None and times:
                    again = np.array(path[first:]) - turn * np.arange(1, times + 1)[:, None]
                    ends += [np.array(path), again.ravel()]
                    ids += [np.array(names), np.tile(names[first:], times)]
                    path, names = [], []
                b -= times * turn
                continue
            if seen is not None:
                seen[row] = (b, len(path))
            if ends is not None:
                path.append(b)
                names.append(self.ids[row])
            b -= self.width[row]
        if path:
            ends.append(np.array(path))
            ids.append(np.array(names))
        return b


class Alone:
    """The Viterbi recurrence over one stream, with its long runs taken period by period."""

    def __init__(self, v: Vocabulary, codes: np.ndarray, runs: list[tuple[int, int, int]]):
        self.v, self.n, self.runs = v, len(codes), sorted(runs)
        self.text = np.where(codes == LITERAL, 0x10FFFF, codes).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        self.size = _utf8_size(codes).astype(np.uint8).tobytes()
        self.known: dict[str, list[tuple[int, int, int]]] = {}
        self.parts = [Rows(0, 0, 0, bytearray(), array("i"))]
        self.done, self.most_kept = 0, 0
        self.ends: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []

    def pieces(self, end: int) -> list[tuple[int, int, int]]:
        """(length, score, id) of the pieces that end at a boundary, the longest first."""
        window = self.text[max(0, end - self.v.longest) : end]
        got = self.known.get(window)
        if got is None:
            if len(self.known) >= 1 << 14:
                self.known.clear()
            tails = ((k, self.v.score.get(window[len(window) - k :])) for k in range(len(window), 0, -1))
            got = self.known[window] = [(k, *hit) for k, hit in tails if hit]
        return got

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(boundary, id or -1 for bytes) of all pieces, in order."""
        longest, since, end = self.v.longest, 0, 0
        best, width, ids = [0], bytearray(1), array("i", [-1])  # of the boundaries since .. end
        look = 2 * longest
        while end < self.n:
            end += 1
            top, k, name = None, 1, -1
            for length, gain, i in self.pieces(end):
                s = best[end - length - since] + gain
                if top is None or s > top:
                    top, k, name = s, length, i
            s = best[end - 1 - since] + BYTE_SCORE * self.size[end - 1]
            if top is None or s > top:
                top, k, name = s, 1, -1
            best.append(top)
            width.append(k)
            ids.append(name)
            last = self.parts[-1]
            last.width.append(k)
            last.ids.append(name)
            last.end = end
            if end < look and end < self.n:
                continue
            self._commit(end)
            period, to = self._returns(end, best, since)
            if period:
                self.parts.append(Rows(end, to, end - period, width[-period:], ids[-period:], True))
                self.parts.append(Rows(to, to, to, bytearray(), array("i")))
                gain = (to - end) // period * (best[-1] - best[-1 - period])
                best, since, end = [b + gain for b in best[-longest:]], to - longest + 1, to
                width, ids = bytearray(longest), array("i", [-1] * longest)
                if end == self.n:
                    self._commit(end)
            elif len(best) > 32 * longest:
                cut = len(best) - 10 * longest
                del best[:cut], width[:cut], ids[:cut]
                since += cut
            look = end + max(2 * longest, sum(len(p.width) for p in self.parts))
        none = [np.zeros(0, np.int64)]
        return np.concatenate(self.ends or none), np.concatenate(self.ids or none)

    def _returns(self, end: int, best: list[int], since: int) -> tuple[int, int]:
        """(period, boundary up to which whole periods go) if the window's relative scores are those of one period ago and the text repeats; else (0, end)."""
        longest = self.v.longest
        for q, first, last in self.runs:
            if first + longest <= end and last - end >= 4 * longest:
                for period in range(q, 8 * longest + 1, q):
                    if end - period - longest < max(first, since):
                        break
                    gain = best[-1] - best[-1 - period]
                    if (last - end) // period >= 2 and all(best[-j] - best[-j - period] == gain for j in range(1, longest + 1)):
                        return period, end + (last - end) // period * period
                break  # the shortest period stands for its multiples
        return 0, end

    def _commit(self, end: int) -> None:
        """Give out what lies before the boundary that all surviving paths share, if there is one."""
        self.most_kept = max(self.most_kept, sum(len(p.width) for p in self.parts))
        open_ = {end} if end == self.n else set(range(max(0, end - self.v.longest + 1), end + 1))
        for part in reversed(self.parts):
            if part.periodic:
                open_ = {part.down(b) for b in open_}
            else:
                while len(open_) > 1 and (b := max(open_)) > part.start:
                    open_.remove(b)
                    open_.add(b - part.width[b - part.origin - 1])
            if len(open_) == 1:
                break
        shared = min(open_)
        if len(open_) > 1 or shared <= self.done:
            return
        ends, ids, b = [], [], shared
        for part in reversed(self.parts):
            b = part.down(b, ends, ids)
        self.ends += [x[::-1] for x in reversed(ends)]
        self.ids += [x[::-1] for x in reversed(ids)]
        self.done = shared
        self.parts = [p for p in self.parts[:-1] if p.end > shared] + self.parts[-1:]
        head = self.parts[0]
        if head.start < shared:
            if not head.periodic:
                gone = shared - head.origin
                del head.width[:gone], head.ids[:gone]
                head.origin = shared
            head.start = shared


def viterbi(v: Vocabulary, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, number of ids of each stream) of the streams codes[first : first + length]."""
    order = np.argsort(-length, kind="stable")
    found, runs = [], repeats(codes, v.longest) if len(length) and length.max() >= RUN else []
    if runs:
        lone = {}
        by_start = np.argsort(first, kind="stable")
        begin, stop = first[by_start], (first + length)[by_start]
        for q, a, b in runs:
            for k in range(int(np.searchsorted(stop, a, "right")), int(np.searchsorted(begin, b))):
                lo, hi = max(a, int(begin[k])), min(b, int(stop[k]))
                if hi - lo >= RUN:
                    lone.setdefault(int(by_start[k]), []).append((q, lo - int(begin[k]), hi - int(begin[k])))
        for k, own in lone.items():
            end, ids = Alone(v, codes[first[k] : first[k] + length[k]], own).run()
            found.append((np.full(len(end), k), end, ids))
        order = order[~np.isin(order, list(lone))]
    for lo in range(0, len(order), STREAMS):
        some = order[lo : lo + STREAMS]
        stream, end, ids = Windows(v, codes, first[some], length[some]).run()
        found.append((some[stream], end, ids))
    stream, end, ids = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for k in range(3))
    order = np.lexsort((end, stream))
    stream, end, ids = stream[order], end[order], ids[order]
    raw = ids < 0
    last = codes[first[stream[raw]] + end[raw] - 1]
    width = np.ones(len(ids), np.int64)
    width[raw] = _utf8_size(last)
    out = np.repeat(ids, width)
    if len(last):
        chars = np.where(last == LITERAL, ord(SPACE), last).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        out[np.repeat(raw, width)] = v.byte_id[np.frombuffer(chars.encode("utf-8", "surrogatepass"), np.uint8)]
    return out.astype(np.int32), np.bincount(stream, width, minlength=len(first)).astype(np.int64)


class Memo:
    """Ids of streams by their hashes, sorted; begins anew beyond ``MEMO`` streams or eight times as many ids."""

    def __init__(self):
        self.key, self.at, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is unknown."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.searchsorted(self.key, key).clip(0, len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def add(self, key: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        """Sorted new keys and their ids."""
        if len(key) + len(self.key) > MEMO or len(flat) + len(self.pool) > 8 * MEMO:
            self.__init__()
            if len(key) > MEMO or len(flat) > 8 * MEMO:
                return
        to = np.searchsorted(self.key, key)
        self.at = np.insert(self.at, to, len(self.pool) + np.cumsum(n) - n)
        self.key, self.n, self.pool = np.insert(self.key, to, key), np.insert(self.n, to, n), np.r_[self.pool, flat]


def encode_batch(v: Vocabulary, texts: list[str], memo: Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, number of ids of each text)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    space = codes == 32
    codes[codes == ord(SPACE)] = LITERAL
    codes[space] = ord(SPACE)
    first = v.cuts(codes)
    cut = np.cumsum(size) - size
    first[cut[size > 0]] = True
    start = np.flatnonzero(first)
    length = np.diff(np.r_[start, len(codes)])
    doc = np.searchsorted(np.cumsum(size), start, "right")

    power = np.multiply.accumulate(np.full(int(length.max()), _MUL))
    within = np.arange(len(codes)) - np.repeat(start, length)
    with np.errstate(over="ignore"):
        key = mix64(np.add.reduceat(mix64(codes.astype(np.uint64)) * power[within], start) + length.astype(np.uint64))
    del space, first, within
    key, one, which = np.unique(key, return_index=True, return_inverse=True)
    memo = memo if memo is not None else Memo()
    known = memo.find(key)
    new = np.flatnonzero(known < 0)
    flat, n_new = viterbi(v, codes, start[one[new]], length[one[new]])
    n_ids, at = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    old = np.flatnonzero(known >= 0)
    n_ids[old], at[old] = memo.n[known[old]], memo.at[known[old]]
    n_ids[new], at[new] = n_new, len(memo.pool) + np.cumsum(n_new) - n_new
    pool = np.r_[memo.pool, flat]
    memo.add(key[new], flat, n_new)
    n = n_ids[which]
    total = np.cumsum(n)
    take = np.arange(total[-1]) + np.repeat(at[which] - (total - n), n)
    return pool[take], np.bincount(doc, n, minlength=len(texts)).astype(np.int64)


def decode_batch(v: Vocabulary, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of the texts whose ids are given."""
    width = v.piece_width[flat]
    end = np.cumsum(width)
    total = int(end[-1]) if len(end) else 0
    raw = v.piece_bytes[np.arange(total) + np.repeat(v.piece_at[flat] - (end - width), width)]
    return raw, np.r_[0, end][np.r_[0, np.cumsum(n)]]


def _batches(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    for b in batches:
        texts, at, total = b.column("text").to_pylist(), 0, 0
        for i, t in enumerate(texts):
            total += len(t or "")
            if total >= limit or i + 1 == len(texts):
                yield b.slice(at, i + 1 - at), texts[at : i + 1]
                at, total = i + 1, 0


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_ids, ids array<int>, restored (whether decoding the ids gave the text back)."""
    path = model_path or default_model()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, memo = vocabulary(path), Memo()
        for part, texts in _batches(batches):
            flat, n = encode_batch(v, [t or "" for t in texts], memo)
            gone = np.array([t is None for t in texts], bool)
            raw, off = text_buffers(part.column("text"))
            back, ends = decode_batch(v, flat, n)
            same = np.diff(off) == np.diff(ends)
            if not (same.all() and np.array_equal(raw, back)):
                same &= np.array([raw[off[i] : off[i + 1]].tobytes() == back[ends[i] : ends[i + 1]].tobytes() for i in range(len(n))], bool)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat), mask=pa.array(gone))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, mask=gone), lists, pa.array(same, mask=gone)], ["doc_id", "n_ids", "ids", "restored"])

    return docs.select("doc_id", "text").mapInArrow(bounded(run), f"doc_id {kind}, n_ids long, ids array<int>, restored boolean")


def decode(coded: DataFrame, model_path: str | None = None) -> DataFrame:
    """coded (doc_id, ids) -> doc_id, text; null ids are a null text."""
    path = model_path or default_model()
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = part.column("ids")
                n = np.array([len(x) if x.is_valid else 0 for x in ids], np.int64)
                flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                raw, off = decode_batch(v, flat, n)
                texts = [raw[off[i] : off[i + 1]].tobytes() if ids[i].is_valid else None for i in range(len(n))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(bounded(run), f"doc_id {kind}, text string")
