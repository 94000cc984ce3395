"""Shared helpers: table reading, checkpoints, and numpy kernels over Arrow string buffers.

The kernels treat a batch of texts as one contiguous byte buffer, so no work is done per
document in Python. A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which is the
same set of words that the regular expression ``[^\\x20\\x09-\\x0D]+`` finds in the decoded text.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"

#: Texts are handled in chunks of about this many bytes, which bounds a worker's memory.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir; a folder of our own only in local mode, where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomspark-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives a lost executor and cuts the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_memory() -> None:
    """Give freed memory back to the system: workers and the driver handle several stages in one process."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


#: Functions get slices of at most this many rows of an Arrow batch, so what they make from one is bounded.
ARROW_ROWS = 2000


def bounded(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gets small batches and gives memory back when its task is over."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, max(1, b.num_rows), ARROW_ROWS):
                yield b.slice(lo, ARROW_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(slices(batches))
        release_memory()

    return run


def crc_mod(col: str, m: int):
    """crc32 of the id as text, modulo m."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- numpy kernels

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_TABLE = _LOWER.tobytes()
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for i, p in enumerate((_P, _P_INV)):
                t = np.full(size, p, np.uint64)
                t[0] = 1
                _powers[i] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of a 64-bit hash (murmur3 constants)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, nulls as empty texts; offsets start at 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about CHUNK_BYTES of text each: (slice, bytes, offsets)."""
    for batch in batches:
        raw, off = text_buffers(batch.column(column))
        at = 0
        while at < len(off) - 1:
            end = int(np.searchsorted(off, off[at] + CHUNK_BYTES, "right")) - 1
            end = min(max(end, at + 1), len(off) - 1)
            yield batch.slice(at, end - at), raw[off[at] : off[end]], off[at : end + 1] - off[at]
            at = end


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().translate(LOWER_TABLE), np.uint8)


#: Letters: A-Z, a-z and every byte of a character outside ASCII.
_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[65:91] = _NO_LETTER[97:123] = _NO_LETTER[128:] = False


def word_spans(raw: np.ndarray, off: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word, in order; with ``letters``, of each run of letters."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~(_NO_LETTER if letters else _IS_SPACE)[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = off[1:-1]
    cut = cut[cut < n]
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = cut[cut > 0]
    last[cut - 1] = solid[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[start:end] for each span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        acc = np.empty(len(raw) + 1, np.uint64)
        acc[0] = 0
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=acc[1:])
        h = (acc[end] - acc[start]) * inverse[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of n consecutive words of one document."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ words[i : i + m]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
    same = doc[:m] == doc[n - 1 :]
    return mix64(h[same]), doc[:m][same]
