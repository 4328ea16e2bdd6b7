"""Shared plumbing of the text operators: tables, scratch space, word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sensorloom.storage import materialise, scratch_dir  # noqa: F401  (for the operators)


#: Rows of a broadcast side are counted first; beyond this the join shuffles instead.
BROADCAST_ROWS = 500_000
#: Bytes of text handled at once inside a Python worker.
CHUNK_BYTES = 1 << 20
#: Java / SQL pattern of a white-space delimited word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None


def release() -> None:
    """Give unused memory of Arrow and numpy back: a worker lives on through many stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` that hold about ``limit`` bytes of text each (one row at least).

    What the ranges used is given back when the batch ends.
    """
    n = batch.num_rows
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi
    release()


def text_bytes(batch: pa.RecordBatch, lo: int, hi: int, column: str = "text") -> list[bytes]:
    """UTF-8 of rows ``lo`` to ``hi``; a null text is empty."""
    return [x or b"" for x in batch.column(column).slice(lo, hi - lo).cast(pa.binary()).to_pylist()]


# --- vectorised hashing of words -------------------------------------------------------------

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_powers = np.ones(1, dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[_U(1), np.full(max(n, 1024), _BASE, dtype=np.uint64)])
    return _powers[:n]


class Words:
    """Words of a run of texts: byte spans, 64-bit hashes and each text's range of words."""

    __slots__ = ("buf", "starts", "ends", "hashes", "bounds")

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b" ".join(texts)
        buf = np.frombuffer(joined, dtype=np.uint8)
        space = SPACE[buf]
        edge = np.diff(np.r_[True, space, True].astype(np.int8))
        self.buf, self.starts, self.ends = joined, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = _hash_spans(LOWER[buf] if lower else buf, self.starts, self.ends)

    def span(self, first: int, last: int) -> bytes:
        """Bytes from word ``first`` to word ``last``, inclusive, as written."""
        return self.buf[self.starts[first] : self.ends[last]]


def _hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, side="right")))
        lens = ends[lo:hi] - starts[lo:hi]
        first = np.cumsum(lens) - lens
        within = np.arange(int(lens.sum())) - np.repeat(first, lens)
        with np.errstate(over="ignore"):
            terms = _BYTE_VALUES[buf[np.repeat(starts[lo:hi], lens) + within]] * powers(int(lens.max()))[within]
            out[lo:hi] = mix64(np.add.reduceat(terms, first) + lens.astype(np.uint64))
        lo = hi
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words; empty when there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            total = total * _U(_BASE) + hashes[k : k + m]
        return mix64(total)
