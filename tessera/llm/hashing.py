"""Vectorised word hashing over Arrow string columns.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D``.  All texts of a chunk are hashed together with
numpy: a polynomial prefix sum over the bytes gives every word a 64-bit hash, and a second polynomial
over word hashes gives every window of ``k`` words one (Rabin-Karp).  Two windows with equal words have
equal hashes in every process; different windows collide with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_CHECK_BASE = 0x165667B19E3779F9
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), base, _U)
        out[0] = 1
        have = _powers[name] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that low bits and order of a hash look random."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


@dataclass
class Chunk:
    """Consecutive rows of a batch: ``lo`` is the first row; ``first[i]:first[i+1]`` are the words of row lo+i."""

    lo: int
    rows: int
    raw: np.ndarray
    bytes_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of k words that begin at each word, and which words begin one within their row."""
        n = len(self.hash)
        g = np.zeros(n, _U)
        if n:
            for j in range(min(k, n)):
                g[: n - j] += self.hash[j:] * _U(pow(_WORD_BASE, j + 1, 1 << 64))
        last = np.repeat(self.first[1:], np.diff(self.first))
        return mix(g), np.arange(n) + k <= last

    def checks(self, k: int, at: np.ndarray) -> np.ndarray:
        """Another 32 bits for the windows of k words that begin at the words ``at``, by a second polynomial."""
        g = np.zeros(len(at), _U)
        for j in range(k):
            g += self.hash[at + j] * _U(pow(_CHECK_BASE, j + 1, 1 << 64))
        return (mix(g) >> _U(32)).astype(np.uint32).view(np.int32)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))


def text_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(buf)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[buf] * _power_table("up", _BASE, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power_table("down", pow(_BASE, -1, 1 << 64), n + 1)[start])


def chunks(col: pa.Array, *, lower: bool = False, chunk_bytes: int = CHUNK_BYTES, word_bytes: np.ndarray | None = None, table: np.ndarray | None = None) -> Iterator[Chunk]:
    """Cuts a column into chunks of whole rows of about ``chunk_bytes``; a longer row is a chunk of its own.

    ``word_bytes`` (a flag for each byte) and ``table`` (a byte for each byte) replace the default idea of a word.
    """
    table = _LOWER if lower else table
    word_bytes = ~_WS if word_bytes is None else word_bytes
    data, at = text_column(col)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + chunk_bytes, "right")) - 1)
        raw = data[at[lo] : at[hi]]
        buf = raw if table is None else table[raw]
        off = at[lo : hi + 1] - at[lo]
        word = word_bytes[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[off] = True
        begins, ends = word.copy(), word.copy()
        if len(buf):
            begins[1:] &= ~word[:-1] | cut[1:-1]
            ends[:-1] &= ~word[1:] | cut[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Chunk(lo, hi - lo, raw, off, start, end, np.searchsorted(start, off), hash_words(buf, start, end) if len(start) else np.zeros(0, _U))
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind or pa.int64()))
