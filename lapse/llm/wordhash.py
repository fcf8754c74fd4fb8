"""Words and word-window hashes of Arrow string columns, in numpy on the raw UTF-8 bytes.

A word is a run of bytes other than space and \\t..\\r.  Work goes through a batch
in slices of about SLICE bytes (at least one whole text), so memory follows the slice
and the longest text, not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_R = U(0x9E3779B97F4A7C15)
_Q = U(0xD6E8FEB86659FD93)


def _inverse(a: np.uint64) -> np.uint64:
    return U(pow(int(a), -1, 1 << 64))


_RI, _QI = _inverse(_R), _inverse(_Q)
_powers: dict = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE):
    """Ranges of texts of about ``limit`` bytes together, at least one text each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every word, and for each text its first word (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]      # a text border also ends a word
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word."""
    if not len(start):
        return np.zeros(0, np.uint64)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_R, len(data)), out=s[1:])
    h = (s[end] - s[start]) * powers(_RI, len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words: len(h) - k + 1 values (windows may cross texts)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_Q, len(h)), out=s[1:])
    return mix((s[k:] - s[:n]) * powers(_QI, len(h) + 1)[:n] + U(k))
