"""Vectorised work on the UTF-8 bytes of a text column.

Arrow keeps the texts of a batch back to back in one buffer, so tokenising and
hashing them takes a few numpy passes over that buffer instead of a Python loop
over words.  Every function here takes ``buf`` (uint8) and ``off`` (int64, one
more entry than rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The byte is one of x20, x09-x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: The byte can stand in a word made of letters: a-z, A-Z and all of UTF-8's non-ASCII bytes.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(buf: np.ndarray, off: np.ndarray, max_bytes: int = 1 << 20, max_rows: int = 1000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``max_bytes``: first row, end row, bytes, offsets.  A longer row stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1
        hi = max(lo + 1, min(hi, n, lo + max_rows))
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        tables = []
        for base in (_P, _P_INV):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash, for span_hash."""
    up, _ = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from start to end, the same wherever they stand."""
    _, down = _power_tables(len(sums) - 1)
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """span_hash of every window of ``width`` bytes; slices in place of gathers."""
    _, down = _power_tables(len(sums) - 1)
    x = sums[width:] - sums[:-width]
    x *= down[: len(x)]
    x += np.uint64(width * 0xD6E8FEB86659FD93 % (1 << 64))
    return mix64(x)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross rows: starts, ends, and the run offsets of each row."""
    n = len(inside)
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0] = after[-1] = True
        np.logical_not(inside[:-1], out=before[1:])
        np.logical_not(inside[1:], out=after[:-1])
        before[off[:-1][off[:-1] < n]] = True
        ends = off[1:][off[1:] > 0]
        after[ends - 1] = True
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated, A-Z lower-cased words, and the word offsets of each row."""
    low = LOWER[buf]
    start, end, at = runs(~BLANK[low], off)
    return span_hash(prefix_hash(low), start, end), at


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]] for each i, along the first axis."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, at[:-1][full], axis=0)
    return out


def packed_counts(n: np.ndarray) -> tuple[bytes, bytes]:
    """Counts in a byte each; those of 255 or more apart."""
    return np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype(np.int64).tobytes()


def unpacked_counts(small: bytes, big: bytes) -> np.ndarray:
    n = np.frombuffer(small, np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(big, np.int64)
    return n
