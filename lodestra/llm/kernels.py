"""Vectorised text kernels over Arrow string columns.

A column of texts is one byte buffer with offsets, so words, windows and their hashes are computed for
many documents with a few numpy passes. Work goes in blocks of about BLOCK_BYTES, so the temporary
arrays stay small however long the column is; a block always holds whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_CODES = mix64(np.arange(1, 257, dtype=_U))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base & (2**64 - 1), dtype=_U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=_U)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive whole texts; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and where each text's words begin (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    inner = offsets[:-1]
    before[inner[inner < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends_at = offsets[1:]
    after[ends_at[ends_at > 0] - 1] = True
    solid = ~space
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from one prefix sum over the bytes."""
    if not len(starts):
        return np.zeros(0, _U)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_CODES[data] * powers(_BYTE_BASE, len(data)), dtype=_U, out=sums[1:])
    back = powers(inverse(_BYTE_BASE), len(data))
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U))


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within one text, and the index of each run's first word."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, _U)
    np.cumsum(hashes * powers(_WORD_BASE, n), dtype=_U, out=sums[1:])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    back = powers(inverse(_WORD_BASE), n)
    return mix64((sums[at + width] - sums[at]) * back[at] + _U(width)), at


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """The index of each run's first word alone."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.flatnonzero(text[: max(0, len(text) - width + 1)] == text[width - 1 :]) if len(text) >= width else np.zeros(0, np.int64)


def owners(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text each word index belongs to."""
    return np.searchsorted(first, at, "right") - 1
