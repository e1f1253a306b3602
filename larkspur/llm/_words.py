"""Array kernels over the UTF-8 bytes of whole texts, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs(texts: list[bytes] | list[str], step: int = _STEP) -> Iterator[tuple[int, int]]:
    """Split a list of texts into consecutive runs of about ``step`` bytes (characters of strings)."""
    first = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > step:
            yield first, k
            first, size = k, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _STEP + 1024)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        made = np.cumprod(up), np.cumprod(down)
        if size > 4 * _STEP:  # a very long text: not kept
            return made
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[e] - h[s] = hash of data[s:e] times base**s; len(data) + 1 values."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, wherever they stand."""
    down = _power(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def byte_table(word: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a byte of ``word``, byte with A-Z lower-cased)."""
    inside, low = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    inside[list(word)] = True
    if lower:
        low[65:91] += 32
    return inside, low


def words_of(texts: list[bytes], inside: np.ndarray, low: np.ndarray):
    """Words of joined texts: (hash, start, end, first word of each text and the total)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    flag = inside[joined].view(np.int8)
    edge = np.flatnonzero(np.diff(flag, prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    hashes = span_hash(prefix_hash(low[joined]), start, end)
    begins = np.cumsum([0] + [len(x) + 1 for x in texts])
    return hashes, start, end, np.searchsorted(start, begins)


NOT_SPACE = bytes(x for x in range(256) if x not in b" \t\n\v\f\r")
