"""Whole texts as numpy arrays: blocks of an Arrow column, words, and 64-bit hashes of words and word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; one longer text is a block of its own.
BLOCK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with at most `limit` bytes of text: (rows, their bytes, offsets of each row). Null texts are empty."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_HELD: dict[object, object] = {}


def held(key: object, make):
    """make(), kept in this worker until another key is asked for: a worker serves many stages and should not hold what
    earlier ones needed."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finalizer, a published fixed function)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n."""
    have = _HELD.get("powers")
    if have is None or len(have[0]) <= n:
        size = (n >> 18) + 1 << 18
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _HELD.clear()
        have = _HELD["powers"] = (both[0], both[1])
    return have


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Words `[^\x20\x09-\x0D]+` of every row: starts, ends, and the first word of each row (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n + 1, bool)  # a space, or nothing, stands before this byte
    before[1:] = ~word
    starts = np.flatnonzero(word & (before[:-1] | edge[:-1]))
    after = np.ones(n, bool)
    after[:-1] = ~word[1:]
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z taken as a-z if lower."""
    power, inverse = _powers(len(data))
    table = _BYTE[_LOWER] if lower else _BYTE
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words within a row: (hashes, first window of each row, one more at the end)."""
    count = np.maximum(np.diff(first) - (k - 1), 0)
    at = np.zeros(len(first), np.int64)
    np.cumsum(count, out=at[1:])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    power, inverse = _powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    start = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count)
    return mix((total[start + k] - total[start]) * inverse[start] + np.uint64(k)), at


def crc32(column: str) -> str:
    """Spark SQL for crc32 of an integer written as text."""
    return f"crc32(cast(cast({column} as string) as binary))"
