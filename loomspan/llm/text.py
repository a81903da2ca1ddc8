"""Words of whole Arrow columns as numpy arrays.

A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. All functions work on the UTF-8
buffer of an Arrow string column, so that no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE_BYTES = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def series(n: int, seed: int) -> np.ndarray:
    """n fixed random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def byte_table(space: np.ndarray = _SPACE, seed: int = 11) -> np.ndarray:
    """A random number for each byte; 0 for white space, the same for either case of A-Z."""
    table = series(256, seed)
    table[65:91] = table[97:123]
    table[space] = 0
    return table


_BYTES = byte_table()
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of a fixed odd number, modulo 2 to the 64."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS = np.cumprod(np.full(size, 0xD6E8FEB86659FD93, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return _POWERS


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the place where each row begins, with the end of the last. Null: no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(column: pa.Array, table: np.ndarray = _BYTES, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end, place): the 64-bit hash of each word and its bytes; the words of row i stand at place[i]:place[i + 1].

    space and table say which bytes divide words, and the weight of the others. The column is worked in pieces of
    about PIECE_BYTES, each ending with a row or white space, so that memory does not follow the longest text.
    """
    data, at = buffers(column)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0
    while low < len(data):
        high = min(low + PIECE_BYTES, len(data))
        while high < len(data):
            blank = np.flatnonzero(space[data[high : high + PIECE_BYTES]])
            high = high + int(blank[0]) + 1 if len(blank) else min(high + PIECE_BYTES, len(data))
            if len(blank):
                break
        found.append(_piece(data, at, low, high, table, space))
        low = high
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    hashes, first, end = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, first, end, np.searchsorted(first, at)


def _piece(data: np.ndarray, at: np.ndarray, low: int, high: int, table: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = data[low:high]
    inside = ~space[part]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low
    begins[rows] = inside[rows]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64), first, first
    length = np.diff(np.append(first, len(part)))
    place = np.arange(first[0], len(part)) - np.repeat(first, length)
    weighed = table[part[first[0] :]] * powers(len(part))[place]
    count = np.add.reduceat(inside[first[0] :].astype(np.int64), first - first[0])
    hashes = mix(np.add.reduceat(weighed, first - first[0]) + count.astype(np.uint64))
    return hashes, first + low, first + count + low


def chunks(batches: Iterator[pa.RecordBatch], size: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about size bytes of text each, one row at least."""
    for batch in batches:
        _, at = buffers(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high
