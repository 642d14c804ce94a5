"""Numpy views of Arrow strings: bytes, words and hashes of a whole batch at once."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def flat(strings: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of strings or binaries; a null is empty."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    wide = strings.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    if len(wide) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = wide.buffers()
    offsets = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system. Workers outlive their tasks, and what one holds but does not use adds to the
    memory of the next task's workers and of its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The Arrow strings (or binaries) that the offsets cut from the bytes."""
    kind = kind or pa.large_string()
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(kind, len(offsets) - 1, buffers)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] numbers, then the next range."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each value; distinct values stay distinct."""
    x = x + MIX[0]
    x ^= x >> np.uint64(30)
    x *= MIX[1]
    x ^= x >> np.uint64(27)
    x *= MIX[2]
    x ^= x >> np.uint64(31)
    return x


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes between words: space and 0x09 to 0x0D, none of which occurs inside a longer UTF-8 character."""
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of words by text) of the words of all texts, in order; words never cross texts."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = is_space(data)
    begins = ~gap[1:-1] & gap[:-2]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] |= ~gap[1:-1][firsts]
    starts = np.flatnonzero(begins)
    ends = ~gap[1:-1] & gap[2:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] |= ~gap[1:-1][lasts]
    return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the spans, which are in order and don't overlap: bytes times powers, summed by span."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    places = ranges(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), MIX[0] | np.uint64(1), np.uint64))
    inside = ranges(np.zeros(len(starts), np.int64), lengths)
    terms = (data[places].astype(np.uint64) + np.uint64(1)) * powers[inside]
    first = np.cumsum(lengths) - lengths
    return mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64))
