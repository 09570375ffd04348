"""Words of many texts at once, as numpy arrays over an Arrow string buffer.

A chunk holds the bytes of consecutive whole texts. Words are byte spans; their 64-bit
hashes are read eight bytes at a time, so the cost is per word and not per byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
LONG_WORD = 512
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that belong to words: all but white space; or digits, a-z and every byte of non-ASCII letters.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class Chunk(NamedTuple):
    rows: pa.RecordBatch
    data: np.ndarray  # bytes of the texts, with eight more at the end
    offsets: np.ndarray  # of the texts in data; one more than there are rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, in place."""
    x ^= x >> np.uint64(32)
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(8, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    out = np.zeros(at[-1] - at[0] + 8, np.uint8)
    out[:-8] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return out, at - at[0]


def chunks(batches: Iterable[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut batches into runs of whole texts of about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column(text)).fill_null(0))
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            part = batch.slice(at, to - at)
            yield Chunk(part, *buffer_of(part.column(text)))
            at = to


def spans(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it (one more than texts)."""
    n = len(data) - 8
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = letters[data[:n]]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(here & ~before)
    return starts, np.flatnonzero(here & ~after) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + _M1)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    live, k = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        out[live] = mix(out[live] ^ (eight[starts[live] + k] & _TAIL[np.minimum(size[live] - k, 8)]))
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def rows_of(counts_before: np.ndarray) -> np.ndarray:
    """For each word the row of its text."""
    return np.repeat(np.arange(len(counts_before) - 1), np.diff(counts_before))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of spans as an Arrow binary array."""
    size = ends - starts
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    where = np.arange(at[-1]) + np.repeat(starts - at[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data[where])])
