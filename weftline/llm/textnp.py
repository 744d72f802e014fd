"""Words and word windows of whole Arrow batches as numpy arrays.

A *chunk* is a run of rows of one Arrow batch of about ``CHUNK_BYTES`` of UTF-8, or a single longer
text. All texts of a chunk are handled at once: no Python object is made for a word.
A word is a run of bytes other than space and 0x09-0x0D, which on UTF-8 equals the runs of
``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1_000_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_Q = np.uint64(0xD6E8FEB86659FD93)
#: The low bytes of a word of so many bytes.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Longest span that is hashed together with others; the few longer ones are hashed one by one.
_SHORT = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """``data`` (bytes), ``offsets`` (one more than rows), and the words found in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch):
        self.data, self.offsets, self.batch, self.rows = data, offsets, batch, len(offsets) - 1

    def words(self) -> "Chunk":
        """Fill ``starts``, ``ends`` (byte positions) and ``first`` (first word of each row, one more than rows); ``doc`` is the row of a word."""
        data, n = self.data, len(self.data)
        ink = ~_SPACE[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = True
            np.logical_or(~ink[:-1], cut[1:n], out=before[1:])
            after = np.empty(n, dtype=bool)
            after[-1] = True
            np.logical_or(~ink[1:], cut[1:n], out=after[:-1])
            self.starts, self.ends = np.flatnonzero(ink & before), np.flatnonzero(ink & after) + 1
        else:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.starts, self.offsets, "left")
        return self

    @functools.cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    @functools.cached_property
    def pos(self) -> np.ndarray:
        """Place of each word in its row."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], np.diff(self.first))

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, eight bytes at a time."""
        size = ends - starts
        raw = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        at = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
        out = mix((at[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _Q)
        rest = np.flatnonzero((size > 8) & (size <= _SHORT))
        done = 8
        while len(rest):
            out[rest] = mix(out[rest] ^ (at[starts[rest] + done] & _MASK[np.minimum(size[rest] - done, 8)]))
            done += 8
            rest = rest[size[rest] > done]
        for k in np.flatnonzero(size > _SHORT).tolist():
            out[k] = xxhash.xxh64_intdigest(self.data[starts[k] : ends[k]], 1)
        return out

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of k words that lie in one row, and the index of the first word of each."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.doc[: n] == self.doc[k - 1 :])
        h = hashes[:n].copy()
        for j in range(1, k):
            h *= _Q
            h += hashes[j : n + j]
        return mix(h[at]), at

    def per_row(self, flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sums of flags between successive bounds."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]


def texts(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], name: str = "text", size: int | None = None) -> Iterator[Chunk]:
    """Chunks of the batches, in order; empty batches give none."""
    size = size or CHUNK_BYTES
    for batch in batches:
        data, offsets = texts(batch, name)
        at = 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield Chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], batch.slice(at, to - at))
            at = to


def planes(x: np.ndarray) -> bytes:
    """The bytes of an integer array, byte plane by byte plane, so that the shuffle's compression removes the empty ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if x.size else b""


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_values)))
