"""Small numpy helpers for variable-length byte strings held in one flat array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Ragged:
    """Byte strings laid end to end: ``data`` and the length of each one."""

    __slots__ = ("data", "lens")

    def __init__(self, data: np.ndarray, lens: np.ndarray):
        self.data, self.lens = data, lens

    def fold(self, counts: np.ndarray) -> Ragged:
        """Join each run of ``counts[i]`` neighbours into one string."""
        return Ragged(self.data, sums(self.lens, counts))

    def take(self, index: np.ndarray) -> Ragged:
        lens = self.lens[index]
        starts = (np.cumsum(self.lens) - self.lens)[index]
        return Ragged(self.data[spans(starts, lens)], lens)

    def to_arrow(self, nulls: np.ndarray | None = None) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum(self.lens))).astype(np.int64)
        arr = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.lens), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data))])
        return arr.cast(pa.binary())

    @staticmethod
    def from_arrow(arr: pa.Array) -> Ragged:
        arr = arr.cast(pa.large_binary())
        offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset: arr.offset + len(arr) + 1]
        if len(arr) == 0:
            return Ragged(np.empty(0, np.uint8), np.empty(0, np.int64))
        body = arr.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.empty(0, np.uint8)
        return Ragged(data, np.diff(offsets))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i]+lens[i]-1`` for every i, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = starts - (np.cumsum(lens) - lens)
    return np.repeat(shift, lens) + np.arange(total)


def weave(columns: list[Ragged]) -> Ragged:
    """Concatenate several columns of byte strings row by row."""
    lens = sum(c.lens for c in columns)
    out = np.empty(int(lens.sum()), np.uint8)
    at = np.cumsum(lens) - lens
    for c in columns:
        out[spans(at, c.lens)] = c.data
        at = at + c.lens
    return Ragged(out, lens)


def constant(body: bytes, n: int) -> Ragged:
    return Ragged(np.tile(np.frombuffer(body, np.uint8), n), np.full(n, len(body), np.int64))


def varints(values: np.ndarray) -> Ragged:
    """Base-128 varints of unsigned integers."""
    v = np.asarray(values).astype(np.uint64)
    if not len(v):
        return Ragged(np.empty(0, np.uint8), np.empty(0, np.int64))
    width = max(1, -(-int(v.max()).bit_length() // 7))
    if width == 1:
        return Ragged(v.astype(np.uint8), np.ones(len(v), np.int64))
    kind = np.uint32 if width <= 4 else np.uint64
    groups = v.astype(kind)[:, None] >> (np.arange(width, dtype=kind) * kind(7))
    n = 1 + (groups[:, 1:] != 0).sum(axis=1)
    place = np.arange(width)
    out = (groups & kind(127)).astype(np.uint8)
    out |= np.where(place < (n - 1)[:, None], 128, 0).astype(np.uint8)
    return Ragged(out[place < n[:, None]], n.astype(np.int64))


def varint_sizes(values: np.ndarray) -> np.ndarray:
    """Bytes that each value takes as a varint."""
    v = np.asarray(values).astype(np.uint64)
    return np.searchsorted(np.array([1 << 7 * k for k in range(1, 10)], np.uint64), v, side="right") + 1


def read_varints(data: np.ndarray) -> np.ndarray:
    """All varints of a packed byte string."""
    if not len(data):
        return np.empty(0, np.uint64)
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    part = (data & 127).astype(np.uint64) << (place * 7).astype(np.uint64)
    return np.add.reduceat(part, first)


def zigzag(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.int64)
    return (v << 1) ^ (v >> 63)


def unzigzag(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.int64)
    return (v >> 1) ^ -(v & 1)
