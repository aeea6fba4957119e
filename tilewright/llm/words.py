"""Words, word hashes and shingles of whole Arrow batches, in numpy.

A word is a run of bytes other than space and tab to carriage return; ``A`` to ``Z`` count as small letters.
Hashes have 64 bits. Those of words take in eight bytes after the other and mix after each, so words of up to eight bytes
of one length never share a hash. Those of spans are sums of random byte values times powers of an odd number, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 22  # text handled at once; a longer text is a chunk of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(20240611).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray | np.uint64) -> np.ndarray:
    """Spread every bit over all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mixed(number: int) -> np.uint64:
    return mix(np.array([number % 2**64], np.uint64))[0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of a column of texts or their bytes: first row, bytes, and where each row's bytes begin and end. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(pa.scalar(b"").cast(column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    where = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    where = where[column.offset:column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(where, where[row] + most, "right")) - 1)
        last = min(last, len(column))
        yield row, data[where[row]:where[last]], where[row:last + 1] - where[row]
        row = last


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, the same wherever it stands."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row (and after the last)."""
    word = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    edges = where[(where > 0) & (where < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, where)


def hashed_words(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, and the number of words before each row (and after the last)."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, where)
    return word_hashes(low, starts, ends), first


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; the work grows with eighths of their lengths."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix((ends - starts).astype(np.uint64) + _BASE)
    left, active, at = ends - starts, np.arange(len(starts)), starts
    while len(active):
        cut = (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        value = (eights[at] << cut) >> cut
        out[active] = mix(out[active] ^ value)
        more = left > 8
        left, active, at = left[more] - 8, active[more], at[more] + 8
    return out


_FACTORS = [mixed(i + 1) | np.uint64(1) for i in range(64)]


def join_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring hashes."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out += hashes[i:i + count] * _FACTORS[i % 64] + np.uint64(i // 64)
    return mix(out + np.uint64(n))


def shingle_sets(hashes: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row its distinct ``n``-word shingles, ascending; fewer words make one shingle, none make none."""
    grams = join_hashes(hashes, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(grams[a:b - n + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            yield join_hashes(hashes[a:b], b - a)
        else:
            yield hashes[:0]
