"""Words and word shingles of Arrow text columns as 64-bit hashes, computed on whole buffers with NumPy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case. Hashes are the same on every
machine. Two different shingles share a hash with a chance of about 5e-20.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: NumPy holds about a hundred bytes for each of these in every running task.
CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.Generator(np.random.PCG64(2024)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


class _Powers:
    """Powers of an odd number modulo 2^64, as many as the longest text asked for needed."""

    def __init__(self, base: int) -> None:
        self.base, self.known = np.uint64(base), np.ones(1, np.uint64)

    def __call__(self, count: int) -> np.ndarray:
        while len(self.known) < count:
            with np.errstate(over="ignore"):
                step = self.known[-1:] * self.base
                self.known = np.concatenate([self.known, self.known * step])
        return self.known[:count]


_FORTH, _BACKWARD = _Powers(_BASE), _Powers(_BACK)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, row offsets)`` of about ``CHUNK_BYTES`` each; a longer text is a chunk of its own. Null is empty."""
    binary = texts.cast(pa.large_binary()) if texts.null_count == 0 else texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2], np.uint8) if binary.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(binary):
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(binary))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, hashes, word offsets of the rows)`` of one chunk. Words end where their row ends."""
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = before[1:] & solid[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[_LOWER[data]] * _FORTH(len(data)), out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * _BACKWARD(len(data) + 1)[starts])
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, row offsets)`` of all shingles of ``size`` words; a shorter row is one shingle, an empty one has none."""
    counts = np.diff(rows)
    with np.errstate(over="ignore"):
        multipliers = [np.uint64(pow(_BASE, 3 * j + 5, 2**64)) for j in range(size)]
        total = np.zeros(len(hashes), np.uint64)
        for j, m in enumerate(multipliers):
            if j < len(hashes):
                total[: len(hashes) - j] += hashes[j:] * m
        short = np.flatnonzero((counts > 0) & (counts < size))
        for row in short:
            own = hashes[rows[row] : rows[row + 1]]
            total[rows[row]] = (own * np.array(multipliers[: len(own)], np.uint64)).sum() + np.uint64(len(own))
        total = mixed(total)
    per_row = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate([[0], np.cumsum(per_row)])
    taken = np.repeat(rows[:-1] - offsets[:-1], per_row) + np.arange(offsets[-1])
    return total[taken], offsets


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct shingle hashes)`` of every row."""
    for first, data, offsets in text_chunks(texts):
        _, _, hashes, rows = words(data, offsets)
        found, bounds = shingles(hashes, rows, size)
        for i in range(len(bounds) - 1):
            own = np.sort(found[bounds[i] : bounds[i + 1]])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield first + i, own
