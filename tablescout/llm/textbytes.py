"""Arrays over the UTF-8 bytes of a batch of texts: places of words, and hashes of byte ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: White space as the contract's words take it.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, size: int, rows: int | None = None):
    """Slices of a string column: ``(start, slice)``.

    Each has about ``size`` bytes, one text at least, and ``rows`` texts at most.
    """
    lengths = np.diff(buffer_of(texts)[1])
    part = np.cumsum(lengths) // size
    cut = np.diff(part, prepend=-1) != 0
    if rows is not None:
        cut[::rows] = True
    cuts = np.flatnonzero(cut)
    for a, b in zip(cuts, np.append(cuts[1:], len(lengths))):
        yield int(a), texts.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finishing steps of a well-known integer hash)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
#: The multiplier's inverse modulo 2**64.
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class RangeHash:
    """64-bit hashes of byte ranges of one buffer, in constant time each.

    The sum of byte values times powers of an odd number up to a place gives every range by
    difference; the power at its start is taken out by the inverse.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers(_MULTIPLIER, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(h + (end - start).astype(np.uint64) * _MULTIPLIER)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capital letters made small, in UTF-8; lengths stay."""
    out = _LOWER[data]
    if len(out) > 1:
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        v = data[second]
        second = second[(v >= 0x80) & (v <= 0x9E) & (v != 0x97)]
        out[second] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, first)``: the runs of non-white bytes, and each text's first word's index.

    ``first`` has one entry more than there are texts.
    """
    solid = ~SPACE[data]
    before = np.empty_like(solid)
    if len(solid):
        before[0] = False
        before[1:] = solid[:-1]
        # A text's first byte begins a word whatever precedes it in the buffer.
        before[offsets[:-1][offsets[:-1] < len(solid)]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    if len(solid):
        after[-1] = False
        after[:-1] = solid[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        after[ends] = False
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(start, offsets)
