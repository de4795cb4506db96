"""Word and shingle hashes of whole texts with numpy, one Arrow batch at a time.

Words are maximal runs of bytes other than space and \\t..\\r; A-Z count as a-z.
All values are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed together up to so many bytes; a longer text goes alone.
CHUNK = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; equal in, equal out, and one to one."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def constants(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODES = constants(11, 256)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of a base modulo 2**64, grown when a longer text comes."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, dtype=_U)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = _U(pow(self.base, len(self.values), 1 << 64))
            self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_BASE_INVERSE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and where each begins; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, in order, the hashes of its words."""
    data, offsets = text_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield from _hash_chunk(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def _hash_chunk(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    rows, size = len(offsets) - 1, len(data)
    if size == 0:
        yield from (np.zeros(0, dtype=_U) for _ in range(rows))
        return
    inside = ~_SPACE[data]
    cut = np.zeros(size + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~cut[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[_U(0)], np.cumsum(_CODES[_LOWER[data]] * _UP(size), dtype=_U)])
        hashes = mix((prefix[ends] - prefix[starts]) * _DOWN(size)[starts] + (ends - starts).astype(_U))
    place = np.searchsorted(starts, offsets)
    for i in range(rows):
        yield hashes[place[i] : place[i + 1]]


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words in order; of all words if there are fewer, none of none."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    factors = constants(100 + width, width)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) - width + 1, dtype=_U)
        for i in range(width):
            total = total + words[i : len(words) - width + 1 + i] * factors[i]
        return mix(total + _U(width))
