"""Words of whole texts as numpy arrays: positions, 64-bit hashes and n-gram hashes, straight from Arrow buffers.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return. UTF-8 keeps
those bytes out of longer characters, so byte positions cut texts at the same places as code points do.
Null texts count as empty. Texts are taken whole; ``slices`` only bounds how many of them are handled at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 19
_PIECE = 1 << 19

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) * np.uint64(0x9E3779B97F4A7C15))


_BASE = seeds(1, 1)[0] | np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = seeds(256, 2)
_BYTE[list(SPACES)] = 0
_BYTE_LOWER = _BYTE[_LOWER]
_STEP = seeds(1, 3)[0] | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _PIECE), _powers(_INVERSE, _PIECE)


class Texts:
    """Some consecutive texts: their bytes, where each begins, and where their words lie."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = _NOT_SPACE[data]
        first, last = inside.copy(), inside.copy()
        if data.size:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edges = offsets[:-1][np.diff(offsets) > 0]
            first[edges] = inside[edges]
            ends = offsets[1:][np.diff(offsets) > 0] - 1
            last[ends] = inside[ends]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # words of text i: bounds[i]:bounds[i + 1]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)

    def lowered(self) -> np.ndarray:
        return _LOWER[self.data]

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z lower-cased or as it stands."""
        table, out = (_BYTE_LOWER if lower else _BYTE), np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + _PIECE, "right")))
            n = int(self.ends[to - 1] - low)
            up, down = (_UP, _DOWN) if n <= _PIECE else (_powers(_BASE, n), _powers(_INVERSE, n))
            begins = self.starts[at:to] - low
            value = table[self.data[low : low + n]] * up[:n]
            out[at:to] = np.add.reduceat(value, begins) * down[begins]
            at = to
        return mix(out)

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have more than ``k`` bytes, and the hash of the first ``k`` of each, lower-cased."""
        rows = np.flatnonzero(self.ends - self.starts > k)
        place = self.starts[rows][:, None] + np.arange(k)
        return rows, mix((_BYTE_LOWER[self.data[place]] * _UP[:k]).sum(axis=1, dtype=np.uint64) + np.uint64(k))

    def code_points(self) -> np.ndarray:
        """Number of code points before each byte (one entry more than bytes)."""
        out = np.zeros(self.data.size + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values, whatever text they belong to."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _STEP + words[k : len(words) - n + 1 + k]
    return mix(out)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """The texts of an Arrow column in runs of about ``limit`` bytes, with the row each run begins at. A longer
    text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
