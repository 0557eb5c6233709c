"""Word shingles of whole texts as 64-bit identifiers, computed over the bytes of a batch at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWER, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of a factor modulo 2^64, extended as needed."""

    def __init__(self, factor: int):
        self.factor, self.values = np.uint64(factor), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            with np.errstate(over="ignore"):
                top = self.values[-1] * self.factor
                self.values = np.concatenate([self.values, self.values * top])
        return self.values[:n]


_UP, _DOWN = _Powers(_POWER), _Powers(_INVERSE)


def text_parts(texts: pa.Array, limit: int = 2 << 20, most: int = 1000) -> Iterator[pa.Array]:
    """The column in slices of about `limit` bytes (one text at least), so that work arrays stay small for long texts too."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        end = at + max(1, min(most, int(np.searchsorted(np.cumsum(sizes[at : at + most]), limit, "right"))))
        yield texts.slice(at, end - at)
        at = end


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE, table: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(identifiers, counts): of all words in order, and how many each text has. `gap` marks the bytes between words."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~gap[raw]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    start[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    begins, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[raw] * _UP.upto(n), out=sums[1:])
    ids = mixed((sums[ends] - sums[begins]) * _DOWN.upto(n)[begins] + (ends - begins).astype(np.uint64))
    return ids, np.diff(np.searchsorted(begins, offsets))


def sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct identifiers of its shingles of `size` words; a shorter sequence is one shingle."""
    raw, offsets = bytes_of(texts)
    ids, counts = words(raw, offsets)
    n = len(ids)
    factor = np.uint64(0xD6E8FEB86659FD93)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = rolled * factor
        rolled[: n - k if n > k else 0] += ids[k:]
    rolled = mixed(rolled + np.uint64(size))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for a, c in zip(at[:-1].tolist(), counts.tolist()):
        if c >= size:
            out.append(np.unique(rolled[a : a + c - size + 1]))
        elif c:
            total = np.zeros(1, np.uint64)
            for w in ids[a : a + c]:
                total = mixed(total * factor + w)
            out.append(mixed(total + np.uint64(c << 32)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
