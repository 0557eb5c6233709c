"""Counting quotient filters without loss: exact counters of packed id tuples as compact byte strings.

A tuple of three ids below 2^b (b even) is one number of 3b bits. A Feistel network permutes these numbers,
so that any set of them spreads evenly and every one can be turned back. The first bits are the range
(who merges the filter), the next ones the quotient; all others are kept as the remainder, so two tuples
never share a counter.

A filter holds one bit per quotient (occupied), and per used slot the remainder, a bit that ends a run, and a
bit that marks a counter digit. The slots of an entry are its remainder and then count - 1 in digits of the
slot's width; an entry that occurs once has no digit. Runs follow in the order of their quotients, so entries are
sorted and filters of different shards merge as sorted lists. Nothing is inserted in place, so empty slots
are not stored.
"""

from __future__ import annotations

import struct

import numpy as np

from pagelens.llm.shingles import mixed

ROUND_KEYS = tuple(np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(1, 5))
HEAD = struct.Struct("<BBBIII")


def id_bits(largest: int) -> int:
    """Bits of an id: even, so that a tuple has two equal halves; 42 at most."""
    bits = max(2, int(largest).bit_length())
    bits += bits % 2
    if bits > 42:
        raise ValueError("ids of more than 42 bits")
    return bits


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def permuted(ids: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) 64-bit parts of the permuted tuples."""
    a, b, c = (x.astype(np.uint64) for x in ids)
    half, low = bits // 2, (1 << (bits // 2)) - 1
    width = 3 * half
    left, right = (a << _u(half)) | (b >> _u(half)), ((b & _u(low)) << _u(bits)) | c
    for key in ROUND_KEYS:
        left, right = right, left ^ (mixed(right + key) >> _u(64 - width))
    return left >> _u(64 - width), (left << _u(width)) | right


def restored(high: np.ndarray, low: np.ndarray, bits: int) -> list[np.ndarray]:
    """The ids of permuted tuples."""
    half = bits // 2
    width = 3 * half
    mask = _u((1 << width) - 1)
    left, right = ((high << _u(64 - width)) | (low >> _u(width))) & mask, low & mask
    for key in reversed(ROUND_KEYS):
        left, right = right ^ (mixed(left + key) >> _u(64 - width)), left
    small = _u((1 << half) - 1)
    return [left >> _u(half), ((left & small) << _u(half)) | (right >> _u(bits)), right & _u((1 << bits) - 1)]


def shifted(high: np.ndarray, low: np.ndarray, by: int) -> np.ndarray:
    """The 128-bit numbers shifted right; the result must fit 64 bits."""
    if by >= 64:
        return high >> _u(by - 64) if by < 128 else np.zeros_like(high)
    return low >> _u(by) if by == 0 or not high.any() else (high << _u(64 - by)) | (low >> _u(by))


def counted(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct tuples with the sums of their counts (1 each by default)."""
    if not len(low):
        return high, low, np.zeros(0, np.int64)
    wide = high.any()
    if counts is None and not wide:
        low = np.sort(low)
    else:
        order = np.lexsort((low, high)) if wide else np.argsort(low, kind="stable")
        high, low = high[order], low[order]
        counts = counts[order] if counts is not None else None
    fresh = np.ones(len(low), bool)
    fresh[1:] = low[1:] != low[:-1]
    if wide:
        fresh[1:] |= high[1:] != high[:-1]
    at = np.flatnonzero(fresh)
    sums = np.diff(np.append(at, len(low))) if counts is None else np.add.reduceat(counts, at)
    return high[at], low[at], sums.astype(np.int64)


def build(high: np.ndarray, low: np.ndarray, counts: np.ndarray, bits: int, prefix: int) -> bytes:
    """The filter of sorted distinct tuples that share their first `prefix` bits."""
    n, width = len(low), 3 * bits
    q = max(0, min(max(n - 1, 1).bit_length(), width - prefix, 32))
    rest = width - prefix - q
    size = max(1, -(-rest // 8))
    quotient = shifted(high, low, rest) & _u((1 << q) - 1)
    kept_high = high & _u((1 << max(0, rest - 64)) - 1)
    kept_low = low & _u((1 << min(rest, 64)) - 1)
    remainder = np.stack([kept_high, kept_low], 1).astype(">u8").view(np.uint8).reshape(n, 16)[:, 16 - size :]
    step = min(size, 7)
    digits, left = np.zeros(n, np.int64), counts - 1
    while left.any():
        digits += left > 0
        left = left >> (8 * step)
    first = np.cumsum(digits + 1) - digits - 1
    used = n + int(digits.sum())
    slots, digit, ends = np.zeros((used, size), np.uint8), np.ones(used, bool), np.zeros(used, bool)
    slots[first] = remainder
    digit[first] = False
    left, k = counts - 1, 1
    while (more := np.flatnonzero(left > 0)).size:
        slots[first[more] + k, size - step :] = (left[more] & ((1 << (8 * step)) - 1)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - step :]
        left, k = left >> (8 * step), k + 1
    last = np.ones(n, bool)
    last[:-1] = quotient[1:] != quotient[:-1]
    ends[(first + digits)[last]] = True
    occupied = np.zeros(1 << q, bool)
    occupied[quotient.astype(np.int64)] = True
    top = int(shifted(high[:1], low[:1], width - prefix)[0]) if n else 0
    return HEAD.pack(bits, prefix, q, top, n, used) + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + np.packbits(digit).tobytes() + slots.tobytes()


class Filter:
    """A stored filter, opened for reading."""

    def __init__(self, data: bytes):
        self.bits, self.prefix, self.q, self.top, self.entries, self.used = HEAD.unpack_from(data)
        self.rest = 3 * self.bits - self.prefix - self.q
        self.size = max(1, -(-self.rest // 8))
        at, parts = HEAD.size, []
        for n in (1 << self.q, self.used, self.used):
            parts.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).view(bool))
            at += -(-n // 8)
        self.occupied, self.ends, self.digit = parts
        self.slots = np.frombuffer(data, np.uint8, self.used * self.size, at).reshape(self.used, self.size)

    def _numbers(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.zeros((len(slots), 16), np.uint8)
        wide[:, 16 - self.size :] = slots
        both = wide.view(">u8").astype(np.uint64)
        return both[:, 0], both[:, 1]

    def items(self, begin: int = 0, end: int | None = None, quotients: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(high, low, counts) of the entries in a range of whole runs, sorted; of all by default."""
        end = self.used if end is None else end
        quotients = np.flatnonzero(self.occupied) if quotients is None else quotients
        heads = begin + np.flatnonzero(~self.digit[begin:end])
        runs = np.cumsum(self.ends[begin:end]) - self.ends[begin:end]
        q = (quotients[runs[heads - begin]].astype(np.uint64) | _u(self.top << self.q)) if len(heads) else np.zeros(0, np.uint64)
        high, low = self._numbers(self.slots[heads])
        if self.rest >= 64:
            high |= q << _u(self.rest - 64)
        else:
            low |= q << _u(self.rest)
            if self.rest:
                high |= q >> _u(64 - self.rest)
        counts, step = np.ones(len(heads), np.int64), min(self.size, 7)
        following, k = np.append(heads[1:], end), 1
        while (more := np.flatnonzero(heads + k < following)).size:
            counts[more] += self._numbers(self.slots[heads[more] + k])[1].astype(np.int64) << (8 * step * (k - 1))
            k += 1
        return high, low, counts

    def count(self, high: int, low: int) -> int:
        """The count of one tuple, 0 if absent: rank of its quotient, end of the run of that rank, then the run alone."""
        number = (high << 64) | low
        quotient = (number >> self.rest) & ((1 << self.q) - 1)
        if not self.entries or number >> (3 * self.bits - self.prefix) != self.top or not self.occupied[quotient]:
            return 0
        run = int(self.occupied[:quotient].sum())
        ends = np.flatnonzero(self.ends)
        h, l, c = self.items(int(ends[run - 1]) + 1 if run else 0, int(ends[run]) + 1, np.array([quotient]))
        found = np.flatnonzero((h == _u(high)) & (l == _u(low)))
        return int(c[found[0]]) if len(found) else 0


def merged(filters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, counts) over several filters of one range."""
    parts = [Filter(f).items() for f in filters]
    return counted(*(np.concatenate(x) for x in zip(*parts)))


def split(high: np.ndarray, low: np.ndarray, counts: np.ndarray, bits: int, prefix: int):
    """(range, filter) for sorted distinct tuples, a filter for each value of the first `prefix` bits."""
    top = shifted(high, low, 3 * bits - prefix)
    at = np.flatnonzero(np.diff(top, prepend=top[:1] + _u(1))) if len(top) else []
    for a, z in zip(at, [*at[1:], len(top)]):
        yield int(top[a]), build(high[a:z], low[a:z], counts[a:z], bits, prefix)
