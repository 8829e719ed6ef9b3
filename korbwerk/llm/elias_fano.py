"""Elias-Fano sequences in flat arrays, searched for many values at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: A one in each byte, and in each byte's highest bit.
EACH, TOP = U64(0x0101010101010101), U64(0x8080808080808080)
#: At 256 * k + b, the position of the k-th one of the byte b.
IN_BYTE = np.array([([p for p in range(8) if b >> p & 1] + [0] * 8)[k] for k in range(8) for b in range(256)], dtype=np.int64)


#: Low bits are packed for so many values at once, a multiple of 64.
BLOCK = 1 << 16


def _words(raw: list[np.ndarray]) -> np.ndarray:
    """Bytes, lowest first, as 64-bit words with one spare word at the end."""
    raw = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
    out = np.zeros(len(raw) // 8 + 2, dtype="<u8")
    out.view(np.uint8)[: len(raw)] = raw
    return out


def _before(high: np.ndarray, zeros: bool) -> np.ndarray:
    """Number of ones, or zeros, of the unary part before each of its words."""
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
    return (64 * np.arange(len(ones), dtype=np.int64) - ones if zeros else ones).astype("<u4")


def build(values: np.ndarray, universe: int, searched: bool = True) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of fewer than 2**31 values below `universe`: low bits in full, high parts in unary, and the directory with which values are searched, or else with which places are."""
    n = len(values)
    low_bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    high = (values >> U64(low_bits)).astype(np.int64)
    unary = np.zeros(n + (int(universe) >> low_bits) + 2, dtype=np.uint8)
    unary[high + np.arange(n)] = 1
    each, lows = np.arange(low_bits, dtype=np.uint64), []
    for at in range(0, n if low_bits else 0, BLOCK):
        lows.append(np.packbits(((values[at : at + BLOCK, None] >> each) & U64(1)).astype(np.uint8).ravel(), bitorder="little"))
    unary = _words([np.packbits(unary, bitorder="little")])
    return {"meta": np.array([n, low_bits], dtype="<i8"), "low": _words(lows), "high": unary, "zeros" if searched else "ones": _before(unary, searched)}


class EliasFano:
    """Searches the arrays where they lie: with their directory, nothing is copied."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.bits = (int(x) for x in arrays[f"{name}.meta"])
        self.low_words, self.high_words = arrays[f"{name}.low"], arrays[f"{name}.high"]
        self._zeros, self._ones = arrays.get(f"{name}.zeros"), arrays.get(f"{name}.ones")

    @property
    def zeros(self) -> np.ndarray:
        if self._zeros is None:
            self._zeros = _before(self.high_words, True)
        return self._zeros

    @property
    def ones(self) -> np.ndarray:
        if self._ones is None:
            self._ones = _before(self.high_words, False)
        return self._ones

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Positions of the k-th (from 0) ones, or zeros if `flip`, of the unary part."""
        word = np.searchsorted(before, k.astype(np.uint32), "right") - 1
        left = (k - before[word]).astype(np.uint64)
        bits = ~self.high_words[word] if flip else self.high_words[word]
        # Each byte of `upto` has the number of ones up to and with that byte; the byte looked for is the first with more than `left`.
        upto = bits - ((bits >> U64(1)) & U64(0x5555555555555555))
        upto = (upto & U64(0x3333333333333333)) + ((upto >> U64(2)) & U64(0x3333333333333333))
        upto = ((upto + (upto >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * EACH
        shift = np.bitwise_count(((left * EACH) | TOP) - upto & TOP).astype(np.uint64) << U64(3)
        left -= ((upto << U64(8)) >> shift) & U64(255)
        byte = (bits >> shift) & U64(255)
        return 64 * word + shift.astype(np.int64) + IN_BYTE[((left << U64(8)) | byte).astype(np.int64)]

    def _ones_from(self, at: np.ndarray) -> np.ndarray:
        """Number of ones of the unary part from each position to the next zero; -1 where they reach the end of their word."""
        off = (at & 63).astype(np.uint64)
        bits = self.high_words[at >> 6] >> off
        run = np.bitwise_count(bits & ~(bits + U64(1))).astype(np.int64)
        return np.where(run + (at & 63) < 64, run, -1)

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        value = self.low_words[word] >> off
        more = np.where(off > 0, self.low_words[word + 1] << ((U64(64) - off) & U64(63)), U64(0))
        return (value | more) & U64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, self.ones, False) - i).astype(np.uint64) << U64(self.bits)) | self.low(i)

    def get_pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1; the later one is looked for right behind the earlier one."""
        at = self._select(i, self.ones, False)
        word, off = (at + 1) >> 6, ((at + 1) & 63).astype(np.uint64)
        bits = self.high_words[word] >> off
        gap = np.bitwise_count(~bits & (bits - U64(1))).astype(np.int64)
        after, far = at + 1 + gap, np.flatnonzero(bits == 0)
        after[far] = self._select(i[far] + 1, self.ones, False)
        return ((at - i).astype(np.uint64) << U64(self.bits)) | self.low(i), ((after - i - 1).astype(np.uint64) << U64(self.bits)) | self.low(i + 1)

    def find(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None) -> np.ndarray:
        """The place of each value within [lo, hi), by successor search within its bucket; -1 where it doesn't occur."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        high = (x >> U64(self.bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        fits = high <= last
        high = np.minimum(high, last)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) + 1, 0)
        i, run = start - high, self._ones_from(start)
        far = np.flatnonzero(run < 0)
        run[far] = self._select(high[far], self.zeros, True) - start[far]
        end = np.minimum(i + run, self.n if hi is None else hi)
        i = np.maximum(i, lo)
        want, out = x & U64((1 << self.bits) - 1), np.full(len(x), -1, np.int64)
        # Within a bucket the low bits ascend; dense buckets are halved, not scanned.
        open_ = np.flatnonzero(fits & (i < end))
        left, right = i[open_], end[open_]
        target, limit = want[open_], right.copy()
        todo = np.arange(len(open_))
        while len(todo):
            middle = (left[todo] + right[todo]) >> 1
            less = self.low(middle) < target[todo]
            left[todo[less]] = middle[less] + 1
            right[todo[~less]] = middle[~less]
            todo = todo[left[todo] < right[todo]]
        inside = np.flatnonzero(left < limit)
        inside = inside[self.low(left[inside]) == target[inside]]
        out[open_[inside]] = left[inside]
        return out
