"""Elias-Fano sequences and the two levels of an n-gram trie made of them.

A sequence of ascending numbers keeps its lower bits in an array and its upper bits in unary. Searches
are vectorised: many values are looked up at once, without unpacking the sequence. All parts are flat
arrays, so a trie can be written to one file and mapped into memory.

A context's successors stand between two pointers. A successor is its context's rank, in unary, and a
key of :data:`KEY_BITS` lower bits, so between the pointers the lower bits alone are searched. Two of the
``n`` successors of one context share a key, and so are counted as one, with a chance of about ``n * n /
2**41``: for a context with 100,000 different successors that is one in 220.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: log10 probabilities are kept in two bytes: 0 is "absent", then steps of this size downwards from 0.
STEP = 0.03
CODE = np.uint16

#: The probability of each code. The last is below 10^-30, and one in all 64-bit counts is above 10^-19.
LEVELS = np.append(0.0, 10.0 ** (-STEP * np.arange(1023)))


def quantise(probability: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(probability) / STEP) + 1, 1, len(LEVELS) - 1).astype(CODE)


class Sequence:
    """An ascending sequence of 64-bit numbers: ``meta`` (n, lower bits), ``low``, ``high``, ``zeros``."""

    def __init__(self, meta: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits = (int(x) for x in meta)
        self.meta, self.low, self.high, self.zeros = meta, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray, bits: int | None = None) -> Sequence:
        """``bits`` is the number of lower bits, unless given that which takes least space."""
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1) if bits is None else bits
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        low = np.zeros((n * bits >> 6) + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        upper = (values >> np.uint64(bits)).astype(np.int64)
        size = (n + (top >> bits) + 2 + 63) // 64 * 64
        ones = np.zeros(size, np.uint8)
        ones[upper + np.arange(n)] = 1
        high = np.packbits(ones)
        zeros = 64 * np.arange(1, size // 64 + 1) - np.cumsum(ones.reshape(-1, 64).sum(1, dtype=np.int64))
        return cls(np.array([n, bits]), low, high, zeros)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        start = at.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
        value = self.low[word] >> shift
        over = np.flatnonzero(shift)
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & np.uint64((1 << self.bits) - 1)

    def _below(self, upper: np.ndarray) -> np.ndarray:
        """How many elements have a smaller upper part: the place of a zero in the unary code."""
        out = np.zeros(len(upper), np.int64)
        for a in range(0, len(upper), 1 << 14):
            want = upper[a : a + (1 << 14)]
            some = np.flatnonzero(want > 0)
            rank = want[some]  # the zero that ends the part before
            block = np.minimum(np.searchsorted(self.zeros, rank), len(self.zeros) - 1)
            before = np.where(block > 0, self.zeros[block - 1], 0)
            bits = np.unpackbits(self.high.reshape(-1, 8)[block], axis=1)
            inside = (np.cumsum(1 - bits.astype(np.int16), axis=1) < (rank - before)[:, None]).sum(1)
            out[a + some] = 64 * block + inside + 1 - rank
        return np.minimum(out, self.n)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The elements at these places: the upper part is how many zeros stand before their one."""
        ones = 64 * np.arange(1, len(self.zeros) + 1) - self.zeros
        out = np.empty(len(at), np.uint64)
        for a in range(0, len(at), 1 << 14):
            rank = at[a : a + (1 << 14)]
            block = np.searchsorted(ones, rank, "right")
            before = np.where(block > 0, ones[block - 1], 0)
            bits = np.unpackbits(self.high.reshape(-1, 8)[block], axis=1)
            inside = (np.cumsum(bits, axis=1, dtype=np.int16) <= (rank - before)[:, None]).sum(1)
            out[a : a + len(rank)] = 64 * block + inside - rank
        return out << np.uint64(self.bits) | self._low(at)

    def find_low(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place from ``start`` up to ``end`` whose lower bits are these, or -1. They ascend there."""
        lo, hi, active = start.copy(), end.copy(), np.flatnonzero(start < end)
        while len(active):
            middle = (lo[active] + hi[active]) >> 1
            less = self._low(middle) < low[active]
            lo[active[less]] = middle[less] + 1
            hi[active[~less]] = middle[~less]
            active = active[lo[active] < hi[active]]
        hit = np.flatnonzero(lo < end)
        hit = hit[self._low(lo[hit]) == low[hit]]
        out = np.full(len(low), -1)
        out[hit] = lo[hit]
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of the first element that is at least the value, or -1 if that is another number."""
        if not self.n:
            return np.full(len(values), -1)
        upper = (values >> np.uint64(self.bits)).astype(np.int64)
        last = 64 * len(self.zeros) - self.n - 1
        beyond = upper > last
        upper = np.minimum(upper, last)
        lo, end = self._below(upper), self._below(upper + 1)
        end = np.where(upper == last, self.n, end)
        want = values & np.uint64((1 << self.bits) - 1)
        hi = end.copy()
        while (open_ := lo < hi).any():
            middle = (lo + hi) >> 1
            less = self._low(np.minimum(middle, self.n - 1)) < want
            lo = np.where(open_ & less, middle + 1, lo)
            hi = np.where(open_ & ~less, middle, hi)
        hit = (lo < end) & (self._low(np.minimum(lo, self.n - 1)) == want) & ~beyond
        return np.where(hit, lo, -1)

    def arrays(self) -> list[np.ndarray]:
        return [self.meta.astype(np.int64), self.low, self.high, self.zeros.astype(np.int64)]


#: Bits of a successor's key, relative to its context.
KEY_BITS = 40


class Trie:
    """Contexts, pointers to their successors, successors relative to contexts, and their codes."""

    def __init__(self, contexts: Sequence, pointers: Sequence, successors: Sequence, codes: np.ndarray):
        self.contexts, self.pointers, self.successors = contexts, pointers, successors
        self.codes = codes

    @classmethod
    def of(cls, contexts: np.ndarray, keys: np.ndarray, codes: np.ndarray) -> Trie:
        """From one row per n-gram, ascending by context, then key."""
        names, first = np.unique(contexts, return_index=True)
        rank = np.searchsorted(names, contexts).astype(np.uint64)
        pointers = np.append(first, len(contexts)).astype(np.uint64)
        return cls(
            Sequence.of(names),
            Sequence.of(pointers),
            Sequence.of(rank << np.uint64(KEY_BITS) | keys, KEY_BITS),
            codes,
        )

    def mapped(self) -> Trie:
        """The same trie in a file without a name, mapped into memory; it goes with the trie."""
        parts = [
            *self.contexts.arrays(), *self.pointers.arrays(), *self.successors.arrays(), self.codes
        ]
        handle, path = tempfile.mkstemp(prefix="trie-")
        os.unlink(path)
        with os.fdopen(handle, "w+b") as file:
            places = []
            for part in parts:
                file.write(b"\0" * (-file.tell() % 8))
                places.append((file.tell(), part.dtype, len(part)))
                file.write(np.ascontiguousarray(part).tobytes())
            file.write(b"\0" * 8)
            file.flush()
            whole = np.memmap(file, np.uint8, "r")
        views = [whole[a : a + n * t.itemsize].view(t) for a, t, n in places]
        sequences = [Sequence(*views[i : i + 4]) for i in (0, 4, 8)]
        return Trie(*sequences, views[12])

    def look_up(self, contexts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The code of each n-gram, 0 if it is absent. A context is searched once for all rows of a run of it."""
        out = np.zeros(len(contexts), CODE)
        if not len(contexts) or not self.contexts.n:
            return out
        first = np.append(True, contexts[1:] != contexts[:-1])
        rank = self.contexts.find(contexts[first])
        known = np.maximum(rank, 0)
        start = self.pointers.get(known).astype(np.int64)
        end = np.where(rank >= 0, self.pointers.get(known + 1).astype(np.int64), start)
        run = np.cumsum(first) - 1
        at = self.successors.find_low(keys, start[run], end[run])
        hit = at >= 0
        out[hit] = self.codes[at[hit]]
        return out
