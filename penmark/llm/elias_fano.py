"""Elias-Fano sequences and an n-gram trie of them, in one memory map, searched for many keys at once.

A sequence holds n increasing integers below U in about 2 + log2(U / n) bits each: low bits packed, high
bits in unary.  A successor search goes to the high part's bucket by select and bisects its low bits.  A
count directory (one entry per 64 bits) serves a few selects; many at once read the unary part in one pass.

A trie keeps, per level, the words below each context of the level above.  Words are made increasing over
the whole level by adding the last value of the context before, so a level is one sequence; a word is
found by successor search relative to its context's base.  Child ranges are sequences of pointers.
Probabilities and back-off weights are one-byte codes.
"""

from __future__ import annotations

import mmap

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_COUNT = _BITS.sum(axis=1).astype(np.int64)
# Place of the r-th set bit of a byte.
_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)
# Codes per halving; the last code stands for zero.
STEPS = 6
ZERO = 255


def quantise(p: np.ndarray) -> np.ndarray:
    """One-byte logarithmic codes, rounded down so that sums of probabilities never pass one."""
    with np.errstate(divide="ignore"):
        code = np.ceil(-np.log2(p) * STEPS - 1e-9)
    return np.clip(code, 0, ZERO).astype(np.uint8)


VALUES = np.append(np.exp2(-np.arange(ZERO) / STEPS), 0.0)


class Sequence:
    """Increasing non-negative integers; ``parts`` are its arrays, to be placed in a memory map."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.places: dict[bool, np.ndarray] = {}
        self.n = n = len(values)
        top = int(values[-1]) + 1 if n else 1
        self.low = max(0, (top // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(self.low)).astype(np.int64)
        bits = np.zeros(-(-(n + (top >> self.low) + 2) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        upper = np.packbits(bits, bitorder="little")
        ones = np.concatenate(([0], np.cumsum(_COUNT[upper].reshape(-1, 8).sum(axis=1))))[:-1]
        self.parts = [self._pack(values), upper, ones.astype(np.uint32 if n < 1 << 32 else np.uint64)]

    def _pack(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n * self.low // 64 + 2, np.uint64)
        if self.n and self.low:
            low = values & np.uint64((1 << self.low) - 1)
            at = np.arange(self.n, dtype=np.int64) * self.low
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] |= np.bitwise_or.reduceat(low << shift, first)
            over = np.flatnonzero(shift + np.uint64(self.low) > np.uint64(64))
            out[word[over] + 1] |= low[over] >> (np.uint64(64) - shift[over])
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i * self.low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        packed = self.parts[0]
        spill = np.where(shift > 0, packed[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((packed[word] >> shift) | spill) & np.uint64((1 << self.low) - 1)

    def _select(self, r: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the r-th (from 0) set or unset bit of the unary part."""
        if 16 * len(r) > self.n:
            if ones not in self.places:
                bits = np.unpackbits(self.parts[1], bitorder="little")
                self.places[ones] = np.flatnonzero(bits if ones else bits == 0).astype(np.int32 if len(bits) < 1 << 31 else np.int64)
            return self.places[ones][r].astype(np.int64)
        before = self.parts[2].astype(np.int64)
        if not ones:
            before = 64 * np.arange(len(before)) - before
        word = np.searchsorted(before, r, side="right") - 1
        left = r - before[word]
        eight = self.parts[1].reshape(-1, 8)[word]
        if not ones:
            eight = ~eight
        count = np.cumsum(_COUNT[eight], axis=1)
        byte = (count <= left[:, None]).sum(axis=1)
        rows = np.arange(len(r))
        left -= np.where(byte > 0, count[rows, byte - 1], 0)
        return word * 64 + byte * 8 + _SELECT[eight[rows, byte], left]

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low)) | self._low(i)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the successor (first value >= x) of each x, and whether it equals x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        x = x.astype(np.uint64)
        last = int(self.get(np.array([self.n - 1]))[0])
        inside = x <= np.uint64(last)
        y = np.where(inside, x, np.uint64(last))
        high = (y >> np.uint64(self.low)).astype(np.int64)
        low = y & np.uint64((1 << self.low) - 1)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)
        end = self._select(high, False) - high
        lo, hi = begin, end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._low(middle) < low[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
        met = np.flatnonzero((lo < end) & inside)
        equal = np.zeros(len(x), bool)
        equal[met] = self._low(lo[met]) == low[met]
        return np.where(inside, lo, self.n), equal


class Level:
    """Words (from 0) below each context of the level above, in order of context and word."""

    def __init__(self, context: np.ndarray, contexts: int, word: np.ndarray):
        begin = np.searchsorted(context, np.arange(contexts + 1))
        self.pointers = Sequence(begin + np.arange(contexts + 1))  # strictly increasing
        last = np.zeros(contexts + 1, np.uint64)
        full = np.flatnonzero(np.diff(begin))
        last[full + 1] = word[begin[full + 1] - 1].astype(np.uint64) + np.uint64(1)
        base = np.cumsum(last)
        self.words = Sequence(base[context] + word.astype(np.uint64) + np.uint64(1))

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node of each word below its context, and whether there is one."""
        once = np.flatnonzero(np.diff(context, prepend=-1))  # runs of one context share its range and base
        run = np.cumsum(np.diff(context, prepend=-1) != 0) - 1
        begin = self.pointers.get(context[once]).astype(np.int64) - context[once]
        end = self.pointers.get(context[once] + 1).astype(np.int64) - context[once] - 1
        base = np.zeros(len(once), np.uint64)
        after = np.flatnonzero(begin > 0)
        base[after] = self.words.get(begin[after] - 1)
        begin, end, base = begin[run], end[run], base[run]
        node, equal = self.words.find(base + word.astype(np.uint64) + np.uint64(1))
        return node, equal & (node >= begin) & (node < end)


class Trie:
    """Three levels of n-grams (u; u v; u v w) with codes; all arrays lie in one anonymous memory map."""

    def __init__(self, u, uv_parent, uv_word, uv_codes, uv_backoff, uvw_parent, uvw_word, uvw_codes):
        self.first = Sequence(u)
        self.second = Level(uv_parent, len(u), uv_word)
        self.third = Level(uvw_parent, len(uv_word), uvw_word)
        sequences = [self.first, self.second.pointers, self.second.words, self.third.pointers, self.third.words]
        codes = [uv_codes, uv_backoff, uvw_codes]
        arrays = [a for s in sequences for a in s.parts] + codes
        self.map = mmap.mmap(-1, sum(-(-a.nbytes // 8) * 8 for a in arrays) + 8)
        at, placed = 0, []
        for a in arrays:
            view = np.frombuffer(self.map, a.dtype, len(a), at)
            view[:] = a
            placed.append(view)
            at += -(-a.nbytes // 8) * 8
        for i, s in enumerate(sequences):
            s.parts = placed[3 * i : 3 * i + 3]
        self.uv_codes, self.uv_backoff, self.uvw_codes = placed[-3:]

    def pairs(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = np.full(len(u), -1)
        change = np.diff(u, prepend=-1) != 0
        run = np.cumsum(change) - 1
        context, known = (x[run] for x in self.first.find(u[change]))
        at = np.flatnonzero(known)
        found, equal = self.second.find(context[at], v[at])
        node[at[equal]] = found[equal]
        return node, node >= 0

    def triples(self, node: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node of w below each pair's node (negative: none)."""
        out = np.full(len(node), -1)
        at = np.flatnonzero(node >= 0)
        found, equal = self.third.find(node[at], w[at])
        out[at[equal]] = found[equal]
        return out, out >= 0
