"""Elias-Fano sequences and the two-level n-gram trie built from them, in one
file that is memory-mapped for queries. All lookups are vectorised."""

from __future__ import annotations

import numpy as np

_U = np.uint64
MISS = np.int64(-1)
SUCC_BITS = 40


class EliasFano:
    """A monotone sequence of n values below ``universe``: the low bits packed, the
    high bits in unary with a running count of zeros per 64-bit word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> EliasFano:
        v = np.asarray(values, _U)
        n = len(v)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits) // 64 + 2, _U)
        if bits and n:
            at = np.arange(n, dtype=_U) * _U(bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            part = v & _U((1 << bits) - 1)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + _U(bits) > _U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        top = (v >> _U(bits)) if bits < 64 else np.zeros(n, _U)
        size = n + ((universe - 1) >> bits if universe else 0) + 2
        one = top.astype(np.int64) + np.arange(n)
        flat = np.zeros((size + 63) // 64 * 64, np.uint8)
        flat[one] = 1
        high = np.packbits(flat, bitorder="little").view(_U)
        zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64)))).astype(np.uint32)
        return EliasFano(n, bits, low, high, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], _U), self.low, self.high, self.zeros]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        at = i.astype(_U) * _U(self.low_bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        x = self.low[word] >> shift
        y = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (x | y) & _U((1 << self.low_bits) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the high bits."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        rest = k - self.zeros[word].astype(np.int64)
        x, at = ~self.high[word], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # descend into the half that holds it
            part = x & _U((1 << width) - 1)
            n = np.bitwise_count(part).astype(np.int64)
            right = rest >= n
            rest = np.where(right, rest - n, rest)
            x = np.where(right, x >> _U(width), part)
            at += np.where(right, width, 0)
        return word * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        i = np.asarray(i, np.int64)
        ones = np.arange(1, len(self.zeros)) * 64 - self.zeros[1:].astype(np.int64)
        word = np.searchsorted(ones, i, side="right")
        rest = i - np.concatenate(([0], ones))[word]
        x, at = self.high[word], np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = x & _U((1 << width) - 1)
            n = np.bitwise_count(part).astype(np.int64)
            right = rest >= n
            rest = np.where(right, rest - n, rest)
            x = np.where(right, x >> _U(width), part)
            at += np.where(right, width, 0)
        return ((word * 64 + at - i).astype(_U) << _U(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of x by successor search, or MISS: the first value not below x is looked up and compared."""
        x = np.asarray(x, _U)
        out = np.full(len(x), MISS)
        if not self.n or not len(x):
            return out
        top = (x >> _U(self.low_bits)).astype(np.int64)
        low = x & _U((1 << self.low_bits) - 1)
        total = int(self.zeros[-1])
        inside = np.flatnonzero(top < total)
        top, low = top[inside], low[inside]
        at = np.where(top > 0, self._select0(np.maximum(top - 1, 0)) - top + 1, 0)
        end = np.minimum(self._select0(top) - top, self.n)
        stop = end.copy()
        live = np.flatnonzero(at < end)
        while len(live):  # the values of one bucket are sorted by their low bits
            mid = (at[live] + end[live]) // 2
            less = self._low(mid) < low[live]
            at[live] = np.where(less, mid + 1, at[live])
            end[live] = np.where(less, end[live], mid)
            live = live[at[live] < end[live]]
        here = np.flatnonzero(at < stop)
        hit = here[self._low(at[here]) == low[here]]
        out[inside[hit]] = at[hit]
        return out


class Trie:
    """Level 1: context hashes. Pointers: where each context's successors start. Level 2: successors, made
    monotone by the rank of their context. Codes: one quantised probability per level-2 node."""

    def __init__(self, level1: EliasFano, pointers: EliasFano, level2: EliasFano, codes: np.ndarray):
        self.level1, self.pointers, self.level2, self.codes = level1, pointers, level2, codes

    @staticmethod
    def build(contexts: np.ndarray, rank: np.ndarray, successors: np.ndarray, codes: np.ndarray) -> Trie:
        """Sorted distinct contexts; nodes sorted by (rank, successor)."""
        if len(contexts) >= 1 << (64 - SUCC_BITS):
            raise ValueError("too many contexts for one shard")
        starts = np.concatenate(([0], np.cumsum(np.bincount(rank, minlength=len(contexts)))))
        key = (rank.astype(_U) << _U(SUCC_BITS)) | successors
        return Trie(EliasFano.encode(contexts, 1 << 64), EliasFano.encode(starts, len(rank) + 1),
                    EliasFano.encode(key, max(len(contexts), 1) << SUCC_BITS), codes)

    def write(self, path: str) -> None:
        with open(path, "wb") as f:
            for a in [*self.level1.arrays(), *self.pointers.arrays(), *self.level2.arrays(), self.codes]:
                data = np.ascontiguousarray(a).view(np.uint8)
                f.write(np.array([len(data)], _U).tobytes())
                f.write(data.tobytes())
                f.write(b"\0" * (-len(data) % 8))

    @staticmethod
    def open(path: str) -> Trie:
        m = np.memmap(path, np.uint8, "r")
        at, parts = 0, []
        while at < len(m):
            n = int(m[at:at + 8].view(_U)[0])
            parts.append(m[at + 8:at + 8 + n])
            at += 8 + n + (-n % 8)

        def seq(i):
            n, bits = (int(x) for x in parts[i].view(_U))
            return EliasFano(n, bits, parts[i + 1].view(_U), parts[i + 2].view(_U), parts[i + 3].view(np.uint32))

        return Trie(seq(0), seq(4), seq(8), parts[12])

    def lookup(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Code of each (context, successor), 0 where the trie has none."""
        out = np.zeros(len(contexts), np.uint8)
        node = self.level1.find(contexts)
        known = np.flatnonzero(node >= 0)
        if not len(known):
            return out
        node = node[known]
        # a context without successors has an empty pointer range: no search for it
        some = self.pointers.get(node + 1) > self.pointers.get(node)
        known, node = known[some], node[some]
        at = self.level2.find((node.astype(_U) << _U(SUCC_BITS)) | successors[known])
        hit = at >= 0
        out[known[hit]] = self.codes[at[hit]]
        return out
