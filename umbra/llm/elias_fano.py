"""Elias-Fano sequences and n-gram tries over them, in one memory-mapped buffer.

A sorted sequence keeps ``l`` low bits of each value packed and the high bits in unary.
All queries are vectorised: ``access`` selects ones, ``successor`` finds the bucket of a
value's high bits between two zeros and bisects the low bits there.

A trie level of order k holds, for each context (a node of the level above), the range
of its children.  Child words are stored relative to their context: each range
continues from where the range before ended, so the whole level is one increasing
sequence, and a child is found by a successor search in its context's range.
"""

from __future__ import annotations

import mmap
from typing import NamedTuple

import numpy as np

_U = np.uint64
_BIT = np.left_shift(_U(1), np.arange(64, dtype=_U))


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) one in each word."""
    k, at, words = k.astype(np.int64), np.zeros(len(words), np.int64), words.copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & _U((1 << width) - 1)).astype(np.int64)
        up = k >= low
        k -= low * up
        at += width * up
        words >>= (width * up).astype(_U)
    return at


class EliasFano(NamedTuple):
    n: int
    l: int  # noqa: E741
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray  #: ones before each word of ``high``

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """From non-decreasing unsigned values."""
        values = np.asarray(values, _U)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 63) // 64 + 1, _U)
        if bits:
            v = values & _U((1 << bits) - 1)
            pos = np.arange(n, dtype=np.int64) * bits
            word, off = pos >> 6, (pos & 63).astype(_U)
            _or_at(low, word, v << off)
            over = (off + _U(bits)) > 64
            _or_at(low, word[over] + 1, v[over] >> (_U(64) - off[over]))
        at = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) + 2 if n else 1) // 64 + 1, _U)
        _or_at(high, at >> 6, _BIT[at & 63])
        return cls(n, bits, low, high, _ones(high))

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), _U)
        pos = i * self.l
        word, off = pos >> 6, (pos & 63).astype(_U)
        rest = np.where(off > 0, self.low[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return (self.low[word] >> off | rest) & _U((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        at = (word << 6) + _select_in_word(self.high[word], i - self.ones[word])
        return (at - i).astype(_U) << _U(self.l) | self.lows(i)

    def _zeros_end(self, k: np.ndarray) -> np.ndarray:
        """Ones before the k-th zero (from 0); n where there is no such zero."""
        zeros = (np.arange(len(self.high), dtype=np.int64) << 6) - self.ones
        word = np.searchsorted(zeros, k, side="right") - 1
        inside = k < (len(self.high) << 6) - self.n
        at = (word << 6) + _select_in_word(~self.high[word], np.where(inside, k - zeros[word], 0))
        return np.where(inside, at - k, self.n)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x; n if none."""
        x = np.asarray(x, _U)
        h = (x >> _U(self.l)).astype(np.int64)
        lo = np.where(h > 0, self._zeros_end(np.maximum(h, 1) - 1), 0)
        hi = self._zeros_end(h)
        want = x & _U((1 << self.l) - 1)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self.lows(mid) < want[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        return lo


def _or_at(out: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """out[at] |= bits for non-decreasing ``at``."""
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] |= np.bitwise_or.reduceat(bits, first)


def _ones(high: np.ndarray) -> np.ndarray:
    counts = np.bitwise_count(high).astype(np.int64)
    return np.concatenate([[0], np.cumsum(counts)[:-1]])


#: Probabilities are kept as 16-bit steps of their log10, from 0 down to -FLOOR.
FLOOR, STEPS = 24.0, 65535


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-log10, 0, FLOOR) * (STEPS / FLOOR)).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return codes * (-FLOOR / STEPS)


class TrieLevel(NamedTuple):
    """Contexts with their children, probabilities and back-off weights."""

    contexts: EliasFano
    pointers: EliasFano  #: first child of each context, and the end
    children: EliasFano  #: word + 1, continued from the context before
    log_p: np.ndarray  #: quantised, per child
    backoff: np.ndarray  #: quantised, per context

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, log_p: np.ndarray, log_backoff: np.ndarray, path: str | None = None) -> TrieLevel:
        """From distinct (context, word) in order; ``log_backoff`` per distinct context.

        The arrays lie in one memory map: anonymous, or the file ``path``.
        """
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(context)).astype(np.int64) if len(first) else first
        last = word[ends - 1].astype(_U) + _U(1) if len(first) else np.empty(0, _U)
        base = np.concatenate([[_U(0)], np.cumsum(last, dtype=_U)])
        relative = word.astype(_U) + _U(1) + np.repeat(base[:-1], ends - first)
        level = cls(
            EliasFano.build(context[first]), EliasFano.build(np.append(first, len(context))), EliasFano.build(relative),
            quantise(log_p), quantise(log_backoff),
        )
        return level.mapped(path)

    def arrays(self) -> list[np.ndarray]:
        return [a for ef in self[:3] for a in (ef.low, ef.high)] + [self.log_p, self.backoff]

    def mapped(self, path: str | None = None) -> TrieLevel:
        arrays = self.arrays()
        size = sum(a.nbytes + 8 for a in arrays) or 1
        if path is None:
            memory = mmap.mmap(-1, size)
        else:
            with open(path, "w+b") as f:
                f.truncate(size)
                memory = mmap.mmap(f.fileno(), size)
        placed, at = [], 0
        for a in arrays:
            view = np.frombuffer(memory, a.dtype, len(a), at)
            view[:] = a
            placed.append(view)
            at += a.nbytes + (-a.nbytes % 8)
        efs = [ef._replace(low=placed[2 * i], high=placed[2 * i + 1]) for i, ef in enumerate(self[:3])]
        return self._replace(contexts=efs[0], pointers=efs[1], children=efs[2], log_p=placed[6], backoff=placed[7])

    def lookup(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, log10 probability where found, log10 back-off weight: 0 for unknown contexts)."""
        n = len(context)
        found, log_p, weight = np.zeros(n, bool), np.zeros(n), np.zeros(n)
        if not self.contexts.n or not n:
            return found, log_p, weight
        distinct, back = np.unique(context, return_inverse=True)
        at = self.contexts.successor(distinct)
        held = at < self.contexts.n
        held[held] = self.contexts.access(at[held]) == distinct[held].astype(_U)
        start, end, base = (np.zeros(len(distinct), np.int64) for _ in range(3))
        start[held], end[held] = self.pointers.access(at[held]), self.pointers.access(at[held] + 1)
        later = held & (start > 0)
        base[later] = self.children.access(start[later] - 1).astype(np.int64)
        bow = np.zeros(len(distinct))
        bow[held] = dequantise(self.backoff[at[held]])
        known = np.flatnonzero(held[back])
        c = back[known]
        target = base[c].astype(_U) + word[known].astype(_U) + _U(1)
        child = self.children.successor(target)
        hit = child < end[c]
        hit[hit] = self.children.access(child[hit]) == target[hit]
        found[known[hit]] = True
        log_p[known[hit]] = dequantise(self.log_p[child[hit]])
        weight[known] = bow[c]
        return found, log_p, weight
