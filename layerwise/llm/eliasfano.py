"""Elias-Fano coded monotone sequences and the n-gram trie made of them, in one memory map."""

from __future__ import annotations

import mmap

import numpy as np

_ONE = np.uint64(1)
_PIECE = 1 << 18


class EliasFano:
    """A sorted sequence of n numbers below 2^63: the low bits of each, packed, and the high parts in unary.

    high holds, for each number i, a 1 at place (number >> low_bits) + i.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._first: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            v = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, v << shift)
            over = np.flatnonzero(shift + np.uint64(bits) > 64)
            np.bitwise_or.at(low, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
        top = (values >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros((int(top[-1]) if n else 0) + n + 1, np.uint8)
        unary[top + np.arange(n)] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"))

    def lows(self, at: np.ndarray) -> np.ndarray:
        """The low bits of the numbers at these places."""
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        # The next word's part; a shift of 64 in two steps, as one of 64 would be none.
        rest = (self.low[word + 1] << (np.uint64(63) - shift)) << _ONE
        return ((self.low[word] >> shift) | rest) & np.uint64((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All numbers."""
        ones = np.flatnonzero(np.unpackbits(np.asarray(self.high), bitorder="little"))[: self.n]
        return (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits) | self.lows(np.arange(self.n))

    def find(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of each x in the sequence (of distinct numbers), from `first` on and before `end`; -1 where it isn't there.

        The high part of x names a run of places, about one on average but many where numbers are dense; it is
        searched by halves.
        """
        if len(x) > _PIECE:  # what is held at a time stays small
            cuts = [slice(i, i + _PIECE) for i in range(0, len(x), _PIECE)]
            return np.concatenate([self.find(x[c], *(None if e is None else e[c] for e in (first, end))) for c in cuts])
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        if self._first is None:  # the places where each high part's run starts
            ones = np.flatnonzero(np.unpackbits(np.asarray(self.high), bitorder="little"))[: self.n]
            top = ones - np.arange(self.n)
            self._first = np.append(0, np.cumsum(np.bincount(top))).astype(np.int32)
        x = np.asarray(x, np.uint64)
        high, low = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        inside = np.flatnonzero(high < len(self._first) - 1)
        want = low[inside]
        at, stop = self._first[high[inside]].astype(np.int64), self._first[high[inside] + 1].astype(np.int64)
        if first is not None:
            at, stop = np.maximum(at, first[inside]), np.minimum(stop, end[inside])
        limit = stop.copy()
        while (todo := np.flatnonzero(at < stop)).size:  # the first place in the run that isn't below x
            middle = (at[todo] + stop[todo]) // 2
            below = self.lows(middle) < want[todo]
            at[todo[below]] = middle[below] + 1
            stop[todo[~below]] = middle[~below]
        some = np.flatnonzero(at < limit)
        hit = some[self.lows(at[some]) == want[some]]
        out[inside[hit]] = at[hit]
        return out


class Quantiser:
    """Logarithms from `least` to 0 in 254 even steps; code 0 is nothing. The same steps everywhere, so none are sent along."""

    def __init__(self, least: float) -> None:
        self.least = min(float(least), -1.0)

    def codes(self, values: np.ndarray) -> np.ndarray:
        return (1 + np.clip(np.rint(values / self.least * 254), 0, 254)).astype(np.uint8)

    def table(self) -> np.ndarray:
        """What each code stands for, as a plain number; 256 entries."""
        return np.append(0.0, 10.0 ** (np.arange(255) * self.least / 254))


class Trie:
    """N-grams by length: the words that start one, then, length by length, pointers to the successors of each
    n-gram one word shorter, and those successors as ranks among the words that follow anything.

    Successors are searched for relative to their context, between its pointers: a successor's number is the
    context's place times the count of words plus the word's rank, which makes a level one monotone sequence.
    All levels lie in one memory map, which needs no file: a trie lives no longer than the task that asks it.
    """

    def __init__(self, first: np.ndarray, words: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], weights: list[np.ndarray], backs: list[np.ndarray]) -> None:
        """first, words: sorted; levels: from length 2 on, the places of each n-gram's context one level up and
        of its last word in `words`, sorted; weights, backs: codes for each level, backs for all but the last."""
        self.n_words = max(1, len(words))
        coded, above = [EliasFano.encode(first), EliasFano.encode(words)], len(first)
        for owner, word in levels:
            coded.append(EliasFano.encode(np.searchsorted(owner, np.arange(above + 1))))
            coded.append(EliasFano.encode(owner.astype(np.uint64) * np.uint64(self.n_words) + word.astype(np.uint64)))
            above = len(owner)
        parts = [a for c in coded for a in (c.low, c.high)] + [*weights, *backs]
        ends = np.cumsum([0] + [-(-a.nbytes // 8) * 8 for a in parts])
        self.map = mmap.mmap(-1, int(ends[-1]) + 8)
        read = []
        for a, at in zip(parts, ends.tolist()):
            self.map[at : at + a.nbytes] = a.tobytes()
            read.append(np.frombuffer(self.map, a.dtype, len(a), at))
        mapped = [EliasFano(c.n, c.low_bits, read[2 * i], read[2 * i + 1]) for i, c in enumerate(coded)]
        self.first, self.words, self.pointers, self.successors = mapped[0], mapped[1], mapped[2::2], mapped[3::2]
        self.weights = read[2 * len(coded) : 2 * len(coded) + len(weights)]
        self.backs = read[2 * len(coded) + len(weights) :]

    def bytes(self) -> int:
        return len(self.map)

    def query(self, words: list[np.ndarray], parents: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Codes of n-grams by length, given their last words and the places of their contexts among those asked
        for one length up: weights, and backs for all lengths but the last; 0 where the trie hasn't got it."""
        place = self.first.find(words[0])
        weights, backs = [], []
        for k in range(len(words)):
            if k:
                above, rank = place[parents[k]], self.words.find(words[k])
                known = np.flatnonzero((above >= 0) & (rank >= 0))
                above, rank = above[known], rank[known]
                edges = self.pointers[k - 1].values().astype(np.int64)
                place = np.full(len(words[k]), -1, np.int64)
                place[known] = self.successors[k - 1].find(above.astype(np.uint64) * np.uint64(self.n_words) + rank.astype(np.uint64), edges[above], edges[above + 1])
            for out, codes in ((weights, self.weights), (backs, self.backs)):
                if k < len(codes):
                    out.append(np.where(place >= 0, codes[k][np.maximum(place, 0)], 0).astype(np.uint8) if len(codes[k]) else np.zeros(len(place), np.uint8))
        return weights, backs
