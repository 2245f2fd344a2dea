"""Parity sketches of sets and the band keys by which similar sets meet.

A token flips one word of a banded sketch: word b of a set is the XOR of the
64-bit hashes of those tokens that fall into band b. So the number of words in
which two sketches differ is at most the symmetric difference of the sets, and
with one band more than that, at least one word is equal (pigeonhole).

Sets with similarity >= t and sizes a <= b have a symmetric difference of at
most floor((1 - t) / (1 + t) * (a + b)) <= floor((1 - t) / t * a) = d(a). A set
therefore issues its first T(n) words, T(n) >= d(n) + 1 and growing in n: what
the smaller set of a pair issues, the larger one issues too.

Words of empty bands say nothing (they are equal in most sets), so they aren't
issued. A set whose first T bands have more than d words that aren't empty, for
each d from d(t * n) to d(n), finds every partner by such words alone. The few
other sets, nearly all of them small, also issue their first floor((1 - t) * n) + 1
tokens in order of hash: two such sets that are similar share one of these.
"""

from __future__ import annotations

import numpy as np

from ._text import mix64

#: Size classes: class c holds sizes up to BOUNDS[c]. Sets that may have a partner in the next class issue its words as well.
_RATIO = 0.6
_SLACK = 0.2
BITS_PER_TOKEN, MIN_BITS, MAX_BITS = 4, 512, 1 << 16


class Bands:
    def __init__(self, num: int, den: int):
        """Similarity num / den."""
        self.num, self.den = num, den
        self._bounds = [1]
        while self._bounds[-1] < 1 << 40:
            self._bounds.append(max(self._bounds[-1] + 1, int(self._bounds[-1] / _RATIO)))
        self.bounds = np.array(self._bounds, dtype=np.int64)

    def diff(self, n: np.ndarray) -> np.ndarray:
        return n * (self.den - self.num) // self.num

    def issued(self, d: np.ndarray) -> np.ndarray:
        return d + 2 + (d * _SLACK).astype(np.int64)

    def least_partner(self, n: np.ndarray) -> np.ndarray:
        return -(-n * self.num // self.den)

    def classes(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of a size, and the class of its largest partner."""
        return np.searchsorted(self.bounds, n), np.searchsorted(self.bounds, n * self.den // self.num)

    def keys(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of sets given as sorted 48-bit hashes, set after set: (key, index of the set)."""
        return self.keys_and_needs(hashes, counts)[:2]

    def keys_and_needs(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys, and for each set how many of them it shares at least with any partner that isn't smaller.

        Of the words that a set issues in a class, a partner lacks no more than
        they differ in tokens, which is d(n) at most.
        """
        out_k, out_s = [], []
        words = np.full(len(counts), 1 << 40, dtype=np.int64)
        own, top = self.classes(counts)
        first = np.concatenate([[0], np.cumsum(counts)])
        for shift in range(int((top - own).max(initial=0)) + 1):
            some = np.flatnonzero((counts > 0) & (own + shift <= top))
            if len(some):
                k, s, n = self._class_keys(hashes, counts, first, some, own[some] + shift)
                out_k.append(k)
                out_s.append(s)
                words[some] = np.minimum(words[some], n)
        needs = np.where(counts > 0, words - self.diff(counts), 0)
        if not out_k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), needs
        return np.concatenate(out_k), np.concatenate(out_s), needs

    def _class_keys(self, hashes, counts, first, some, cls):
        n = counts[some]
        bands = self.issued(self.diff(self.bounds[cls]))
        take = np.repeat(first[some], n) + _within(n)
        h = hashes[take]
        owner = np.repeat(np.arange(len(some)), n)
        seed = mix64(cls.astype(np.uint64) + np.uint64(0x51ED27))[owner]
        band = ((h >> np.uint64(16)) * bands[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        word = mix64(h ^ seed)
        base = np.concatenate([[0], np.cumsum(bands)])
        at = base[owner] + band
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        xor = np.bitwise_xor.reduceat(word, new)
        at = at[new]
        who = owner[new]
        number = at - base[who]
        limit = self.issued(self.diff(n))
        key = mix64(xor ^ mix64(number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed[new]))
        keep = number < limit[who]
        lacking = self._lacking(n, at, base)[owner]
        prefix = lacking & (_within(n) < ((self.den - self.num) * n // self.den + 1)[owner])
        tokens = mix64(h[prefix] ^ seed[prefix] ^ np.uint64(0x7F4A7C15))
        return np.concatenate([key[keep], tokens]), np.concatenate([some[who[keep]], some[owner[prefix]]]), np.bincount(who[keep], minlength=len(some))

    def _lacking(self, n: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Sets that have too few words that aren't empty among the first T, for some d that a partner may need."""
        low, high = self.diff(self.least_partner(n)), self.diff(n)
        steps = high - low + 1
        which = np.repeat(np.arange(len(n)), steps)
        d = low[which] + _within(steps)
        begin = np.searchsorted(at, base[:-1])
        have = np.searchsorted(at, base[which] + self.issued(d)) - begin[which]
        out = np.zeros(len(n), dtype=bool)
        out[which[have <= d]] = True
        return out


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ... counts[1] - 1, ..."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def sketch_bits(counts: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set: a power of two, four to eight for a token."""
    need = np.maximum(counts * BITS_PER_TOKEN, 1)
    return np.clip(1 << np.ceil(np.log2(need)).astype(np.int64), MIN_BITS, MAX_BITS)


def bit_sketches(hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of the rows, a token flips one bit: their bytes one after another, and where each begins (n + 1 values).

    A sketch of half as many bits is the XOR of the two halves.
    """
    bits = sketch_bits(counts)
    base = np.concatenate([[0], np.cumsum(bits)])
    bit = (mix64(hashes ^ np.uint64(0xABCDEF)) & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(base[rows] + bit, minlength=int(base[-1])) & 1
    return np.packbits(odd.astype(np.uint8)), base // 8


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches, a row of 64-bit words each, with so many words."""
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x
