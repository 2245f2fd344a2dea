"""Vectorised pre-tokenisation for byte-level BPE vocabularies, with whole-token and merge caches.

The pattern of byte-level BPE splits a text at class changes of its characters,
so its boundaries follow from character classes alone, without a regex engine:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Tokens depend on the pre-token only. Vocabulary strings that encode alone as one
token are proved once per worker; other distinct pre-tokens go through the
tokenizers library once and are remembered up to a fixed number.
"""

from __future__ import annotations

import functools
import itertools
import os
import sys
import unicodedata

import numpy as np

from ._text import TextSlice, string_hashes

#: The pre-tokens that one worker remembers; beyond it, it starts anew.
REMEMBERED = 300_000
_NEAR_BITS = 20
_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)


@functools.cache
def _classes() -> np.ndarray:
    kinds = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))
        kinds[c] = _LETTER if k[0] == "L" else _NUMBER if k[0] == "N" else _UNKNOWN if k == "Cn" else _OTHER
    # White_Space of Unicode
    kinds[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return kinds


@functools.cache
def _ascii() -> np.ndarray:
    return np.concatenate([_classes()[:128], np.zeros(128, np.uint8)])


def _characters(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and class of each character of valid UTF-8."""
    lead = np.flatnonzero((d & 0xC0) != 0x80)
    b = d[lead]
    kind = _ascii()[b]
    many = np.flatnonzero(b >= 0xC0)
    if len(many):
        at, first = lead[many], b[many].astype(np.int32)
        pad = np.concatenate([d, np.zeros(4, np.uint8)])
        c1, c2, c3 = (pad[at + i].astype(np.int32) & 0x3F for i in (1, 2, 3))
        cp = np.where(first < 0xE0, (first & 0x1F) << 6 | c1, np.where(first < 0xF0, (first & 0x0F) << 12 | c1 << 6 | c2, (first & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
        kind[many] = _classes()[cp]
    return lead, kind


def pretokens(s: TextSlice) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each pre-token of the slice, and the number of pre-tokens before each row (n + 1 values).

    Characters that this Python's Unicode tables don't know count as others here.
    """
    return _split(s, *_characters(s.data))


def _split(s: TextSlice, lead: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = s.data
    kind = np.where(kind == _UNKNOWN, np.uint8(_OTHER), kind)
    n = len(lead)
    if not n:
        return np.zeros(0, np.int64), np.zeros(s.n + 1, np.int64)
    row_start = np.zeros(n + 1, dtype=bool)
    row_start[np.searchsorted(lead, s.offsets)] = True
    first = row_start[:n]
    last = row_start[1:].copy()
    last[-1] = True
    byte = d[lead]
    space = kind == _SPACE
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = byte[:-1] == 0x20
    after_blank &= ~first
    starts = change & (space | ~after_blank)
    # The last white space before another character is a token of its own or that token's beginning.
    ends = space & ~last
    ends[:-1] &= ~space[1:]
    starts |= ends
    quote = np.flatnonzero((byte == 0x27) & change & ~after_blank & ~last)
    if len(quote):
        pad = np.concatenate([byte, np.zeros(2, np.uint8)])
        c1, c2 = pad[quote + 1], pad[quote + 2]
        inside2 = np.zeros(len(quote), dtype=bool)
        ok = quote + 2 < n
        inside2[ok] = ~first[quote[ok] + 2]
        one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        two = inside2 & (((c1 == 0x72) & (c2 == 0x65)) | ((c1 == 0x76) & (c2 == 0x65)) | ((c1 == 0x6C) & (c2 == 0x6C)))
        some = quote[one | two]
        length = np.where(one, 2, 3)[one | two]
        starts[some + 1] = False
        after = some + length
        after = after[after < n]
        # White space after a contraction is already judged by its own run.
        starts[after] |= ~space[after]
        attach = after[(~space[after]) & (byte[after - 1] == 0x20)]
        starts[attach] = False
    at = lead[starts]
    return at, np.searchsorted(at, s.offsets)


def hashes(d: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return string_hashes(d, starts, np.diff(np.append(starts, len(d))))


class Vocabulary:
    """Token ids of pre-tokens by their hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._prove()

    def _prove(self) -> None:
        """Vocabulary strings that are one pre-token and encode alone as one token."""
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        bytes_of = {c: b for b, c in _byte_alphabet().items()}
        strings = []
        for token in self.tokenizer.get_vocab():
            if token in special or any(c not in bytes_of for c in token):
                continue
            raw = bytes(bytes_of[c] for c in token)
            try:
                strings.append(raw.decode())
            except UnicodeDecodeError:
                continue
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        single = [(s.encode(), e.ids[0]) for s, e in zip(strings, found) if len(e.ids) == 1]
        data = np.frombuffer(b"".join(s for s, _ in single), np.uint8)
        sizes = np.array([len(s) for s, _ in single])
        starts = np.cumsum(sizes) - sizes
        keys = hashes(data, starts)
        # one pre-token only
        at, first = pretokens(TextSlice(0, len(single), data, np.append(starts, len(data)).astype(np.int64)))
        one = np.diff(first) == 1
        self.whole_keys = keys[one]
        self.whole_ids = np.array([i for _, i in single], dtype=np.int32)[one]
        self._forget()

    def _forget(self) -> None:
        """Only whole tokens are known."""
        n = len(self.whole_ids)
        self.slot = dict(zip(self.whole_keys.tolist(), range(n)))
        self.size = np.ones(1 << 17, np.int32)
        self.begin = np.arange(1 << 17, dtype=np.int32)
        self.pool = np.zeros(1 << 18, np.int32)
        self.pool[:n] = self.whole_ids
        self.used = n
        self.near_key = np.zeros(1 << _NEAR_BITS, np.uint64)
        self.near_slot = np.zeros(1 << _NEAR_BITS, np.int32)
        at = self.whole_keys & np.uint64((1 << _NEAR_BITS) - 1)
        self.near_key[at], self.near_slot[at] = self.whole_keys, np.arange(n)

    def _merge(self, keys: np.ndarray, strings: list[str]) -> None:
        for at in range(0, len(keys), 8192):
            some = [e.ids for e in self.tokenizer.encode_batch_fast(strings[at : at + 8192], add_special_tokens=False)]
            sizes = np.array([len(x) for x in some], dtype=np.int32)
            flat = np.fromiter(itertools.chain.from_iterable(some), dtype=np.int32, count=int(sizes.sum()))
            base = len(self.slot)
            while base + len(some) > len(self.size):
                self.size, self.begin = np.concatenate([self.size, np.zeros_like(self.size)]), np.concatenate([self.begin, np.zeros_like(self.begin)])
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.size[base : base + len(some)] = sizes
            self.begin[base : base + len(some)] = self.used + np.cumsum(sizes) - sizes
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.slot.update(zip(keys[at : at + 8192].tolist(), range(base, base + len(some))))

    def _slots(self, s: TextSlice) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Slot of each pre-token, the number of pre-tokens before each row, and the rows that only the library can judge."""
        lead, kind = _characters(s.data)
        starts, first = _split(s, lead, kind)
        odd = lead[kind == _UNKNOWN]
        rows = sorted({*self._marked(s), *(np.searchsorted(s.offsets, odd, side="right") - 1).tolist()})
        if not len(starts):
            return np.zeros(0, np.int32), first, rows
        key = hashes(s.data, starts)
        if len(self.slot) > REMEMBERED:
            self._forget()
        at = key & np.uint64((1 << _NEAR_BITS) - 1)
        slot = self.near_slot[at]
        miss = np.flatnonzero(self.near_key[at] != key)
        if len(miss):
            u, index, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
            listed = u.tolist()
            new = [i for i, k in enumerate(listed) if k not in self.slot]
            if new:
                stop = np.append(starts, len(s.data))
                raw = s.data.tobytes()
                self._merge(u[new], [raw[stop[i] : stop[i + 1]].decode() for i in miss[index[new]].tolist()])
            found = np.array([self.slot[k] for k in listed], dtype=np.int32)
            slot[miss] = found[inverse]
            at = u & np.uint64((1 << _NEAR_BITS) - 1)
            self.near_key[at], self.near_slot[at] = u, found
        return slot, first, rows

    def _marked(self, s: TextSlice) -> list[int]:
        """Rows that contain the string of a special token."""
        raw, found = s.data.tobytes(), set()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                row = int(np.searchsorted(s.offsets, at, side="right")) - 1
                if at + len(mark) <= s.offsets[row + 1]:
                    found.add(row)
                at = raw.find(mark, at + 1)
        return sorted(found)

    def _row(self, s: TextSlice, row: int) -> list[int]:
        return self.tokenizer.encode(s.data[s.offsets[row] : s.offsets[row + 1]].tobytes().decode(), add_special_tokens=False).ids

    def count(self, s: TextSlice) -> np.ndarray:
        """Tokens of each row."""
        slot, first, marked = self._slots(s)
        total = np.concatenate([[0], np.cumsum(self.size[slot], dtype=np.int64)])
        out = total[first[1:]] - total[first[:-1]]
        for row in marked:
            out[row] = len(self._row(s, row))
        return out

    def encode(self, s: TextSlice) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the slice, row after row, and the number before each row (n + 1 values)."""
        slot, first, marked = self._slots(s)
        sizes = self.size[slot]
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        flat = self.pool[np.repeat(self.begin[slot] - total[:-1], sizes) + np.arange(total[-1])]
        offsets = total[first]
        if marked:
            rows = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            for row in marked:
                rows[row] = np.array(self._row(s, row), dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            flat = np.concatenate(rows)
        return flat, offsets


def _byte_alphabet() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
