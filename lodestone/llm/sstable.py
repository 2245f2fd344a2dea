"""Sorted string tables of token ids.

A shard holds documents in ascending order of their identifier:

    data blocks   entries of about 64 KB: key prefix shared with the entry
                  before, key suffix, value; zstd, with a CRC of the raw block
    index block   last key, place and size of each data block
    Bloom filter  ten bits and seven probes a key
    footer        places of index and filter, counts, CRC, magic

Keys are 9 bytes: 1 and the identifier, big-endian with the sign bit flipped, so
their byte order is that of the integers; nine zeros stand for no identifier and
come first. Values are token ids as little-endian unsigned integers
of 2 or 4 bytes. A lookup asks the filter, searches the index by bisection and
reads one block. Entries with equal keys are kept, in order of writing. A writer
holds one block, 24 bytes and a key for each block and 16 bytes for each entry.
"""

from __future__ import annotations

import array
import bisect
import struct
import zlib

import numpy as np
import xxhash
import zstandard

MAGIC = b"LDSTSST2"
KEY = 9
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_PROBES = 10, 7
_FOOTER = struct.Struct("<QQQQQQIB8s")


def key_of(doc_id: int | None) -> bytes:
    return bytes(KEY) if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _hashes(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h & ((1 << 64) - 1), h >> 64


def _places(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The bits of keys with these hashes, probe after probe; sums wrap around at 64 bits."""
    return np.concatenate([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(BLOOM_PROBES)])


def _filter(a: np.ndarray, b: np.ndarray, bits: int) -> bytes:
    out = np.zeros(-(-bits // 8), dtype=np.uint8)
    for at in range(0, len(a), 1 << 16):
        place = _places(a[at : at + (1 << 16)], b[at : at + (1 << 16)], bits)
        np.bitwise_or.at(out, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return out.tobytes()


class Writer:
    """Writes entries in ascending key order to a binary file object."""

    def __init__(self, out, width: int = 2):
        self.out, self.width, self.at = out, width, 0
        self.dtype = {2: "<u2", 4: "<u4"}[width]
        self.block, self.block_bytes, self.last, self.prior = [], 0, b"", None
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes = array.array("Q")
        self.n_tokens = 0
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = key_of(doc_id), ids.astype(self.dtype).tobytes()
        if self.prior is not None and key < self.prior:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < KEY and key[shared] == self.prior[shared]:
                shared += 1
        entry = _varint(shared) + _varint(KEY - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_bytes += len(entry)
        self.prior = key
        self.hashes.extend(_hashes(key))
        self.n_tokens += len(ids)
        if self.block_bytes >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            self.index.append((self.prior, *self._put(struct.pack("<I", zlib.crc32(raw)) + self.zstd.compress(raw))))
            self.block, self.block_bytes = [], 0

    def close(self) -> None:
        self._flush()
        index_at, index_size = self._put(b"".join(k + struct.pack("<QQ", a, n) for k, a, n in self.index))
        pairs = np.frombuffer(self.hashes, dtype=np.uint64) if self.hashes else np.zeros(0, np.uint64)
        n = len(pairs) // 2
        bits = max(64, BLOOM_BITS * n)
        bloom_at, _ = self._put(_filter(pairs[::2], pairs[1::2], bits))
        body = (index_at, index_size, bloom_at, bits, n, self.n_tokens)
        crc = zlib.crc32(struct.pack("<6QB", *body, self.width))
        self._put(_FOOTER.pack(*body, crc, self.width, MAGIC))


class Reader:
    """Reads a shard from a seekable binary file object."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        if size < _FOOTER.size:
            raise ValueError("not a shard: too short")
        *body, crc, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or crc != zlib.crc32(struct.pack("<6QB", *body, self.width)):
            raise ValueError("not a shard, or its footer is damaged")
        index_at, index_size, self.bloom_at, self.bits, self.n_docs, self.n_tokens = body
        raw = self._read(index_at, index_size)
        entry = KEY + 16
        self.last = [raw[i : i + KEY] for i in range(0, len(raw), entry)]
        self.place = [struct.unpack("<QQ", raw[i + KEY : i + entry]) for i in range(0, len(raw), entry)]
        self.dtype = {2: "<u2", 4: "<u4"}[self.width]
        self.bloom = None
        self.zstd = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, i: int) -> list[tuple[bytes, np.ndarray]]:
        data = self._read(*self.place[i])
        raw = self.zstd.decompress(data[4:])
        if zlib.crc32(raw) != struct.unpack("<I", data[:4])[0]:
            raise ValueError(f"block {i} is damaged")
        out, at, key = [], 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            out.append((key, np.frombuffer(raw, self.dtype, size // self.width, at)))
            at += size
        return out

    def __iter__(self):
        for i in range(len(self.place)):
            for key, ids in self.block(i):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        if self.bloom is None:
            self.bloom = self._read(self.bloom_at, -(-self.bits // 8))
        a, b = (np.array([h], dtype=np.uint64) for h in _hashes(key_of(doc_id)))
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(a, b, self.bits).tolist())

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first entry with that key."""
        if not self.may_hold(doc_id):
            return None
        key = key_of(doc_id)
        i = bisect.bisect_left(self.last, key)
        if i < len(self.last):
            for k, ids in self.block(i):
                if k == key:
                    return ids
        return None
