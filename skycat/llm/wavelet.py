"""Token ids in one compressed file per shard: a wavelet matrix with rank and select.

A file holds the document ids and lengths, the number of ones before each part of each bit plane, and the parts, each
compressed apart: a question is answered from a few of them, without the rest of the file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

_MAGIC = b"WVMX0002"
_HEAD = struct.Struct("<8sQQIII")
#: Bytes of a part of a plane.
_PART = 8192


class WaveletMatrix:
    """Bit planes of a sequence of non-negative integers, highest bit first; every plane is followed by the sequence
    with the plane's zeros moved before its ones.

    before: (planes, parts + 1), the ones before each part; part: gives the bytes of a part of a plane.
    """

    def __init__(self, n: int, before: np.ndarray, part: Callable[[int, int], np.ndarray], size: int = _PART):
        self.n, self.bits, self.before, self.part, self.size = n, len(before), before, part, size
        self.zeros = [n - int(b[-1]) for b in before]

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes = split_planes(values, bits)
        return cls(len(values), ones_before(planes, _PART), lambda level, k: planes[level][k * _PART : (k + 1) * _PART])

    def _walk(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bit at each position, ones before it); the bit after the end is 0."""
        bit, ones = np.zeros(len(i), np.int64), np.empty(len(i), np.int64)
        where = i // (8 * self.size)
        for k in np.unique(where).tolist():
            mine = where == k
            at = i[mine] - k * 8 * self.size
            ones[mine] = self.before[level][k]
            if k < self.before.shape[1] - 1:
                data = np.concatenate([self.part(level, k), np.zeros(1, np.uint8)])
                sums = np.concatenate([[0], np.cumsum(np.bitwise_count(data), dtype=np.int64)])
                byte = data[at // 8]
                bit[mine] = byte >> (at % 8).astype(np.uint8) & 1
                ones[mine] += sums[at // 8] + np.bitwise_count(byte & ((1 << (at % 8)) - 1).astype(np.uint8))
        return bit, ones

    def access(self, positions) -> np.ndarray:
        """The values at the positions."""
        i = np.asarray(positions, dtype=np.int64)
        if len(i) and not 0 <= i.min() <= i.max() < self.n:
            raise IndexError("no such position")
        value = np.zeros(len(i), dtype=np.int64)
        for level in range(self.bits):
            bit, ones = self._walk(level, i)
            value = value << 1 | bit
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
        return value

    def _end(self, value: int, ends) -> np.ndarray:
        """Where the copies of `value` before each position end after the last plane."""
        i = np.asarray(ends, dtype=np.int64)
        for level in range(self.bits):
            ones = self._walk(level, i)[1]
            i = self.zeros[level] + ones if value >> (self.bits - 1 - level) & 1 else i - ones
        return i

    def ranks(self, value: int, ends) -> np.ndarray:
        """How often `value` occurs before each position."""
        ends = np.clip(np.asarray(ends, dtype=np.int64), 0, self.n)
        if not self.n or value < 0 or value >> self.bits:
            return np.zeros(len(ends), np.int64)
        return self._end(value, ends) - self._end(value, [0])[0]

    def rank(self, value: int, end: int) -> int:
        return int(self.ranks(value, [end])[0])

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Where the plane's bits number `k` (from 0) of this kind stand."""
        before = self.before[level]
        at = before if bit else np.arange(len(before)) * 8 * self.size - before
        where, out = np.searchsorted(at, k, side="right") - 1, np.empty(len(k), np.int64)
        for p in np.unique(where).tolist():
            mine = where == p
            out[mine] = p * 8 * self.size + np.flatnonzero(np.unpackbits(self.part(level, p), bitorder="little") == bit)[k[mine] - at[p]]
        return out

    def selects(self, value: int, numbers) -> np.ndarray:
        """The positions of the occurrences with these numbers (from 0) of `value`."""
        i, total = np.asarray(numbers, dtype=np.int64), self.count(value)
        if len(i) and not 0 <= i.min() <= i.max() < total:
            raise IndexError("no such occurrence")
        if not len(i):
            return i
        i = i + self._end(value, [0])[0]
        for level in reversed(range(self.bits)):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def select(self, value: int, k: int) -> int:
        return int(self.selects(value, [k])[0])

    def occurrences(self, value: int) -> list[int]:
        return self.selects(value, np.arange(self.count(value))).tolist()

    def decode(self) -> np.ndarray:
        """All values: the planes are undone from the last to the first."""
        parts = range(self.before.shape[1] - 1)
        planes = [np.concatenate([self.part(level, k) for k in parts] or [np.zeros(0, np.uint8)]) for level in range(self.bits)]
        return join_planes(self.n, planes)


def split_planes(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """The packed bit planes, in the order of the wavelet matrix."""
    seq, planes = np.ascontiguousarray(values), []
    for shift in reversed(range(bits)):
        ones = (seq & seq.dtype.type(1 << shift)).astype(bool)
        planes.append(np.packbits(ones, bitorder="little"))
        seq = np.concatenate([seq[~ones], seq[ones]])
    return planes


def ones_before(planes: list[np.ndarray], size: int) -> np.ndarray:
    """The number of ones before each part of `size` bytes, and in all, for each plane."""
    starts = np.arange(0, len(planes[0]), size)
    sums = [np.cumsum(np.add.reduceat(np.bitwise_count(p), starts, dtype=np.int64)) if len(starts) else [] for p in planes]
    return np.array([np.concatenate([[0], s]) for s in sums], dtype=np.int64)


def join_planes(n: int, planes: list[np.ndarray]) -> np.ndarray:
    kind = np.uint16 if len(planes) <= 16 else np.uint32
    seq = np.zeros(n, dtype=kind)
    for shift, plane in enumerate(reversed(planes)):
        ones = np.unpackbits(plane, count=n, bitorder="little").view(bool)
        out, zeros = np.empty_like(seq), n - int(np.count_nonzero(ones))
        out[~ones] = seq[:zeros]
        out[ones] = seq[zeros:] | kind(1 << shift)
        seq = out
    return seq


def dump(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """A shard's file: header, offsets, then document ids, null marks, lengths, counts and the parts of the planes."""
    import zstandard

    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"token id {int(ids.max())} needs more than {bits} bits")
    values = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    keys = np.array([k or 0 for k in doc_ids], dtype="<i8")
    nulls = np.packbits(np.array([k is None for k in doc_ids], dtype=bool))
    planes = split_planes(values, bits)
    parts = [keys.tobytes(), nulls.tobytes(), np.array(lengths, dtype="<u8").tobytes(), ones_before(planes, _PART).astype("<i8").tobytes()]
    parts += [p[k : k + _PART].tobytes() for p in planes for k in range(0, len(p), _PART)]
    packer = zstandard.ZstdCompressor(level=1)
    parts = [packer.compress(p) for p in parts]
    offsets = np.cumsum([_HEAD.size + 8 * (len(parts) + 1), *map(len, parts)]).astype("<u8")
    return _HEAD.pack(_MAGIC, len(ids), len(lengths), bits, _PART, len(parts)) + offsets.tobytes() + b"".join(parts)


class Shard:
    """A shard's file, read in ranges as they are needed. read: (start, length) to bytes."""

    def __init__(self, read: Callable[[int, int], bytes]):
        import zstandard

        magic, self.n, self.docs, self.bits, size, count = _HEAD.unpack(read(0, _HEAD.size))
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        offsets = np.frombuffer(read(_HEAD.size, 8 * (count + 1)), "<u8").tolist()

        def part(i: int) -> bytes:
            return zstandard.ZstdDecompressor().decompress(read(offsets[i], offsets[i + 1] - offsets[i]))

        nulls = np.unpackbits(np.frombuffer(part(1), np.uint8), count=self.docs)
        self.doc_ids = [None if x else k for k, x in zip(np.frombuffer(part(0), "<i8").tolist(), nulls.tolist())]
        self.lengths = np.frombuffer(part(2), "<u8").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        before = np.frombuffer(part(3), "<i8").reshape(self.bits, -1)
        each = before.shape[1] - 1
        kept = lru_cache(maxsize=256)(lambda level, k: np.frombuffer(part(4 + level * each + k), np.uint8))
        self.matrix = WaveletMatrix(self.n, before, kept, size)


def load(data: bytes) -> Shard:
    """A shard whose file is in memory."""
    view = memoryview(data)
    return Shard(lambda at, n: view[at : at + n])
