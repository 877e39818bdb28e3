"""Packing token sequences into windows of a fixed capacity by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import narrow

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill_window(left: Counter, lengths: list[int], capacity: int) -> Counter:
    """The multiset of remaining lengths, with the longest in it, whose sum comes closest to `capacity` from below.

    left: how many pieces of each length remain; lengths: those lengths, descending. A bit set holds the reachable
    sums; counts are split into powers of two, one shift each, and the chosen counts are read off backwards.
    """
    first = lengths[0]
    reach, full, steps = 1 << first, 1 << capacity, []
    within = (full << 1) - 1
    for n in lengths:
        count, block = left[n] - (n == first), 1
        count = min(count, (capacity - first) // n)
        while count > 0 and not reach & full:
            take = min(block, count)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & within
            count, block = count - take, block * 2
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, Counter({first: 1})
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[n] += take
            total -= n * take
    return chosen


class Packer:
    """Packs the remainders of documents; whole windows are cut off long documents first.

    Where the best multiset leaves slack, one more remainder is cut to fill it, so only the last window of a task is
    not full; that one is cut at powers of two, which need no padding.
    """

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.left, self.pieces = Counter(), defaultdict(deque)

    def add(self, piece: tuple) -> Iterator[tuple]:
        """piece: (document, start, length). Yields (piece, sequence, offset) for windows that it fills alone."""
        doc, start, length = piece
        while length >= self.capacity:
            yield (doc, start, self.capacity), self._sequence(), 0
            start, length = start + self.capacity, length - self.capacity
        if length:
            self._keep((doc, start, length))

    def _sequence(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _keep(self, piece: tuple) -> None:
        self.left[piece[2]] += 1
        self.pieces[piece[2]].append(piece)

    def _take(self, n: int) -> tuple:
        self.left[n] -= 1
        if not self.left[n]:
            del self.left[n]
        return self.pieces[n].popleft()

    def pack(self) -> Iterator[tuple]:
        """Fills windows while at least one can be filled; what is left is shorter than a window."""
        total = sum(n * c for n, c in self.left.items())
        lengths = sorted(self.left, reverse=True)
        while total >= self.capacity:
            lengths = [n for n in lengths if self.left.get(n)]
            chosen = fill_window(self.left, lengths, self.capacity)
            sequence, offset = self._sequence(), 0
            for n, c in chosen.items():
                for _ in range(c):
                    yield self._take(n), sequence, offset
                    offset += n
            slack = self.capacity - offset
            while slack:
                n = max(self.left)
                doc, start, _ = self._take(n)
                cut = min(n, slack)
                yield (doc, start, cut), sequence, offset
                offset, slack = offset + cut, slack - cut
                if n > cut:
                    self._keep((doc, start + cut, n - cut))
                    if n - cut not in lengths:
                        lengths = sorted([*lengths, n - cut], reverse=True)
            total -= self.capacity

    def finish(self) -> Iterator[tuple]:
        """The rest, in sequences whose lengths are the powers of two that add up to it."""
        rest = deque(self._take(n) for n in sorted(self.left.elements(), reverse=True))
        total = sum(p[2] for p in rest)
        while total:
            size = 1 << (total.bit_length() - 1)
            sequence, offset = self._sequence(), 0
            while offset < size:
                doc, start, n = rest.popleft()
                cut = min(n, size - offset)
                yield (doc, start, cut), sequence, offset
                offset += cut
                if n > cut:
                    rest.appendleft((doc, start + cut, n - cut))
            total -= size


def pack_documents(
    docs: DataFrame,
    encoder: Callable[[], Callable[[str | None], bytes]],
    end_id: int,
    capacity: int = 4096,
    group_tokens: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packs every document of `docs` into sequences of at most `capacity` tokens, one row per piece.

    encoder: called once in each task, gives a function from a text to its ids as little-endian unsigned 32-bit bytes;
    `end_id` follows each document. Each task packs what it reads in groups of `group_tokens`, so there is no shuffle
    and memory is bounded; a group's last open window moves on to the next group. A sequence_id holds the partition in
    its upper bits.

    Null or empty text: the end id alone. Null and repeated doc_ids: each row is a document of its own. Equal
    lengths: in the order read. No rows: no rows. Other columns are not used.
    """

    def run(batches):
        encode, end = encoder(), np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        ids, held = {}, 0

        def rows(found) -> pa.RecordBatch | None:
            out = []
            for (doc, start, n), sequence, offset in found:
                key, data = ids[doc]
                out.append((key, start, n, zlib.crc32(memoryview(data)[4 * start : 4 * (start + n)]), len(data) // 4, sequence, offset))
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names) if out else None

        def flush(more: bool):
            nonlocal ids, held
            found = rows([*packer.pack(), *(() if more else packer.finish())])
            keep = {p[0] for q in packer.pieces.values() for p in q}
            ids, held = {k: v for k, v in ids.items() if k in keep}, 0
            return found

        number = 0
        for batch in batches:
            for key, text in zip(batch[0].to_pylist(), batch[1]):
                data = encode(text.as_py()) + end
                ids[number] = (key, data)
                if found := rows(packer.add((number, 0, len(data) // 4))):
                    yield found
                number, held = number + 1, held + len(data) // 4
                if held >= group_tokens and (found := flush(True)):
                    yield found
        if found := flush(False):
            yield found

    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(run, PIECES)
