"""Context-triggered piecewise hashing: fingerprints of whole texts that stay alike under local edits."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_points, narrow, partitions, range_group

_WINDOW = 7
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: A text has this many blocks or up to twice as many; a chunk has a quarter of a block at least and four at most.
_CHUNKS, _LEAST, _MOST = 32, 4, 4
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)


def _rolling(data: bytes) -> np.ndarray:
    """A hash of the last seven bytes at each byte."""
    values = _BYTES[np.frombuffer(data, np.uint8)]
    out = values.copy()
    for back in range(1, min(_WINDOW, len(values))):
        turned = values[:-back] << np.uint32(4 * back) | values[:-back] >> np.uint32(32 - 4 * back)
        out[back:] ^= turned
    return out


def _signature(rolling: np.ndarray, mixed: np.ndarray, block: int) -> str:
    """One letter for each chunk; a chunk ends where the rolling hash triggers.

    Chunks have least and greatest lengths, so that text of one repeated passage, which triggers always or never,
    also has about the usual number.
    """
    ends = np.flatnonzero((rolling & np.uint32(block - 1)) == np.uint32(block - 1)) + 1
    least, most, n = max(1, block // _LEAST), block * _MOST, len(rolling)
    ends, starts, at, k = [*ends.tolist(), n], [], 0, 0
    while at < n:
        starts.append(at)
        k = bisect_left(ends, min(at + least, n), k)
        at = min(ends[k], at + most)
    sums = np.add.reduceat(mixed, starts) * np.uint64(0x9E3779B97F4A7C15)
    return _LETTERS[sums >> np.uint64(58)].tobytes().decode()


def fingerprint(text: str) -> str:
    """block size ":" signature ":" signature at twice the block size, over all bytes of the text.

    The block size, a power of two, follows from the length. The empty text has empty signatures.
    """
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return "1::"
    rolling = _rolling(data)
    mixed = (rolling.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)
    block = 1 << max(0, (len(data) // _CHUNKS).bit_length() - 1)
    return f"{block}:{_signature(rolling, mixed, block)}:{_signature(rolling, mixed, block * 2)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of `a` at a time."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (insertion and deletion) over the summed lengths."""
    if a == b:
        return 1.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: the better of the signatures with the same block size; 0 if no block sizes are compatible."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    if not x1 or not y1:
        return 0.0
    if bx == by:
        return max(_alike(x1, y1), _alike(x2, y2)) if min(len(x2), len(y2)) >= 16 else _alike(x1, y1)
    if bx == 2 * by:
        return _alike(x1, y2)
    return _alike(x2, y1) if by == 2 * bx else 0.0


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, guest, doc_id, text) such that, within a part sorted by guest and descending doc_id, each row's
    successor follows it; a part ends with a guest, the first row of the part after it (for the last: the first).

    Part borders come from a quantile sketch over all ids; the driver gets one id for each part.
    """
    base = narrow(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    base = base.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    points = cut_points(base, "key", 4 * partitions(docs.sparkSession))
    base = base.withColumn("part", range_group(F.col("key"), points))
    heads = sorted((r.part, r.head) for r in base.groupBy("part").agg(F.max("key").alias("head")).collect())
    home = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")))
    if heads:
        after = {heads[i - 1][1]: heads[i][0] for i in range(len(heads))}
        guest = F.create_map(*(F.lit(x) for pair in after.items() for x in pair))[F.col("key")]
        both = F.concat(home, F.array(F.struct(guest.alias("part"), F.lit(1).alias("guest"))))
        home = F.when(F.col("key").isin(list(after)), both).otherwise(home)
    spread = base.select("doc_id", "key", "text", F.explode(home).alias("p")).select("doc_id", "key", "text", "p.part", "p.guest")
    spread = spread.repartition(partitions(docs.sparkSession), "part")
    return spread.sortWithinPartitions("part", "guest", F.desc("key"), "text").select("part", "guest", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_edited: bool = True) -> DataFrame:
    """Per document: doc_id, n_chars, fingerprint, and how alike it is to an edited copy and to the next document.

    The edited text is the text with its last third (rounded down) replaced by as many first code points, or all, of
    the next document in descending doc_id order; after the last comes the first. One shuffle of the texts by id range;
    each task then holds two documents at a time.

    Null text: empty. Null doc_id: after all others. Repeated doc_ids: by text. Equal texts: equal fingerprints. A
    single document is its own successor. No rows: no rows.
    """

    def run(batches):
        part, held, done = None, None, True
        for batch in batches:
            out = []
            for p, guest, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, held, done = p, None, False
                if done:
                    continue
                own = fingerprint(text)
                if held is not None:
                    before, old, mark = held
                    third = len(old) // 3
                    edited = old[: len(old) - third] + text[:third]
                    changed = fingerprint(edited) if third else mark
                    row = (before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, own))
                    out.append(row + (edited,) if with_edited else row)
                held, done = (key, text, own), bool(guest)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds += ", edited string" if with_edited else ""
    names = [x.split()[0] for x in kinds.split(", ")]
    return with_next(docs, id_col, text_col).mapInArrow(run, kinds)
