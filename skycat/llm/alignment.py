"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids are linked in the whole corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_hot, narrow, written

#: Where a text is cut into parts: before a blank that follows anything but white space.
_CUT = re.compile(r"(?<=\S)(?= )")
#: White space other than single blanks.
_SPACE = re.compile(r"[^\S ]|  ")
#: Strings whose characters every version of the Unicode tables files alike.
_LATIN = re.compile("[\x00-\u024f]*")
# Fixed value: the pattern of byte-level tokenizers, which also is that of their ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Characters of a slice of documents that are aligned at once; a longer document is a slice by itself.
SLICE = 1 << 20


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TwoEncoders:
    """Ids of space + text by a byte-level tokenizer file (A), of text by a sentencepiece model that adds the space (B).

    Neither joins what stands before a blank with it (A's pattern can't, B's pieces hold their blanks first), so a text
    is cut there, and parts are remembered in about `memory` bytes. Special tokens' names are plain text.
    """

    def __init__(self, path_a: str, path_b: str, memory: int = 192 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        known, names = byte_level(), {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(known[c] for c in names[i]) if i in names and all(c in known for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) and self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.lengths = tuple(np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.memory, self.used, self.known = memory, 0, ({}, {})
        self.quick = self._quick()

    def _quick(self):
        """An encoder of Latin strings with A's vocabulary: BPE by ranks, if the ids are in the order of the merges."""
        import tiktoken

        spec = json.loads(self.a.to_str())
        vocab, merges, split = spec["model"]["vocab"], spec["model"].get("merges"), spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and not spec.get("normalizer")
        if not plain or not merges or not all(spec["model"].get(k) in (None, False, "") for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        singles = [i for t, i in vocab.items() if len(t) == 1]
        if any(x >= y for x, y in zip(made, made[1:])) or max(singles) >= made[0]:
            return None
        ranks = {self.bytes_a[i]: i for i in (*singles, *made)}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ids_a(self, some: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [x.ids for x in self.a.encode_batch(some, add_special_tokens=False)]
        latin, plain = _LATIN.fullmatch, lambda w: self.a.encode(w, add_special_tokens=False).ids
        return [self.quick(w) if latin(w) else plain(w) for w in some]

    def _side(self, ids: list[list[int]], table: list[bytes], lengths: np.ndarray, data: list[bytes]) -> tuple[list[bytes], list[bool]]:
        """Ids as unsigned 32-bit integers, and whether they stand for just the bytes of their string."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))
        at = np.concatenate([[0], np.cumsum(n)]).tolist()
        ends = np.concatenate([[0], np.cumsum(lengths[flat])])[at]
        joined = b"".join(map(table.__getitem__, flat.tolist()))
        packed = flat.tobytes()
        same = np.array_equal(np.diff(ends), np.fromiter(map(len, data), np.int64, len(data))) and joined == b"".join(data)
        fits = [True] * len(ids) if same else [joined[x:y] == d for x, y, d in zip(ends[:-1], ends[1:], data)]
        return [packed[4 * x : 4 * y] for x, y in zip(at, at[1:])], fits

    def _both(self, wholes: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        """Both sides' ids of strings that start with a blank; None where a side's token bytes aren't the string's."""
        for at in range(0, len(wholes), 5000):
            some = wholes[at : at + 5000]
            data = [w.encode() for w in some]
            a, fit_a = self._side(self._ids_a(some), self.bytes_a, self.lengths[0], data)
            b, fit_b = self._side(self.b.encode([w[1:] for w in some], num_threads=1), self.bytes_b, self.lengths[1], data)
            for x, y, p, q in zip(a, b, fit_a, fit_b):
                yield (x, y) if p and q else None

    def _parts(self, text: str) -> list[str]:
        whole = " " + text
        parts = _CUT.split(whole) if _SPACE.search(whole) else [" " + p for p in text.split(" ")]
        return parts if self.apart and parts[-1] != " " else [whole]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Both sides' ids of each text as unsigned 32-bit integers; none if a side's token bytes aren't space + text.

        Parts that no text before had are encoded together. They are remembered until they take `memory` bytes, then
        the memo starts anew; a part of over 256 characters only for these texts.
        """
        split = [self._parts(t) if t else [] for t in texts]
        fresh = list(set(chain.from_iterable(split)).difference(self.known[0]))
        unlike = set()
        for part, ids in zip(fresh, self._both(fresh)):
            if ids is None:
                unlike.add(part)
            else:
                self.known[0][part], self.known[1][part] = ids
                self.used += 4 * len(part) + len(ids[0]) + len(ids[1]) + 400
        out = []
        for text, parts in zip(texts, split):
            if unlike and not unlike.isdisjoint(parts):
                out.append(next(self._both([" " + text])) or (b"", b""))
            else:
                out.append(tuple(b"".join(map(side.__getitem__, parts)) for side in self.known))
        if self.used > self.memory:
            self.known, self.used = ({}, {}), 0
        for part in fresh:
            if len(part) > 256:
                self.known[0].pop(part, None)
                self.known[1].pop(part, None)
        return out


@lru_cache(maxsize=1)
def shared_encoders(path_a: str, path_b: str) -> TwoEncoders:
    """The worker process's encoders: what they remember serves the tasks that follow."""
    return TwoEncoders(path_a, path_b)


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in A, places in B) of all tokens that overlap, in order; starts ascend over the whole slice.

    Each token's start finds the other side's token that covers it, the last one of its document to start there or
    before; both directions together are all overlaps.
    """
    a = pd.DataFrame({"doc": doc_a, "start": start_a, "a": np.arange(len(doc_a))})
    b = pd.DataFrame({"doc": doc_b, "start": start_b, "b": np.arange(len(doc_b))})
    one = pd.merge_asof(a, b, on="start", by="doc")
    two = pd.merge_asof(b, a, on="start", by="doc")
    two = two[start_a[two["a"].to_numpy()] != two["start"].to_numpy()]  # equal starts are in `one`
    i, j = np.concatenate([one["a"], two["a"]]), np.concatenate([one["b"], two["b"]])
    order = np.lexsort((j, i))
    return i[order], j[order]


class _Slice:
    """Tokens of some documents on one line of bytes: ids, document, start and end on both sides, links and groups."""

    def __init__(self, tokens: list[tuple[bytes, bytes]], lengths: tuple[np.ndarray, np.ndarray]):
        self.count, self.ids, self.n, self.doc, self.start, self.end = len(tokens), [], [], [], [], []
        for side in (0, 1):
            n = np.array([len(t[side]) // 4 for t in tokens], np.int64)
            ids = np.frombuffer(b"".join(t[side] for t in tokens), np.uint32).astype(np.int64)
            width = lengths[side][ids]
            end = np.cumsum(width)
            for put, x in zip((self.ids, self.n, self.doc, self.start, self.end), (ids, n, np.repeat(np.arange(len(tokens)), n), end - width, end)):
                put.append(x)
        self.over = overlaps(self.doc[0], self.start[0], self.doc[1], self.start[1])
        i, j = self.over
        same = self.end[0][i] == self.end[1][j]
        self.links = i[same], j[same]
        ends = self.end[0][self.links[0]]  # ascending, as the links are
        self.ends = ends[np.flatnonzero(np.diff(ends, prepend=-1))]

    def per_doc(self, places: np.ndarray, side: int = 0) -> np.ndarray:
        return np.bincount(self.doc[side][places], minlength=self.count)

    def groups(self) -> np.ndarray:
        return np.bincount(self.doc[0][np.searchsorted(self.end[0], self.ends)], minlength=self.count)

    def group_texts(self, tables) -> list[bytes]:
        """Each document's groups as `a1,a2|b1;a3|b2,b3`."""
        which = [np.searchsorted(self.ends, s, side="right") for s in self.start]
        sizes = [np.bincount(w, minlength=len(self.ends)) for w in which]
        out = np.empty(len(which[0]) + len(which[1]), object)
        before = np.cumsum(sizes[1]) - sizes[1], np.cumsum(sizes[0])
        for side in (0, 1):
            last = self.end[side] == self.ends[which[side]] if len(self.ends) else np.zeros(0, bool)
            out[np.arange(len(last)) + before[side][which[side]]] = tables[side][self.ids[side] * 2 + last]
        at = np.concatenate([[0], np.cumsum(self.n[0] + self.n[1])])
        return [b"".join(out[x:y].tolist())[:-1] for x, y in zip(at, at[1:])]

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, how many of its links hold the pair); pair = A id * 2**32 + B id."""
        i, j = self.links
        code = np.sort((self.doc[0][i] << 43) + self.ids[0][i] * width + self.ids[1][j])
        first = np.flatnonzero(np.diff(code, prepend=-1))
        code, n = code[first], np.diff(first, append=len(code))
        pair = code & ((1 << 43) - 1)
        return code >> 43, (pair // width << 32) + pair % width, n


def _texts(count: int, last: bytes) -> np.ndarray:
    """Each id's digits with a comma (at 2 * id) and with the mark of a group's last token (after that)."""
    out = np.empty(2 * count, object)
    out[0::2], out[1::2] = [b"%d," % i for i in range(count)], [b"%d%s" % (i, last) for i in range(count)]
    return out


def _lists(values: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values, kind))


def _slices(column: pa.Array) -> Iterator[tuple[int, list]]:
    first, texts, size = 0, [], 0
    for at, text in enumerate(column):
        text = text.as_py()
        if texts and size + len(text or "") > SLICE:
            yield first, texts
            first, texts, size = at, [], 0
        texts.append(text)
        size += len(text or "")
    if texts:
        yield first, texts


def align_documents(docs: DataFrame, paths: Callable[[], tuple[str, str]], id_col: str = "doc_id", text_col: str = "text", with_tokens: bool = True) -> DataFrame:
    """Per document: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (A id * 2**32 +
    B id of its links, distinct) and times (links of each pair).

    with_tokens: also a_ids, a_ends, b_ids, b_ends (ends in bytes of space + text), overlaps (places of A and B tokens
    that share bytes) and groups (`a1,a2|b1;a3|b2,b3`, ids of the tokens between bytes where both sides end).
    A link is a pair of overlapping tokens that end together. paths: called in a task, gives both files.

    Texts null, empty, or whose token bytes aren't space + text on both sides: no tokens, zeros and ''. Null and repeated
    doc_ids: each row keeps its own. A long text is aligned as one slice, in memory proportional to it; a word without
    blanks of any length is encoded whole. No other column is read. No rows: no rows.
    """

    def run(batches):
        encoders = shared_encoders(*paths())
        lengths = encoders.lengths
        tables, width = (_texts(len(lengths[0]), b"|"), _texts(len(lengths[1]), b";")), len(lengths[1])
        for batch in batches:
            for first, texts in _slices(batch[2]):
                s = _Slice(encoders.encode(texts), lengths)
                groups = s.group_texts(tables)
                doc, pair, times = s.pairs(width)
                n = np.bincount(doc, minlength=s.count)
                columns = [
                    *(c.slice(first, len(texts)) for c in (batch[0], batch[1])), *(pa.array(x, pa.int64()) for x in (*s.n, s.groups(), s.per_doc(s.links[0]))),
                    pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]), _lists(pair, n, pa.int64()), _lists(times, n, pa.int32()),
                ]
                if with_tokens:
                    base = np.cumsum(np.bincount(s.doc[0], lengths[0][s.ids[0]], s.count)).astype(np.int64)
                    base = np.concatenate([[0], base])[:-1]
                    for side in (0, 1):
                        columns += [_lists(s.ids[side], s.n[side], pa.int32()), _lists(s.end[side] - base[s.doc[side]], s.n[side], pa.int32())]
                    i, j = s.over
                    at = [np.concatenate([[0], np.cumsum(x)])[:-1] for x in s.n]
                    d = s.doc[0][i]
                    both = pa.StructArray.from_arrays([pa.array(i - at[0][d], pa.int32()), pa.array(j - at[1][d], pa.int32())], ["a", "b"])
                    columns += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(s.per_doc(i))]), pa.int32()), both), pa.array([g.decode() for g in groups])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = {"row": "long", "doc_id": docs.schema[id_col].dataType.simpleString(), **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), "long")}
    fields |= {"groups_sha256": "string", "pairs": "array<long>", "times": "array<int>"}
    if with_tokens:
        fields |= dict.fromkeys(("a_ids", "a_ends", "b_ids", "b_ends"), "array<int>") | {"overlaps": "array<struct<a: int, b: int>>", "groups": "string"}
    names = list(fields)
    rows = narrow(docs, doc_id=id_col, text=text_col)
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in fields.items()))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, count, rows, best): over all documents, the links of each pair of ids, the documents that hold
    it, and whether no other pair of its B id has more links.

    Documents bring each of their pairs once, and partial sums precede the shuffle. A B id has no more pairs than A has
    ids, so a window over one is bounded by the vocabulary.
    """
    pairs = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair"))
    counts = pairs.agg(F.sum(F.col("x.times").cast("long")).alias("count"), F.count("*").alias("rows"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    counts = counts.select("pair", F.shiftright("pair", 32).alias("a_id"), b.alias("b_id"), "count", "rows")
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b_id")))


def count_links(aligned: DataFrame, counts: DataFrame, most: int = 500_000) -> DataFrame:
    """(row, n_best, count_sum) of the documents with links: links whose pair is its B id's most frequent one, and the
    sum of the links' counts. Both frames should be cut.

    Pairs that over one in `most` of the (document, pair) rows hold are broadcast, so fewer than `most`, about 100 bytes
    each; their rows are summed where they are. The others, the rare ones, meet in a shuffle.
    """
    rows = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    both = join_hot(rows, counts.select("pair", "count", "best", "rows"), "pair", "rows", total, most)
    n = F.col("times")
    return both.groupBy("row").agg(F.sum(F.when(F.col("best"), n).otherwise(0)).alias("n_best"), F.sum(n * F.col("count")).alias("count_sum"))


def summarize(docs: DataFrame, paths: Callable[[], tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; as align_documents and
    count_links, zeros where there are no tokens.
    """
    aligned = written(align_documents(docs, paths, id_col, text_col, with_tokens=False), "aligned")
    counts = cut(pair_counts(aligned))
    scores = count_links(aligned, counts)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    plain = aligned.select("row", F.col("doc_id"), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return plain.join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
