"""Byte-level BPE through a sentencepiece model that is made from the vocabulary itself."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow
from .token_ids import _Memo

#: Where a run of white space holds more than one character, or a separator on which the engines differ.
_RUN = re.compile("\\s\\s|[\x1c-\x1f\x85]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _char(byte: int) -> str:
    """One character of the private-use area for each byte: no white space, no letter, no normalisation."""
    return chr(0xE000 + byte)


def make_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model of type BPE: the unknown piece, then each token's bytes as characters, scored by
    its negative rank; identity normaliser, no dummy prefix, white space kept.
    """
    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    ordered = sorted(ranks.items(), key=lambda x: x[1])
    pieces = [piece("<unk>", 0.0, 2)] + [piece("".join(map(_char, token)), -float(rank), 1) for token, rank in ordered]
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + _number(41, 2**64 - 1) + _number(42, 2**64 - 1) + _number(43, 2**64 - 1)
    normalizer = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    """Encodes by sentencepiece, pre-token by pre-token, and decodes by the inverse map.

    memory: about the bytes that each of the two memos, of pre-tokens and of words, may take.
    """

    def __init__(self, path: str, pattern: str, memory: int = 128 << 20):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=make_model(ranks))
        self.rank_of = np.array([0] + sorted(ranks.values()), dtype="<u4")
        self.exact = {token: np.array([rank], dtype="<u4").tobytes() for token, rank in ranks.items()}
        self.token_of = {rank: token for token, rank in ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.mapped = {i: _char(i) for i in range(256)}
        self.pieces, self.parts = _Memo(self._piece, memory), _Memo(self._part, memory)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        if (known := self.exact.get(data)) is not None:
            return known
        return self.rank_of[self.model.encode(data.decode("latin-1").translate(self.mapped))].tobytes()

    def _part(self, part: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.findall(part)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes.

        No match of the pattern reaches over a single blank but one that starts with it, so a text without runs of
        white space is looked up in parts that each start at a blank; another text is matched as a whole.
        """
        if not text:
            return b""
        if _RUN.search(text):
            return self._part(text)
        first, *rest = text.split(" ")
        get = self.parts.__getitem__
        return get(first) + b"".join([get(" " + p) for p in rest])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def shared_bpe(path: str, pattern: str) -> ByteBPE:
    """The worker process's encoder: the model is made once, what it remembers serves the tasks that follow."""
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, path: str | Callable[[], str], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, the ids and the decoded text.

    The ids are those of byte-level BPE with the ranks at `path` over each match of `pattern`; digests are of the ids
    as little-endian unsigned 32-bit integers and of the decoded bytes. One pass over the input, without a shuffle.
    path: of a file that executors have, or a function that tells it in a task.

    Null or empty text: no tokens. Null and repeated doc_ids: each row keeps its own. No rows: no rows.
    """

    def run(batches):
        bpe = shared_bpe(path() if callable(path) else path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                ids = [bpe.encode(t.as_py()) for t in part[1]]
                decoded = [bpe.decode(x) if with_ids else hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
                digests = [hashlib.sha256(x).hexdigest() for x in decoded] if with_ids else decoded
                columns = [part[0], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(digests)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([x.decode("utf-8", "replace") for x in decoded])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(run, kinds)
