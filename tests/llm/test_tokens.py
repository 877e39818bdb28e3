"""Packing, token files and byte BPE: exact round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from skycat.llm import byte_bpe, packing, token_files, token_ids, wavelet  # noqa: E402
from skycat.llm.common import fresh_dir  # noqa: E402
from skycat.llm.queries import word_encoder  # noqa: E402
from skycat.llm.token_ids import WordEncoder  # noqa: E402

ODD = ["It's  a<|endoftext|>b ok,'s x'll, ÀÉ. ’s áb ́x İstanbul ΣΑΣ. 12ab!? ÑOÑ éé,, ﬁn", "J̌a b", "x²,y ﬀ,K\x1cz\x85 Ⅷ", "漢字かな 한국어 नमस्ते", "THE&&& the*** | a | b"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def expected(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_word_encoder_equals_library(library):
    encoder = WordEncoder(P.path("word_bpe_49k.json"), memory=5)
    for t in [*ODD, *ODD]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == expected(library, t)[:-1]


def test_memo_is_bounded_by_bytes():
    """2,000 texts of 4,000 characters without a blank are not remembered; short words take their share of bytes."""
    asked = []
    memo = token_ids._Memo(lambda w: asked.append(w) or w.encode(), 1 << 20)
    for i in range(2000):
        assert memo["漢字" * 2000 + str(i)] is not None
    assert not memo and not memo.old
    for i in range(20_000):
        assert memo[str(i)] == str(i).encode()
    held = sum(len(k) + len(v) + 200 for m in (memo, memo.old) for k, v in m.items())
    assert held < 1.1 * (1 << 20) and len(memo) + len(memo.old) > 1000
    memo["7"], n = memo["7"], len(asked)
    assert memo["7"] == b"7" and len(asked) == n


def test_texts_without_blanks(library):
    texts = ["".join(chr(0x4E00 + (i * 7 + k * k) % 20_000) for k in range(4000)) for i in range(20)]
    encoder = WordEncoder(P.path("word_bpe_49k.json"))
    bpe = byte_bpe.ByteBPE(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == expected(library, t)[:-1]
        assert bpe.decode(bpe.encode(t)) == t.encode()
    assert all(len(k) <= 256 for m in (encoder.words, bpe.pieces, bpe.parts) for k in m)


def test_fill_window_is_optimal():
    rng = random.Random(4)
    for _ in range(40):
        left = Counter(rng.choices(range(1, 30), k=rng.randint(1, 8)))
        lengths, capacity = sorted(left, reverse=True), 40
        chosen = packing.fill_window(left, lengths, capacity)
        assert all(chosen[n] <= left[n] for n in chosen) and chosen[lengths[0]] >= 1
        rest = list((left - Counter([lengths[0]])).elements())
        sums = {lengths[0]}
        for n in rest:
            sums |= {s + n for s in sums if s + n <= capacity}
        assert sum(n * c for n, c in chosen.items()) == max(sums)


def test_packing(spark, odd, none, library):
    rows = packing.pack_documents(odd, word_encoder, end_id=2, capacity=256, group_tokens=3000).collect()
    texts = defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        texts[r.doc_id].append(expected(library, r.text))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert any(zlib.crc32(np.array(t[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(t) == r.doc_tokens for t in texts[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for key, found in texts.items():
        covered = Counter(i for s, n in pieces[key] for i in range(s, s + n))
        assert covered == Counter(i for t in found for i in range(len(t)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack_documents(none, word_encoder, end_id=2).count() == 0


def test_token_files(spark, odd, none, library):
    folder = fresh_dir(spark, "test-shards")
    token_files.write_token_shards(odd, folder, word_encoder, end_id=2, shard_tokens=500)
    got = sorted(map(tuple, token_files.read_token_shards(spark, folder).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    source = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at, want = 0, []
    for r in source:
        ids = expected(library, r.text)
        want.append((at, r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    folder = fresh_dir(spark, "test-shards")
    token_files.write_token_shards(none, folder, word_encoder, end_id=2)
    assert token_files.read_token_shards(spark, folder).count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(0).integers(0, 49000, 3000).astype(np.uint32)
    ids[100:200], ids[2999] = 7, 65535
    shard = wavelet.load(wavelet.dump([1, None, 3], [1000, 1000, 1000], ids, 16))
    matrix = shard.matrix
    assert shard.doc_ids == [1, None, 3] and shard.lengths.tolist() == [1000] * 3
    assert (matrix.decode() == ids).all() and (matrix.access(range(3000)) == ids).all()
    for token in (7, 65535, int(ids[5]), 48_999, 70_000):
        where = np.flatnonzero(ids == token).tolist()
        assert matrix.count(token) == len(where) and matrix.occurrences(token) == where
        assert matrix.rank(token, 150) == sum(w < 150 for w in where)
    for bad in (lambda: matrix.select(7, 100), lambda: matrix.access([3000]), lambda: matrix.access([-1])):
        with pytest.raises(IndexError):
            bad()
    assert wavelet.WaveletMatrix.build(np.zeros(0, np.uint16), 16).count(3) == 0


def test_wavelet_parts():
    """Several parts a plane: all answers by brute force, each from few reads of the file."""
    ids = (np.random.default_rng(1).zipf(1.3, 1_000_000) % 5000).astype(np.uint32)
    data, reads = wavelet.dump([9], [len(ids)], ids, 16), []
    matrix = wavelet.Shard(lambda at, n: reads.append(n) or data[at : at + n]).matrix
    before = sum(reads)
    assert matrix.count(17) == (ids == 17).sum() and sum(reads) - before < 0.4 * len(data)
    places = [0, 65_535, 65_536, 131_071, 999_999]
    assert matrix.access(places).tolist() == ids[places].tolist()
    where = np.flatnonzero(ids == 3)
    assert matrix.occurrences(3) == where.tolist() and matrix.ranks(3, [0, 70_000, 3_000_000]).tolist() == [0, (where < 70_000).sum(), len(where)]
    assert (matrix.decode() == ids).all()


def test_wavelet_rejects_wide_ids():
    with pytest.raises(ValueError):
        wavelet.dump([1], [3], np.array([1, 65536, 70000], np.uint32), 16)
    assert wavelet.load(wavelet.dump([1], [3], np.array([1, 65536, 70000], np.uint32), 17)).matrix.decode().tolist() == [1, 65536, 70000]


def test_token_lookups(spark, odd, library):
    """Counts, places and access over the files equal plain loops over the ids."""
    folder = fresh_dir(spark, "test-shards")
    token_files.write_token_shards(odd, folder, word_encoder, end_id=2, shard_tokens=500)
    ids = [(r.doc_id, expected(library, r.text)) for r in odd.select("doc_id", "text").collect()]
    tokens = [2, ids[4][1][0], ids[9][1][0], 40_000]
    counts = {r.token: r.n for r in token_files.token_counts(spark, folder, tokens).collect()}
    assert counts == {t: sum(x.count(t) for _, x in ids) for t in tokens}
    places = sorted((r.token, str(r.doc_id), r["at"]) for r in token_files.token_occurrences(spark, folder, tokens, step=1000).collect())
    assert places == sorted((t, str(i), at) for t in tokens for i, x in ids for at, y in enumerate(x) if y == t)
    wanted = spark.createDataFrame([(4, 0), (4, 3), (9, 777), (9, 10**6), (None, 0), (77, 0), (4, None), (4, -1), (4, 3)], "doc_id long, at long")
    got = sorted((r.doc_id, r["at"], r.token) for r in token_files.tokens_at(spark, folder, wanted).collect())
    own = {i: x for i, x in ids if i in (4, 9)}
    assert got == [(4, 0, own[4][0]), (4, 3, own[4][3]), (9, 777, own[9][777])]
    ends = token_files.read_token_shards(spark, folder, count_id=2).agg({"n_counted": "sum"}).first()[0]
    assert ends == counts[2]


def test_byte_bpe_equals_tiktoken(spark, odd, none):
    import hashlib

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    bpe, rng = byte_bpe.ByteBPE(path, P.PATTERN, memory=50), random.Random(1)
    alphabet = "ab éß'st 12\n\t   　\x85\x1c\x0b漢😀.,!|"
    for t in [*ODD, "", *("".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(2000))]:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == reference.encode_ordinary(t)
        assert bpe.decode(bpe.encode(t)) == t.encode()
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode_documents(odd, path, P.PATTERN).collect())
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.encode_documents(none, path, P.PATTERN).count() == 0
