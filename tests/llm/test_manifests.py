"""Sharding, Merkle manifest and token alignment against plain loops and the libraries."""

import hashlib
import string
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skycat.llm import alignment, merkle, queries, sharding

SF = "/root/testdata/sf0.001"


def documents(rows) -> list[dict]:
    return [r.asDict() for r in rows.collect()]


# --- op11


def jump_alone(key: int, shards: int) -> int:
    at, place = -1, 0
    while place < shards:
        at, key = place, (key * 2862933555777941757 + 1) % 2**64
        place = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


def test_jump_equals_the_loop():
    keys = np.random.default_rng(5).integers(0, 2**64, 5000, np.uint64)
    for shards in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, shards).tolist() == [jump_alone(int(k), shards) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_more_shards_take_rows_into_themselves_alone():
    keys = np.random.default_rng(6).integers(0, 2**64, 100_000, np.uint64)
    for shards in (1, 7, 24):
        old, new = sharding.jump(keys, shards), sharding.jump(keys, shards + 1)
        moved = old != new
        assert (new[moved] == shards).all() and abs(moved.mean() - 1 / (shards + 1)) < 0.01
        assert np.bincount(old, minlength=shards).max() < 1.1 * len(keys) / shards


def shards_alone(docs: list[dict]) -> list[tuple]:
    slots, out = Counter(), []
    for d in sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, zlib.crc32((d["text"] or "").encode()))):
        key = 42 if d["doc_id"] is None else xxhash.xxh64(struct.pack("<q", d["doc_id"]), seed=42).intdigest()
        text, s = (d["text"] or "").encode(), jump_alone(key, 24)
        out.append((d["doc_id"], len(text) + 8, zlib.crc32(text), "key", s, slots[s], jump_alone(key, 25)))
        slots[s] += 1
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_shards_of_odd_rows(odd, none):
    got = sharding.shard_documents(odd)
    assert order(map(tuple, got.collect())) == order(shards_alone(documents(odd.select("doc_id", "text"))))
    assert sharding.shard_documents(none).count() == 0


def test_op11_query(spark):
    docs = documents(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    assert order(map(tuple, queries.op11_sharding(spark, SF).collect())) == order(shards_alone(docs))


def test_one_id_of_a_third_of_all_rows(spark):
    """Slots of the crowded shard have no gaps, though many chunks hold it."""
    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "case when id % 6 = 0 then 'same' else concat('t', id % 50) end as text")
    got = sharding.shard_documents(rows).collect()
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len(got) == 3000 and len({r.shard for r in got if r.doc_id == 7}) == 1


def test_written_shards_hold_all_rows(spark, odd, tmp_path):
    rows = odd.unionByName(odd)
    sharding.write_shards(rows, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert order(map(tuple, back.select(rows.columns).collect())) == order(map(tuple, rows.collect()))
    assert back.select("doc_id", "shard").distinct().count() == rows.select("doc_id").distinct().count()
    with pytest.raises(ValueError):
        sharding.write_shards(rows.withColumn("Shard", F.lit(1)), str(tmp_path / "t"))


# --- op12


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_alone(d: dict) -> str:
    return sha(*("-" if d[c] is None else f"{len(str(d[c]).encode())}:{d[c]}" for c in merkle.FIELDS))


def tree_alone(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_alone(levels: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out.append((level[first:i], level[i + 1 : first + 8]))
        i //= 8
    return out


def manifest_alone(docs: list[dict]) -> list[tuple]:
    groups: dict = {}
    for d in sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf_alone(d))):
        groups.setdefault(d["lang"], []).append(d)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree_alone(list(map(leaf_alone, groups[x]))) for x in langs}
    top, out = tree_alone([trees[x][-1][0] for x in langs]), []
    for at, lang in enumerate(langs):
        for i, d in enumerate(groups[lang]):
            path, low = path_alone(trees[lang], i) + path_alone(top, at), dict(d)
            if d["doc_id"] is not None and d["text"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0:
                low["text"] = d["text"].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            node = leaf_alone(low)
            for before, after in path:
                node = sha(*before, node, *after)
            root = top[-1][0]
            out.append((d["doc_id"], leaf_alone(d), trees[lang][-1][0], root, sha(*(s for b, a in path for s in (*b, *a))), node, node == root))
    return out


@pytest.fixture(scope="module")
def odd_docs(odd):
    langs = F.element_at(F.array(F.lit("de"), F.lit(None), F.lit(""), F.lit("de"), F.lit("ä"), F.lit("z")), F.pmod(F.xxhash64("text"), F.lit(6)).cast("int") + 1)
    return odd.withColumns({"lang": langs, "source": F.when(F.col("doc_id") > 4, "s:1"), "n_chars": F.length("text").cast("long")})


def test_manifest_of_odd_rows(odd_docs):
    """Null, empty and long texts, repeated rows, null ids and groups, extra columns."""
    wanted = manifest_alone(documents(odd_docs.select(*merkle.FIELDS)))
    assert order(map(tuple, merkle.manifest(odd_docs).collect())) == order(wanted)
    assert merkle.manifest(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 8, 9, 65, 600])
def test_manifest_of_any_size(spark, n):
    """Last runs of one node, whole runs, many groups, one group."""
    rows = spark.range(n).selectExpr("id as doc_id", "concat('Text ', id) as text", "case when id % 5 = 0 then concat('l', id % 70) else 'en' end as lang", "'S' as source", "id * 2 as n_chars")
    assert order(map(tuple, merkle.manifest(rows).collect())) == order(manifest_alone(documents(rows)))
    one = rows.withColumn("lang", F.lit("en"))
    assert order(map(tuple, merkle.manifest(one).collect())) == order(manifest_alone(documents(one)))


def test_equal_subtrees_are_one_record(spark):
    """A third of all rows are one row: their runs have one digest, which is looked up without a crowded task."""
    rows = spark.range(30_000).selectExpr("case when id % 3 = 0 then null else id end as doc_id", "'x' as text", "'en' as lang", "'s' as source", "1L as n_chars").withColumn("text", F.when(F.col("doc_id").isNull(), "same").otherwise(F.concat(F.lit("t"), "doc_id")))
    placed = [(i, sha(str(i)) if i > 16_000 else sha("same")) for i in range(40_000)]
    store = merkle.build(spark.createDataFrame(placed, "place long, digest string").selectExpr("'t' as tree", "place", "digest"))
    assert store.hot[0] and store.records(0).count() == 1 + (40_000 - 16_000) // 8
    assert order(map(tuple, merkle.manifest(rows).collect())) == order(manifest_alone(documents(rows)))


def test_requests_alone(spark, odd_docs):
    """Proofs of some documents are those of the whole manifest, and fold to the root."""
    rows = spark.range(700).selectExpr("id as doc_id", "concat('Text ', id) as text", "if(id % 9 = 0, 'fr', 'en') as lang", "'S' as source", "id as n_chars")
    whole = {r.doc_id: r for r in merkle.manifest(rows).collect()}
    some = merkle.manifest(rows, requests=spark.createDataFrame([(3,), (9,), (699,), (5000,)], "doc_id long"), digests_only=False).collect()
    assert {r.doc_id for r in some} == {3, 9, 699}
    for r in some:
        assert tuple(whole[r.doc_id]) == tuple(r)[:6] + (r.verified,) or tuple(whole[r.doc_id]) == (r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
        node = r.leaf
        for segment, turn in zip(r.segments, r.turns):
            node = sha(segment[: 64 * turn], node, segment[64 * turn :])
        assert node == r.root
    null = spark.createDataFrame([(None,)], "doc_id long")
    assert merkle.manifest(odd_docs, requests=null).count() == odd_docs.filter("doc_id is null").count()


def test_op12_query(spark):
    docs = documents(spark.read.parquet(f"{SF}/documents.parquet"))
    assert order(map(tuple, queries.op12_merkle(spark, SF).collect())) == order(manifest_alone(docs))


def test_op12_sql(spark, odd_docs, tmp_path):
    """The SQL gives the same rows, on the table and on odd rows."""
    import duckdb

    odd_docs.write.parquet(str(tmp_path / "odd"))
    for files, rows in ((f"{SF}/documents.parquet", queries.op12_merkle(spark, SF)), (f"{tmp_path}/odd/*.parquet", merkle.manifest(odd_docs))):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{files}'")
        assert order(con.execute(queries.ORACLE["op12_merkle"]).fetchall()) == order(map(tuple, rows.collect()))


# --- op13


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = queries.tokenizer_pair()
    one = Tokenizer.from_file(a)
    one.encode_special_tokens = True
    return one, SentencePieceProcessor(model_file=b)


def tokens_alone(libraries, text: str | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(id, end) of both sides by the libraries on the whole text."""
    if not text:
        return [], []
    one, two = libraries
    known, out = alignment.byte_level(), []
    pieces = [(i, bytes(known[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
    byte = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
    for side in (pieces, [(i, byte(i)) for i in two.encode(text)]):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        ends = np.cumsum([len(x) for _, x in side]).tolist()
        out.append([(i, e) for (i, _), e in zip(side, ends)])
    return out[0], out[1]


def aligned_alone(libraries, texts) -> list[tuple]:
    found, counts = [], Counter()
    for text in texts:
        a, b = tokens_alone(libraries, text)
        ends_a, ends_b = {e: i for i, e in a}, {e: i for i, e in b}
        common = sorted(ends_a.keys() & ends_b.keys())
        links = [(ends_a[e], ends_b[e]) for e in common]
        groups, low = [], 0
        for e in common:
            groups.append(",".join(str(i) for i, x in a if low < x <= e) + "|" + ",".join(str(i) for i, x in b if low < x <= e))
            low = e
        counts.update(links)
        found.append((len(a), len(b), len(common), links, ";".join(groups)))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if links else "") for na, nb, ng, links, g in found]


TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "  lead", "tail  ", "line\n\n two \n  three", "it's we'll <|endoftext|> and </s> <s>", "under▁score", "▁", "Ünïcode 漢字 😀 words", "x" * 3000, "word " * 400,
    "a\x00b \x1c c\x85 d\xa0 e", "<0x41> is no byte", "1234 5,678.90 !?!? ...", "tab\tand\r\nreturn", "é é ﬁ", "　wide　 blank", "word word word, word",
]


def columns(r) -> tuple:
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


def test_alignment_of_odd_rows(spark, libraries, odd, none):
    texts = [r.text for r in odd.select("text").collect() if len(r.text or "") < 5000] + TEXTS
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pairs", F.lit("z")).withColumn("row", F.lit("z"))
    got = {r.doc_id: columns(r) for r in alignment.summarize(rows, queries.tokenizer_pair).collect()}
    assert [got[i] for i in range(len(texts))] == aligned_alone(libraries, texts)
    assert alignment.summarize(odd, queries.tokenizer_pair).count() == odd.count()
    assert alignment.summarize(none, queries.tokenizer_pair).count() == 0


def test_encoders_equal_the_libraries(libraries):
    """Parts, the memo and its restarts change nothing; random strings of letters, marks, blanks and other scripts."""
    rng = np.random.default_rng(8)
    signs = list("abcdeäß'.,!  \n\t12▁<漢é́\xa0")
    texts = ["".join(rng.choice(signs, rng.integers(1, 60))) for _ in range(600)]
    encoders = alignment.TwoEncoders(*queries.tokenizer_pair(), memory=20_000)
    for at in range(0, 600, 60):
        for text, ids in zip(texts[at : at + 60], encoders.encode(texts[at : at + 60])):
            a, b = tokens_alone(libraries, text)
            assert [np.frombuffer(x, np.uint32).tolist() for x in ids] == [[i for i, _ in a], [i for i, _ in b]], text


def test_overlaps_groups_and_ends(spark, libraries):
    rows = spark.createDataFrame([(1, "Unbelievable tokenizations, 漢字!"), (2, None), (3, "plain words here")], "doc_id long, text string")
    for r in alignment.align_documents(rows, queries.tokenizer_pair).collect():
        text = {1: "Unbelievable tokenizations, 漢字!", 2: None, 3: "plain words here"}[r.doc_id]
        a, b = tokens_alone(libraries, text)
        assert list(zip(r.a_ids, r.a_ends)) == a and list(zip(r.b_ids, r.b_ends)) == b
        spans = [[(lo, hi) for lo, hi in zip([0, *(e for _, e in s)], (e for _, e in s))] for s in (a, b)]
        assert [tuple(x) for x in r.overlaps] == [(i, j) for i, (p, q) in enumerate(spans[0]) for j, (x, y) in enumerate(spans[1]) if p < y and x < q]
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 or not text


def test_op13_query(spark, libraries):
    docs = documents(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    wanted = dict(zip((d["doc_id"] for d in docs), aligned_alone(libraries, [d["text"] for d in docs])))
    assert {r.doc_id: columns(r) for r in queries.op13_alignment(spark, SF).collect()} == wanted
