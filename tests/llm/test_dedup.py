"""Line dedup, fuzzy hashes, SimHash links and near duplicates against brute force."""

import hashlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from skycat.llm import common, fuzzy_hash, graph, line_dedup, simhash


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def plain_lines(rows, min_chars=20, min_docs=3):
    """Rows (doc_id, text) to (doc_id, n_lines, n_dropped, kept text), by dictionaries."""
    blank, key = " \t\n\x0b\f\r", lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    number = lambda i: -(2**63) if i is None else i
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line.strip(blank)), set()).add(number(i))
    out = []
    for i, text in rows:
        lines, stays = (text or "").split("\n"), []
        for line in lines:
            held = holders[k := key(line.strip(blank))]
            if len(k) < min_chars or len(held) < min_docs or number(i) == max(held):
                stays.append(line)
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


def test_lines_brute_force(spark, odd):
    """Repeated ids with other texts, a document of 100,000 lines, lines held by a third of the rows and by all."""
    rng, shared = np.random.default_rng(2), ["a shared line number %d of many" % i for i in range(300)]
    rows = [(i // 2 if i % 40 == 1 else i, "\n".join(rng.choice(shared, int(rng.integers(0, 12))).tolist() + ["own line of document %d" % i, "short"] + ["The Very Common Line Of All  "] * (i % 3))) for i in range(300)]
    rows += [(1000, "\n".join(f"line number {i % 70_000} of a very long document" for i in range(100_000))), (1001, "\n".join(f"line number {i} of a very long document" for i in range(0, 70_000, 7))), (1002, "\n".join(f"line number {i} of a very long document" for i in range(0, 70_000, 5)))]
    rows += [tuple(r) for r in odd.select("doc_id", "text").collect()] + [rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).collect()]
    want = plain_lines(rows)
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[2] for r in want) > 5000


def test_lines_against_sql(spark, odd):
    rows = odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    documents = rows.toPandas()  # noqa: F841
    want = sorted(duckdb.sql(line_dedup.ORACLE).fetchall())
    got = line_dedup.dedup_lines(rows)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()) == [tuple(w) for w in want]


def test_lines_edges(spark, odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.count() == odd.count() and set(got.columns) >= set(odd.columns) - {"n_lines", "__key"}
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[0] == "" and texts[5].count("\n") == 1 and texts[8].endswith("a line that many documents share")
    assert line_dedup.dedup_lines(none).count() == 0


def test_fuzzy_hash(spark, odd, none):
    got = {(r.doc_id, r.n_chars): r for r in fuzzy_hash.fingerprint_documents(odd).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()), key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    assert len(rows) == odd.count()
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[key, len(text)]
        if key == 5:  # its two rows have different successors
            continue
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fuzzy_hash.fingerprint(text) and 0 <= r.near_edited <= 1
        assert r.near_next == fuzzy_hash.likeness(r.fingerprint, fuzzy_hash.fingerprint(after))
    assert fuzzy_hash.fingerprint_documents(none).count() == 0
    assert fuzzy_hash.fingerprint_documents(odd.filter("doc_id = 4")).first().near_next == 1.0


def test_fuzzy_hash_likeness():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(20)]
    for a, b in zip(texts, texts[1:]):
        x, y = fuzzy_hash.fingerprint(a), fuzzy_hash.fingerprint(b)
        assert fuzzy_hash.likeness(x, fuzzy_hash.fingerprint(a[:1400] + b[:600])) > fuzzy_hash.likeness(x, y) + 0.2
    assert fuzzy_hash.likeness("1::", "1::") == 1.0 and fuzzy_hash.likeness("1::", x) == 0.0


def plain_fingerprint(text):
    """Piecewise hashing by loops over bytes, with the module's table of random words."""
    data, full, table = text.encode("utf-8", "surrogatepass"), 2**64 - 1, fuzzy_hash._BYTES.tolist()
    if not data:
        return "1::"
    turn = lambda v, by: (v << by | v >> (32 - by)) & 0xFFFFFFFF if by else v
    rolling = []
    for i in range(len(data)):
        h = 0
        for back in range(min(7, i + 1)):
            h ^= turn(table[data[i - back]], 4 * back)
        rolling.append(h)
    mixed = [(h * 0xD6E8FEB86659FD93 & full) >> 16 for h in rolling]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def signature(block):
        out, at = "", 0
        while at < len(data):
            end = min(at + max(1, block // 4), len(data))
            while end < min(at + 4 * block, len(data)) and rolling[end - 1] % block != block - 1:
                end += 1
            out += letters[(sum(mixed[at:end]) * 0x9E3779B97F4A7C15 & full) >> 58]
            at = end
        return out

    block = 1
    while 64 * block <= len(data):
        block *= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def plain_likeness(x, y):
    """Edit distance of insertions and deletions by the usual table, at block sizes that agree."""
    def alike(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            old, row = row, [i]
            for j, d in enumerate(b, 1):
                row.append(old[j - 1] if c == d else 1 + min(old[j], row[-1]))
        return 1 - row[-1] / (len(a) + len(b)) if a or b else 1.0

    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    if x == y:
        return 1.0
    if not x1 or not y1 or int(bx) not in (int(by), 2 * int(by), int(by) // 2):
        return 0.0
    if bx == by:
        return max(alike(x1, y1), alike(x2, y2)) if min(len(x2), len(y2)) >= 16 else alike(x1, y1)
    return alike(x1, y2) if int(bx) > int(by) else alike(x2, y1)


def test_fuzzy_hash_brute_force(spark):
    """Fingerprints and likeness of every row by loops, over whole texts, as the registered query gives them."""
    rng = np.random.default_rng(8)
    texts = ["", "a", "aaaa " * 300, "Ünï 漢字 " * 20, *(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"], int(n))) for n in rng.integers(1, 400, 25))]
    texts += [texts[9], texts[10][: len(texts[10]) * 2 // 3] + texts[12]]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in fuzzy_hash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        after = texts[i - 1]  # descending ids; after the last (0) comes the first
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r, own, other, nxt = got[i], plain_fingerprint(text), plain_fingerprint(edited), plain_fingerprint(after)
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), own, other)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - plain_likeness(own, other)) < 1e-12 and abs(r.near_next - plain_likeness(own, nxt)) < 1e-12


def test_forest_joins_what_all_links_join():
    rng = np.random.default_rng(0)
    values = set()
    for base in rng.integers(0, 2**63, 30, dtype=np.uint64).tolist():
        for _ in range(int(rng.integers(1, 30))):
            v = base
            for k in rng.integers(0, 64, int(rng.integers(0, 6))).tolist():
                v ^= 1 << k
            values.add(v)
    values = np.array(sorted(values), dtype=np.uint64)
    n, left = len(values), rng.random(len(values)) < 0.5
    all_links = [(i, j) for i in range(n) for j in range(i) if (int(values[i]) ^ int(values[j])).bit_count() <= 3]
    assert components(range(n), simhash.forest(values, 3)) == components(range(n), all_links)
    across = [(i, j) for i, j in all_links if left[i] != left[j]]
    assert components(range(n), simhash.forest(values, 3, left)) == components(range(n), across)
    tree = simhash.BKTree(values)
    assert sorted(tree.search(int(values[5]), 3)) == [j for j in range(n) if (int(values[5]) ^ int(values[j])).bit_count() <= 3]


def test_simhash_links(spark, odd, none):
    from xxhash import xxh64_intdigest

    def brute(text):
        words = (text or "").encode().lower().split()
        hashes = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    extra = [(100 + i, f"alpha beta gamma delta {i % 3} " * 40 + f"tail {i}") for i in range(30)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r.doc_id, brute(r.text)) for r in docs.collect()]
    got = simhash.link_documents(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{v:016x}") for i, v in rows)
    ids = sorted({i for i, _ in rows if i is not None})
    linked = [(a, b) for a, x in rows for b, y in rows if a is not None and b is not None and (x ^ y).bit_count() <= 3]
    want = components(ids, linked)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.link_documents(none).count() == 0


def test_split_shards_lose_no_link(spark):
    rng = np.random.default_rng(3)
    values = {7}
    while len(values) < 300:
        v = 7
        for k in rng.integers(0, 20, 2).tolist():
            v ^= 1 << k
        values.add(v)
        if len(values) >= 180:
            values.add(int(rng.integers(0, 2**62)))
    values = sorted(values)
    keyed = spark.createDataFrame([(1, v, v) for v in values], "key int, node long, value long")
    links = simhash.shard_links(keyed, 3, shard=40)
    want = components(values, [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 3])
    assert components(values, [tuple(r) for r in links.collect()]) == want
    roots = {r.node: r.root for r in graph.components(links).collect()}
    assert all(roots.get(v, v) == want[v] for v in values)


def test_narrowed_keys_lose_no_link(spark):
    """Fingerprints that all share two blocks of bits: narrower keys, the same components, fewer rows than pairs."""
    rng = np.random.default_rng(4)
    values = {int(v) << 26 for v in rng.integers(0, 2**37, 400)}
    for v in list(values)[:200]:
        for k in rng.integers(26, 63, int(rng.integers(1, 4))).tolist():
            v ^= 1 << k
        values.add(v)
    values = sorted(values)
    nodes = spark.createDataFrame([(v,) for v in values], "value long")
    keyed = nodes.select(F.explode(simhash.block_keys(F.col("value"), 3, 5)).alias("key"), F.col("value").alias("node"), "value")
    finer = simhash.split_keys(keyed, 3, 5, most=40)
    largest = lambda df: df.groupBy("key").count().agg(F.max("count")).first()[0]
    assert largest(keyed) == len(values) and largest(finer) < 40
    want = components(values, [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 3])
    assert components(values, [tuple(r) for r in simhash.shard_links(finer, 3).collect()]) == want


def test_range_groups(spark):
    for n in (0, 1, 2, 5, 30):
        points = sorted({int(x) for x in np.random.default_rng(n).integers(-50, 50, n)})
        keys = spark.range(-60, 60).select(F.col("id").alias("k"), common.range_group(F.col("id"), points).alias("g"))
        assert all(r.g == sum(p <= r.k for p in points) for r in keys.collect())


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(5)
    words = ["w%d" % i for i in range(500)]
    texts = {}
    for i in range(40):
        base = rng.choice(words, 200).tolist()
        for j in range(4):
            text = list(base)
            for k in rng.integers(0, 200, [0, 0, 3, 12][j]).tolist():
                text[k] = "edit"
            texts[10 * i + j] = " ".join(text)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    sets = {k: set(simhash.ShingleSets(5)(t).tolist()) for k, t in texts.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(sets, linked)
    assert sum(got[k] != want[k] for k in want) <= 2
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, None, 4, 5, 7, 8, 9, 10}
    assert simhash.drop_near_duplicates(none).count() == 0


def test_near_duplicates_at_the_threshold(spark):
    """One template whose pages are mostly just under the similarity: a failed candidate mustn't hide a true pair."""
    rng = np.random.default_rng(7)
    base = rng.permutation(100_000)[:204].tolist()
    texts = {}
    for i in range(300):
        text = list(base)
        for k in rng.permutation(204)[:3].tolist():
            text[k] = int(rng.integers(100_000, 10**9))
        texts[i] = " ".join(map(str, text))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    sets = {k: set(simhash.ShingleSets(5)(t).tolist()) for k, t in texts.items()}
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    linked = [p for p, x in likeness.items() if x >= 0.8]
    assert 0.7 < np.mean(list(likeness.values())) < 0.82 and 10 < len(linked)
    want = components(sets, linked)
    joined = sum(got[a] == got[b] for a, b in linked)
    assert all(want[k] == want[got[k]] for k in got), "no link without the similarity"
    assert joined >= 0.99 * len(linked)


def groups_by_brute_force(texts):
    sets = {k: set(simhash.ShingleSets(5)(t).tolist()) for k, t in texts.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return components(sets, linked)


def test_near_duplicates_of_short_texts(spark):
    """Texts of 1 to 40 shingles: every pair at or over the similarity is found, as prefixes are exact."""
    rng, texts = np.random.default_rng(11), {}
    for i in range(60):
        n = int(rng.integers(5, 40))
        base = rng.integers(0, 10**6, n).tolist()
        for j in range(4):
            text = base + rng.integers(0, 10**6, int(rng.integers(0, 2 + n // 8))).tolist()
            texts[4 * i + j] = " ".join(map(str, text))
    texts |= {1000: "a b c d e f g h", 1001: "a b c d e f g h i", 1002: "a b c", 1003: "A  B c", 1004: "", 1005: " \t"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == groups_by_brute_force(texts) and got[1001] == 1000 and got[1003] == 1002 and got[1005] == 1004


def test_near_duplicates_over_blocks(spark):
    """A family larger than a block: pairs of blocks are checked as well; repeated ids are one document."""
    rng = np.random.default_rng(13)
    base = rng.permutation(100_000)[:150].tolist()
    texts = {}
    for i in range(200):
        text = list(base)
        for k in rng.permutation(150)[: int(rng.integers(0, 6))].tolist():
            text[k] = int(rng.integers(100_000, 10**9))
        texts[i] = " ".join(map(str, text))
    rows = list(texts.items()) + [(0, "another text of the same id"), (500, "another text of the same id"), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, block=3000).collect()}
    want = groups_by_brute_force(texts)
    assert {k: got[k] for k in texts} == want and got[500] == got[0] == 0 and len(got) == 201


def test_graph_of_a_long_path(spark):
    """By one task and by rounds."""
    path = spark.range(200).selectExpr("id as a", "id + 1 as b")
    for few in (0, 1000):
        rows = graph.components(path.unionByName(path.selectExpr("b as a", "a as b")), few=few).collect()
        assert len(rows) == 201 and {r.root for r in rows} == {0}
        assert graph.components(path.limit(0), few=few).count() == 0


def test_graph_both_ways(spark):
    """Random links, loops, repeats and nulls, negative nodes: both ways give what joining sets gives."""
    rng = np.random.default_rng(6)
    pairs = rng.integers(-300, 300, (220, 2)).tolist() + [[5, 5], [None, 3], [7, None], [1, 2], [2, 1]]
    links = spark.createDataFrame([tuple(p) for p in pairs], "a long, b long")
    known = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    want = components({x for p in known for x in p}, known)
    for few in (0, 1000):
        assert {r.node: r.root for r in graph.components(links, few=few).collect()} == want
