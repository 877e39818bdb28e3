"""SimHash fingerprints, and links between near ones by BK-trees over shards that share blocks of bits."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, narrow, partitions, small
from .graph import components
from .words import mix, word_hashes

#: For each byte, eight byte lanes that hold its bits, lowest first: sums of up to 255 of them don't overflow.
_LANES = np.array([sum((byte >> i & 1) << (8 * i) for i in range(8)) for byte in range(256)], dtype="<u8")


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half of the rows of a matrix of unsigned 64-bit words, as one row of words."""
    n, words = hashes.shape
    columns = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(n, words * 8)
    counts = np.zeros(words * 64, dtype=np.int64)
    for at in range(0, n, 255):
        counts += _LANES[columns[at : at + 255]].sum(0, dtype="<u8").view(np.uint8)
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8")


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of `size` words, repeats included; of all words if there are fewer.

    Words lie between blanks and \\t to \\r, with A-Z lower-cased; a shingle joins them by one blank.
    """
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    ends, at = [], -1
    for n in map(len, words):
        at += n + 1
        ends.append(at)
    if len(words) <= size:
        return np.array([digest(line, 42)], dtype="<u8")
    starts = [0, *(e + 1 for e in ends)]
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :])], dtype="<u8")


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of the text's shingles; 0 without words."""
    hashes = shingle_hashes(text, size)
    return int(majority(hashes.reshape(-1, 1))[0]) if len(hashes) else 0


def _words(values: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of unsigned 64-bit words."""
    values = np.asarray(values, dtype=np.uint64)
    return values[:, None] if values.ndim == 1 else values


def _number(words: np.ndarray) -> int:
    return int.from_bytes(np.ascontiguousarray(words, dtype="<u8").tobytes(), "little")


class BKTree:
    """Fingerprints by Hamming distance: a child hangs on the edge of its distance to the parent."""

    def __init__(self, values: np.ndarray):
        self.words = _words(values)
        self.values = [_number(v) for v in self.words]
        self.children: list[dict[int, int]] = [{} for _ in self.values]
        for i, v in enumerate(self.values[1:], 1):
            at = 0
            while (nxt := self.children[at].get(d := (v ^ self.values[at]).bit_count())) is not None:
                at = nxt
            self.children[at][d] = i

    def search(self, value: int, radius: int) -> list[int]:
        """The places of all values within the radius: only edges within it of the distance are followed."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            stack += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found

    def search_all(self, values: np.ndarray, radius: int):
        """Yields (place, numbers of the queries within the radius, their distances): one walk for many queries."""
        values = _words(values)
        stack = [(0, np.arange(len(values)))] if self.values else []
        while stack:
            at, some = stack.pop()
            d = np.bitwise_count(values[some] ^ self.words[at]).sum(1, dtype=np.int64)
            near = d <= radius
            if near.any():
                yield at, some[near], d[near]
            for e, c in self.children[at].items():
                if len(rest := some[np.abs(d - e) <= radius]):
                    stack.append((c, rest))


def forest(values: np.ndarray, radius: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join exactly what all links within the radius join, the nearest pairs first.

    left: marks the part whose tree is searched by the others; without it every value is searched in the tree of all.
    """
    values = _words(values)
    own = np.arange(len(values)) if left is None else np.flatnonzero(left)
    others = own if left is None else np.flatnonzero(~left)
    tree = BKTree(values[own])
    if len(own) * len(others) <= 256:
        number = [_number(v) for v in values]
        pairs = [(a, b) for j in others.tolist() for i in tree.search(number[j], radius) if (a := int(own[i])) != (b := j)]
        pairs.sort(key=lambda p: (number[p[0]] ^ number[p[1]]).bit_count())
        layers = [pairs]
    else:
        at: list[list] = [[] for _ in range(radius + 1)]
        for i, found, d in tree.search_all(values[others], radius):
            for k in np.unique(d):
                at[k].append((int(own[i]), others[found[d == k]]))
        layers = at
    group, links = np.arange(len(values)), []
    for layer in layers:
        for a, found in layer:
            for b in [found] if isinstance(found, int) else found[np.unique(group[found], return_index=True)[1]].tolist():
                if group[a] != group[b]:
                    links.append((a, b))
                    group[group == group[b]] = group[a]
    return links


def _masks(radius: int, blocks: int, bits: int = 64) -> list[tuple[int, list[int]]]:
    """For each choice of `blocks` - `radius` blocks: the mask of its bits, and masks of `radius` + 1 parts of all others."""
    edges, made = [bits * i // blocks for i in range(blocks + 1)], []
    for chosen in combinations(range(blocks), blocks - radius):
        own = [b for i in chosen for b in range(edges[i], edges[i + 1])]
        free = [b for b in range(bits) if b not in own]
        cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
        made.append((sum(1 << b for b in own), [sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]))
    return made


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_keys(value, radius: int, blocks: int):
    """An array of keys: values within the radius have one in common, as some blocks - radius blocks stay equal.

    A key holds the number of the choice of blocks and the chosen bits.
    """
    keys = [F.struct(F.lit(n).alias("choice"), value.bitwiseAND(F.lit(_signed(mask))).alias("bits")) for n, (mask, _) in enumerate(_masks(radius, blocks))]
    return F.array(*keys)


def split_keys(keyed: DataFrame, radius: int, blocks: int, most: int = 2048) -> DataFrame:
    """`keyed` (key of block_keys, node, value), in which each key of over `most` rows is replaced by finer ones.

    Of radius + 1 parts of the bits that a key leaves free, values within the radius agree in one: such a row gets
    radius + 1 finer keys. No other rows change, and no link is lost.
    """
    masks = F.array(*(F.array(*(F.lit(_signed(m)) for m in parts)) for _, parts in _masks(radius, blocks)))
    large = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key", F.lit(True).alias("large")))
    rows = keyed.join(small(large), "key", "left")
    finer = F.transform(masks[F.col("key.choice")], lambda m, i: F.struct((i + 1).alias("part"), F.col("value").bitwiseAND(m).alias("more")))
    rows = rows.withColumn("f", F.explode(F.when(F.col("large"), finer).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("more"))))))
    return rows.select(F.struct("key.choice", "key.bits", "f.part", "f.more").alias("key"), "node", "value")


def cells_of(keyed: DataFrame, parts: DataFrame, spread) -> DataFrame:
    """`keyed` dealt to cells: a key is one cell, or, where `parts` (key, shards) gives it several shards, each pair of
    its shards is. Adds cell and proof, two independent 64-bit hashes that name it, and left: the side of a row in a
    cell of two shards, null in others. spread: what a key's rows are dealt to shards by.
    """
    rows = keyed.join(small(parts), "key", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(*spread), F.col("shards")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rows = rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    rows = rows.withColumns({"cell": F.xxhash64("key", "x", "y"), "proof": F.xxhash64(F.lit("second"), "y", "key", "x"), "left": F.when(F.col("x") != F.col("y"), F.col("own") <= F.col("other"))})
    return rows.drop("shards", "own", "other", "x", "y", "key")


def whole_cells(batches):
    """Yields columns (numpy arrays) of whole cells, one cell at a time; rows come sorted by the first two columns."""
    held = None
    for batch in _then_none(batches):
        if batch is None:
            full, held = held, None
        else:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            full, held = [c[:last] for c in held], [c[last:] for c in held]
        if full is None or not len(full[0]):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (full[0][1:] != full[0][:-1]) | (full[1][1:] != full[1][:-1])]))
        ends = np.concatenate([starts[1:], [len(full[0])]])
        several = ends - starts > 1
        for a, b in zip(starts[several].tolist(), ends[several].tolist()):
            yield [c[a:b] for c in full]


def _side(marks: np.ndarray):
    """Which rows of a cell are of its first shard; None for a cell of one shard, False if one of two is empty."""
    if marks[0] < 0:
        return None
    left = marks == 1
    return left if 0 < left.sum() < len(left) else False


def shard_links(keyed: DataFrame, radius: int, shard: int = 2048) -> DataFrame:
    """Links (a, b) between nodes whose values, under a common key, differ in at most `radius` bits: a forest of each
    cell, that joins what all such links join.

    keyed: (key, node, value), value a number or an array of numbers. A key's rows are one shard with one tree; a key of
    more than `shard` rows is split into shards of about that size, and each pair of its shards is a cell of its own:
    the tree of one is searched by the rows of the other. So every cell is bounded however many rows share a key, and
    each gives at most as many links as it has rows, not all pairs.
    """
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > shard)
    large = cut(large.select("key", F.ceil(F.col("n") / shard).cast("int").alias("shards")))
    cells = cells_of(keyed, large, ["node"]).select("cell", "proof", F.coalesce(F.col("left").cast("tinyint"), F.lit(-1).cast("tinyint")).alias("left"), "node", "value")
    cells = cells.repartition(partitions(keyed.sparkSession), "cell").sortWithinPartitions("cell", "proof", "node")

    def run(batches):
        out = []
        for _, _, marks, node, value in whole_cells(batches):
            if (left := _side(marks)) is False:
                continue
            words = np.stack(value).view(np.uint64) if value.dtype == object else value.view(np.uint64)
            out += [(node[i], node[j]) for i, j in forest(words, radius, left)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def _then_none(items):
    yield from items
    yield None


def fingerprint_documents(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, value) for every row; value: the fingerprint as a signed 64-bit integer. No shuffle."""

    def run(batches):
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), size) for t in batch[1]], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(marks.view(np.int64))], names=["doc_id", "value"])

    return narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, value long")


def link_documents(docs: DataFrame, size: int = 3, radius: int = 3, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Fingerprints link at `radius` or fewer differing bits. Equal fingerprints become one node first. Two linked nodes
    agree in blocks - radius of the blocks, so the shards of all such choices, each with its BK-tree, lose no link.
    Blocks that very many fingerprints share are narrowed by further bits first. A fingerprint of very many documents
    is joined back by a broadcast of the few such fingerprints.

    Null or empty text, or no words: fingerprint zero, linked like any other. A null doc_id has a component only
    through others. Repeated doc_ids: each row has its own fingerprint. No rows: no rows.
    """
    marks = cut(fingerprint_documents(docs, size, id_col, text_col))
    nodes = cut(marks.groupBy("value").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    keyed = nodes.select(F.explode(block_keys(F.col("value"), radius, blocks)).alias("key"), F.col("value").alias("node"), "value")
    roots = components(shard_links(split_keys(keyed, radius, blocks), radius))
    known = roots.join(nodes.select(F.col("value").alias("node"), "least"), "node")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = known.join(smallest, "root").select(F.col("node").alias("value"), "component_id")
    named = nodes.join(linked, "value", "left").select("value", "n", F.coalesce("component_id", "least").alias("component_id"))
    result = join_hot(marks, cut(named), "value", "n", marks.count())
    return result.select("doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id")


class ShingleSets:
    """The distinct shingles of whole texts, as sorted unsigned 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size
        self.steps = np.random.Generator(np.random.PCG64(5)).integers(0, 2**64, size, dtype=np.uint64) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        h = word_hashes(text)
        if not len(h):
            return h
        n = min(self.size, len(h))
        sums = sum((h[i : len(h) - n + 1 + i] * self.steps[i] for i in range(n)), np.zeros(len(h) - n + 1, np.uint64))
        return np.unique(mix(sums))


#: Odd factors that turn one shingle hash into independent words of a wide fingerprint.
_WORDS = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def wide_fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    mixed = shingles[:, None] * _WORDS[None, :words]
    mixed ^= mixed >> np.uint64(32)
    return majority(mixed * np.uint64(0x9FB21C651E98DF25))


def verified_links(sets: list[np.ndarray], signs: np.ndarray, group: np.ndarray, similarity: float, left: np.ndarray | None = None, few: int = 64) -> list[tuple[int, int]]:
    """Links (i, j) that join, beyond `group`, exactly what all pairs of at least the similarity join.

    sets: sorted shingle hashes; signs: wide fingerprints. Pairs of `few` shingles or more whose fingerprints are far
    apart (five standard deviations beyond a pair at the similarity) aren't counted; all others are, on whole sets.
    """
    sizes, group, links = np.array([len(x) for x in sets]), group.copy(), []
    bits = signs.shape[1] * 64
    apart = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    limit = bits * apart + 5 * np.sqrt(bits * apart * (1 - apart))
    for i in range(len(sets)):
        if left is not None and not left[i]:
            continue
        rest = np.arange(i + 1, len(sets)) if left is None else np.flatnonzero(~left)
        rest = rest[group[rest] != group[i]]
        low, high = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest, low = rest[low >= similarity * high - 1e-9], low[low >= similarity * high - 1e-9]
        if not len(rest):
            continue
        far = np.bitwise_count(signs[rest] ^ signs[i]).sum(1, dtype=np.int64) > limit
        rest = rest[~far | (low < few)]
        for at in range(0, len(rest), 256):
            some = rest[at : at + 256]
            values = np.concatenate([sets[j] for j in some])
            place = np.minimum(np.searchsorted(sets[i], values), max(0, len(sets[i]) - 1))
            hit = sets[i][place] == values if len(sets[i]) else np.zeros(len(values), bool)
            both = np.add.reduceat(np.concatenate([hit, [False]]).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            both[sizes[some] == 0] = 0
            alike = both >= similarity * (sizes[some] + sizes[i] - both) - 1e-9
            for j in some[alike].tolist():
                if group[i] != group[j]:
                    links.append((i, j))
                    group[group == group[j]] = group[i]
    return links


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, bands: int = 48, radius: int = 52, short: int = 40, block: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): the groups of documents linked by a Jaccard similarity of their `size`-word shingles of at
    least `similarity`; component_id is the smallest id of the group.

    Equal shingle sets become one node. A wide SimHash gives `bands` keys of 16 bits and three words apart; nodes that
    share a key and whose words differ in at most `radius` bits are candidates, found by BK-trees. Texts of at most
    `short` shingles have a key for each shingle of their prefix instead: two that are similar share one for certain.
    Candidates' connected parts, in which all true pairs of candidates lie, then bring their whole shingle sets
    together: in blocks of about `block` shingles, first each block by itself, then pairs of blocks with different
    groups, every pair is checked and the groups so far joined. A failing pair stands for no other, and links stay as
    many as nodes. At similarity 0.8 a pair shares none of 48 keys with probability 0.03; from 0.85 on hardly any.

    Null or empty text: no shingles, all alike. Null doc_ids take no part. Rows of one doc_id with different texts are
    nodes of one document: they are linked. Ties: none. Very long texts: whole. No rows: no rows.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    base = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).filter("doc_id is not null")
    words = bands // 4 + 3

    def node_of(found: np.ndarray) -> int:
        from xxhash import xxh3_64_intdigest

        return xxh3_64_intdigest(found.tobytes()) - 2**63

    def sketch(batches):
        sets = ShingleSets(size)
        for batch in batches:
            node, signs, value, first, count = [], [], [], [], []
            for text in batch[1]:
                found = sets(text.as_py())
                wide = wide_fingerprint(found, words) if len(found) else np.zeros(words, np.uint64)
                node.append(node_of(found))
                signs.append(wide.tobytes())
                value.append(wide[-3:].view(np.int64))
                prefix = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1
                first.append(found[:prefix].view(np.int64) if 0 < len(found) <= short else None)
                count.append(len(found))
            arrays = [batch[0], pa.array(node, pa.int64()), pa.array(signs, pa.binary()), pa.array(value, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64())), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "node", "signs", "value", "first", "size"])

    marks = cut(base.mapInArrow(sketch, "doc_id long, node long, signs binary, value array<long>, first array<long>, size long"))
    nodes = cut(marks.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("signs", "value", "first", "size"))))

    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.conv(F.hex(F.substring(F.col("signs"), i * 2 + 1, F.lit(2))), 16, 10).cast("long").alias("bits")))
    prefix = F.transform("first", lambda x: F.struct(F.lit(-1).alias("band"), x.alias("bits")))
    banded = nodes.filter("size > 0").select(F.explode(band).alias("key"), "node", "value")
    exact = nodes.filter("first is not null").select(F.explode(prefix).alias("key"), "node", F.array_repeat(F.lit(0).cast("long"), 3).alias("value"))
    near = components(shard_links(banded.unionByName(exact), radius))

    held = cut(near.join(nodes.select("node", "size", "signs"), "node"))
    wide = held.groupBy(F.col("root").alias("key")).agg(F.sum("size").alias("n")).filter(F.col("n") > block)
    wide = cut(wide.select("key", F.ceil(F.col("n") / block).cast("int").alias("shards")))

    def gather(batches):
        sets = ShingleSets(size)
        for batch in batches:
            for at in range(0, len(batch), 200):
                found = [sets(t.as_py()) for t in batch[1].slice(at, 200)]
                yield pa.RecordBatch.from_arrays([pa.array(map(node_of, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "shingles"])

    # the texts of the least id of each node; they tell their nodes themselves
    wanted = cut(held.join(nodes.select("node", "least"), "node").select(F.col("least").alias("doc_id")).distinct())
    texts = base.join(small(wanted), "doc_id", "left_semi")
    sets = texts.mapInArrow(gather, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    rows = cut(held.select(F.col("root").alias("key"), "node", "signs").join(sets, "node").select("key", "node", "signs", "shingles"))

    def check(batches):
        for _, _, marks_, node, grp, signs, shingles in whole_cells(batches):
            if (left := _side(marks_)) is False:
                continue
            sign = np.stack([np.frombuffer(x, "<u8") for x in signs])
            links = verified_links([np.frombuffer(x, np.uint64) for x in shingles], sign, np.unique(grp, return_inverse=True)[1], similarity, left)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([node[k] for k in x], pa.int64()) for x in zip(*links)], names=["a", "b"])

    def checked(cells: DataFrame) -> DataFrame:
        dealt = cells.select("cell", "proof", F.coalesce(F.col("left").cast("tinyint"), F.lit(-1).cast("tinyint")).alias("left"), "node", "grp", "signs", "shingles")
        dealt = dealt.repartition(n, "cell").sortWithinPartitions("cell", "proof", "node")
        return cut(dealt.mapInArrow(check, "a long, b long"))

    own = rows.join(small(wide), "key", "left").withColumn("x", F.pmod(F.xxhash64("node"), F.coalesce("shards", F.lit(1))))
    own = own.withColumns({"cell": F.xxhash64("key", "x"), "proof": F.xxhash64(F.lit("second"), "x", "key"), "left": F.lit(None).cast("boolean"), "grp": F.col("node")})
    links = checked(own)
    if not wide.isEmpty():
        # between the blocks of a part that is larger than one: only where groups are left to join
        grouped = components(links).withColumnRenamed("root", "grp")
        rows = rows.join(small(wide.select("key")), "key", "left_semi").join(grouped, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
        open_ = cut(rows.groupBy("key").agg(F.min("grp").alias("least"), F.max("grp").alias("most")).filter("least <> most").select("key"))
        pairs = cells_of(rows.join(small(open_), "key", "left_semi"), wide, ["node"]).filter("left is not null")
        links = links.unionByName(checked(pairs))

    # rows of one id are one document
    several = marks.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a <> most").select("doc_id", "a")
    again = marks.select("doc_id", F.col("node").alias("b")).join(small(cut(several)), "doc_id").select("a", "b")
    roots = components(links.unionByName(again))
    known = nodes.select("node", "least", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(known.join(smallest, "root").select("node", "n", "component_id"))
    member = join_hot(marks.select("doc_id", "node"), named, "node", "n", marks.count())
    return member.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document, that of the smallest id, of each group of near duplicates. Rows without an id stay."""
    groups = near_duplicates(docs, size, similarity, id_col=id_col, text_col=text_col)
    gone = small(cut(groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone"))))
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
