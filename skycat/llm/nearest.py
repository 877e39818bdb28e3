"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, narrow, partitions, small


class Hashes:
    """`tables` tables of `per_table` functions floor((a.x + b) / width) over vectors scaled into the unit ball.

    A vector gets one more component, so that all have length 1 and the nearest by distance has the largest inner
    product; a query gets a zero there. Vectors are scaled by ranges of their lengths, each half as long as the one
    before, so that one long vector doesn't make all others look alike.
    """

    def __init__(self, dim: int, scale: float, tables: int, per_table: int, width: float, seed: int = 17):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.scale, self.width, self.tables, self.per_table = scale, width, tables, per_table
        self.axes = rng.standard_normal((tables, per_table, dim + 1))
        self.shift = rng.random((tables, per_table)) * width

    def _places(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        full = np.concatenate([x, last[:, None]], 1)
        return (np.einsum("nd,tkd->ntk", full, self.axes) + self.shift) / self.width

    def index(self, x: np.ndarray) -> np.ndarray:
        """(n, tables, per_table) cells."""
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        x = x / np.ldexp(self.scale, -np.floor(np.log2(np.maximum(self.scale / norm, 1))).astype(np.int64))
        return np.floor(self._places(x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1))))).astype(np.int64)

    def query(self, x: np.ndarray) -> np.ndarray:
        """Places inside cells, before rounding down; a query counts by its direction alone."""
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return self._places(x / norm, np.zeros(len(x)))


def bucket(cells: np.ndarray) -> np.ndarray:
    """One 31-bit number for the cells along the last axis."""
    mixed = np.zeros(cells.shape[:-1], dtype=np.uint64)
    for k in range(cells.shape[-1]):
        mixed = (mixed ^ cells[..., k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(33)).astype(np.int32)


def probe_sets(per_table: int, count: int) -> list[list[int]]:
    """The first `count` sets of steps in the order of their expected cost.

    Step 2i or 2i + 1 moves to the neighbour on the i-th nearest boundary's own or opposite side; cost is the expected
    squared distance to that boundary. A heap grows sets by shifting or adding the largest step; a set never moves one
    function both ways.
    """
    m = per_table
    cost = [(j * (j + 1)) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost += [1 - (2 * m + 1 - j) / (m + 1) + ((2 * m + 1 - j) * (2 * m + 2 - j)) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    heap, found = [(cost[0], (0,))], [[]]
    while heap and len(found) < count:
        total, steps = heapq.heappop(heap)
        if all(2 * m - 1 - s not in steps for s in steps):
            found.append(list(steps))
        last = steps[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*steps[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*steps, last + 1)))
    return found


def probes(places: np.ndarray, sets: list[list[int]]) -> np.ndarray:
    """(n, tables, number of sets) buckets that a query visits, in estimated success order."""
    cells = np.floor(places)
    below = places - cells
    gaps = np.concatenate([below, 1 - below], -1)
    m = cells.shape[-1]
    order = np.argsort(gaps, axis=-1, kind="stable")
    out = np.empty((*cells.shape[:-1], len(sets)), dtype=np.int32)
    for i, steps in enumerate(sets):
        moved = cells.copy()
        for s in steps:
            side = order[..., s]
            np.put_along_axis(moved, (side % m)[..., None], np.take_along_axis(moved, (side % m)[..., None], -1) + np.where(side < m, -1, 1)[..., None], -1)
        out[..., i] = bucket(moved.astype(np.int64))
    return out


def _rows(column) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(sample: np.ndarray, k: int, tables: int, per_table: int, width: float, scale: float, recall: float, most: int) -> tuple[Hashes, int, bool]:
    """The hashes, about the least number of probes that finds `recall` of the true neighbours, and whether any does.

    Measured on the sample: a part of it asks for its k nearest others in the whole sample.
    """
    hashes = Hashes(sample.shape[1], scale, tables, per_table, width)
    own = np.arange(0, len(sample), max(1, len(sample) // 200))
    asks = sample[own]
    scores = asks @ sample.T
    scores[np.arange(len(own)), own] = -np.inf
    truth = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    cells, count = bucket(hashes.index(sample)), 8
    visited = probes(hashes.query(asks), probe_sets(per_table, most))
    while True:
        count = min(count, visited.shape[-1])
        hit = [np.any([np.isin(cells[t, j], visited[i, j, :count]) for j in range(tables)], axis=0) for i, t in enumerate(truth)]
        found = np.concatenate(hit)
        reached = not len(found) or bool(np.mean(found) >= recall)
        if reached or count == visited.shape[-1]:
            return hashes, count, reached
        count = count * 3 // 2


def search(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = 4,
    per_table: int = 6,
    width: float = 1.6,
    recall: float = 0.95,
    fit_rows: int = 4000,
    most_probes: int = 2048,
    block: int = 20_000,
) -> DataFrame:
    """For each row whose id is divisible by `every`: its `k` nearest other rows by inner product.

    Returns query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller id. Every vector is indexed in
    every table; only the number of probes is fitted, on at most `fit_rows` rows. Equal vectors are one entry of the
    index with their k + 1 smallest ids, found by grouped ranks that drop the rest before the shuffle: no more can be
    among any query's nearest. Buckets are dealt to parts of about `block` entries; a query goes to a part once with
    the buckets it visits there, and each part gives its k best for it. Candidates are scored exactly. A query whose
    buckets hold fewer than k others, or than all there are, is compared with every entry, in blocks; so is every query
    where no number of probes reaches `recall` on the sample.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor
    do null ids. Fewer than k others: all found. Repeated ids: one candidate per distinct vector. No rows: no rows.
    """
    spark = vectors.sparkSession
    base = narrow(vectors, id=id_col, v=vector_col).withColumn("id", F.col("id").cast("long"))
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = base.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(~wrong & F.exists("v", lambda x: x != 0))
    dims = base.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = base.filter(F.size("v") == dims["size"]).distinct()
    longest = base.select(F.max(F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    few = base.orderBy(F.xxhash64("id"), "v").limit(fit_rows).select("v").toPandas()["v"]
    hashes, count, reached = fit(np.array(few.tolist(), dtype=np.float64), k, tables, per_table, width, longest * (1 + 1e-9), recall, most_probes)
    sets = probe_sets(per_table, count)

    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    copies = base.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    entries = cut(copies.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    parts = max(1, -(-entries.count() // block))

    def sizes(batches):
        for batch in batches:
            cells = bucket(hashes.index(_rows(batch[0])))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(cells))), pa.array(cells.ravel())], names=["t", "cell"])

    # buckets of over half a block are spread over several parts; there are at most 2 * tables * entries / block of them
    big = entries.select("v").mapInArrow(sizes, "t int, cell int").groupBy("t", "cell").count().filter(F.col("count") > block // 2).collect()
    spread = [sorted((r.cell, -(-r["count"] // (block // 2))) for r in big if r.t == t) for t in range(tables)]
    spread = [np.array(x or [(0, 1)], dtype=np.int64) for x in spread]

    def over(t: int, cells: np.ndarray) -> np.ndarray:
        """Over how many parts each bucket of the table is spread."""
        at = np.minimum(np.searchsorted(spread[t][:, 0], cells), len(spread[t]) - 1)
        return np.where(spread[t][at, 0] == cells, spread[t][at, 1], 1)

    kind = entries.schema["v"].dataType.simpleString()
    kinds = f"part long, query long, v {kind}, ids array<long>, buckets array<int>"
    names = [x.split()[0] for x in kinds.split(", ")]

    def put(batches):
        for batch in batches:
            cells = bucket(hashes.index(_rows(batch[0])))
            salt = np.array([x.as_py()[0] for x in batch[1]])
            for t in range(tables):
                at = cells[:, t].astype(np.int64)
                at += salt % over(t, at)
                part = pa.array(at % parts * tables + t, pa.int64())
                yield pa.RecordBatch.from_arrays([part, pa.nulls(len(batch), pa.int64()), batch[0], batch[1], pa.array(cells[:, t : t + 1].tolist(), pa.list_(pa.int32()))], names=names)

    def ask(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                keys, visited, out = some[0].to_pylist(), probes(hashes.query(_rows(some[1])), sets), []
                for i, key in enumerate(keys):
                    for t in range(tables):
                        buckets = np.unique(visited[i, t])
                        times = over(t, buckets)
                        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        buckets = np.repeat(buckets, times)
                        where = (buckets + nth) % parts
                        order = np.argsort(where, kind="stable")
                        for group in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                            out.append((int(where[group[0]]) * tables + t, key, i, np.unique(buckets[group])))
                part, key, row, buckets = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(key, pa.int64()), some[1].take(pa.array(row)), pa.nulls(len(out), pa.list_(pa.int64())), pa.array(buckets, pa.list_(pa.int32()))], names=names)

    def visit(index: DataFrame, asked: DataFrame) -> DataFrame:
        dealt = index.unionByName(asked).repartition(partitions(spark), "part").sortWithinPartitions("part", F.asc_nulls_first("query"))
        found = dealt.mapInArrow(partial(_visit, k=k), "query_id long, vec_id long, score double")
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    index = entries.select("v", "ids").mapInArrow(put, kinds)
    asked = base.filter(F.col("id") % every == 0).select("id", "v").mapInArrow(ask, kinds)
    queries = base.filter(F.col("id") % every == 0).select("id", "v")
    whole = F.array(F.lit(0))
    blocks = entries.select((F.pmod(F.xxhash64("v"), F.lit(parts))).cast("long").alias("part"), F.lit(None).cast("long").alias("query"), "v", "ids", whole.alias("buckets"))

    def compare(some: DataFrame) -> DataFrame:
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
        asked = some.select(part, F.col("id").alias("query"), "v", F.lit(None).cast("array<long>").alias("ids"), whole.alias("buckets"))
        return visit(blocks, asked)

    if not reached:
        return compare(queries)
    near = cut(visit(index, asked))
    most = min(k, base.select("id").distinct().count() - 1)
    full = near.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select(F.col("query_id").alias("id"))
    short = cut(queries.join(full, "id", "left_anti"))
    if short.isEmpty():
        return near
    return near.join(small(short.select(F.col("id").alias("query_id"))), "query_id", "left_anti").unionByName(compare(short))


def _visit(batches, k: int):
    """Per part: entries come first, then the queries, each with the buckets it visits; yields each query's best."""
    part, cells, vectors, ids, ready = None, [], [], [], None

    def near(v: np.ndarray, key: int, wanted: np.ndarray):
        bounds, order, x, members = ready
        a, b = np.searchsorted(bounds, wanted), np.searchsorted(bounds, wanted, side="right")
        spans = [np.arange(i, j) for i, j in zip(a.tolist(), b.tolist()) if j > i]
        if not spans:
            return []
        rows = np.concatenate(spans)
        score = x[rows] @ v
        if len(rows) > k + 1:
            rows = rows[score >= np.partition(score, -k - 1)[-k - 1] - 1e-12 * np.abs(x[rows]).max() * np.abs(v).sum()]
        exact = (x[rows] * v).sum(1)
        return sorted(((-s, m) for s, r in zip(exact.tolist(), rows.tolist()) for m in members[order[r]] if m != key))[:k]

    for batch in batches:
        out = []
        queries = ~np.asarray(batch[1].is_null().to_numpy(zero_copy_only=False), dtype=bool)
        x, parts, keys = _rows(batch[2]), batch[0].to_pylist(), batch[1].to_pylist()
        for i, (p, q) in enumerate(zip(parts, queries.tolist())):
            if p != part:
                part, cells, vectors, ids, ready = p, [], [], [], None
            if not q:
                cells.append(batch[4][i].as_py()[0])
                vectors.append(x[i])
                ids.append(batch[3][i].as_py())
                continue
            if ready is None:
                order = np.argsort(np.array(cells, dtype=np.int32), kind="stable")
                ready = (np.array(cells, dtype=np.int32)[order], order, np.array(vectors)[order] if cells else np.zeros((0, x.shape[1])), ids)
            out += [(keys[i], m, -s) for s, m in near(x[i], keys[i], batch[4][i].values.to_numpy())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])
