"""Connected components of a graph of links, as joins and grouped minima."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _join_all(batches):
    """(node, root) of all links of one task, by joining sets."""
    pairs = [np.stack([b[0].to_numpy(), b[1].to_numpy()], 1) for b in batches]
    if not pairs:
        return
    pairs = np.concatenate(pairs)
    nodes, at = np.unique(pairs, return_inverse=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in at.reshape(-1, 2).tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    roots = nodes[[find(x) for x in range(len(nodes))]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(links: DataFrame, most: int = 60, few: int = 500_000) -> DataFrame:
    """(node, root): for every node of the links (a, b), the smallest node of its component.

    Links are counted first: up to `few`, 16 bytes each, are joined by one task, which spares their many small shuffles.
    More are joined in rounds: large-star and small-star steps until the links no longer change. Each step groups by node with partial
    minima and joins, so a node of very many links is no single task; every step's links are written to the shared
    folder. No links: no rows. Repeated links, loops and nulls don't matter.
    """
    links = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = cut(links), None
    if links.count() <= few:
        return cut(links.coalesce(1).mapInArrow(_join_all, "node long, root long"))
    for _ in range(most):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = cut(small.distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("links did not settle")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
