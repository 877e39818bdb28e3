"""Reproducible samples per class, balanced over the sky."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import magellanic_member, sky_zone
from ..functions.hashing import uniform

# Quota weights of the sky zones, the limit of both clouds together, and the sample's seed.
ZONES = (("centre", 650), ("disk", 450), ("mid", 250), ("halo", 150))
MAGELLANIC_LIMIT, SEED = 80, 42


def bucket(parallax: bool = True) -> Column:
    """magellanic, galactic, or null for rows that no sample takes."""
    l, b = F.col("l"), F.col("b")
    member = magellanic_member(l, b, F.col("parallax") if parallax else None)
    rest = F.coalesce(F.col("parallax") > 0.020, F.lit(False)) if parallax else l.isNotNull() & b.isNotNull()
    return F.when(member, "magellanic").when(rest, "galactic")


def with_rank(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """The place of each row in the order of its id's hash, within groups."""
    order = Window.partitionBy(*by).orderBy(uniform(F.col("source_id"), SEED), "source_id")
    return rows.withColumn(name, F.row_number().over(order))


def first_ranks(rows: DataFrame, name: str, limit: int, *by: str, shares: int = 64) -> DataFrame:
    """with_rank, of the rows up to `limit` alone. A group's rows are ranked in `shares` parts first, which keep `limit`
    each, so that a crowded group is sorted by many tasks and at most shares * limit of its rows meet in one.
    """
    dealt = rows.withColumn("__share", F.pmod(F.xxhash64("source_id"), F.lit(shares)))
    dealt = with_rank(dealt, name, *by, "__share").filter(F.col(name) <= limit).drop("__share", name)
    return with_rank(dealt, name, *by).filter(F.col(name) <= limit)


def cap(rows: DataFrame, limit: int, *by: str) -> DataFrame:
    """At most `limit` rows of each group, by hash."""
    return first_ranks(rows, "__rank", limit, *by).drop("__rank")


def window_sample(rows: DataFrame, column: str, size: int, windows: int = 64, order: str = "input_seq") -> DataFrame:
    """(input_seq, column): known values of up to `windows` evenly spaced runs of neighbouring rows, in all about `size`:
    the first `size` of them in the input's order. order numbers the rows from 0 without gaps.
    """
    n = rows.count()
    if n <= 0 or size <= 0:
        return rows.select(order, column).limit(0)
    each = max(1, math.ceil(size / max(windows, 1)))
    last = n - min(each, n)
    starts = [0] if n <= size else [int(last * i / (windows - 1)) if windows > 1 else 0 for i in range(max(1, windows))]
    each = n if n <= size else min(each, n)
    inside = F.lit(False)
    for s in sorted(set(starts)):
        inside = inside | F.col(order).between(s, s + each - 1)
    known = rows.filter(inside & F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    return known.select(order, column).orderBy(order).limit(size)


def stride_sample(cells: DataFrame, column: str, size: int, total: int, index: str = "cell", ignore_zeros: bool = True, least: int = 1000) -> DataFrame:
    """(cell, column): known values of every step-th cell, about `size` of `total`; if hardly any are found there, of
    all cells in order instead.
    """
    step = max(1, total // max(size, 1))
    known = F.col(column).isNotNull() & ((F.col(column) != 0) if ignore_zeros else F.lit(True))
    good = cells.filter(known).select(index, column)
    some = good.filter(F.pmod(F.col(index), F.lit(step)) == 0)
    enough = step == 1 or some.limit(min(least, size)).count() >= min(least, size)
    return (some if enough else good).orderBy(index).limit(size)


def quotas(limit: int) -> list[int]:
    total = sum(w for _, w in ZONES)
    parts = [w * limit // total for _, w in ZONES]
    parts[0] += limit - sum(parts)
    return parts


def sky_balanced(rows: DataFrame, limit: int, group: str = "cls") -> DataFrame:
    """At most `limit` rows of each group: zones filled to their quotas in order, then from whatever is left.

    A zone's leftover can be taken by the next zone whose mask holds it, as for centre rows in the disk. The groups are
    those of `group`; ranks within them are windows.
    """
    zone = sky_zone(F.col("l"), F.col("b"))
    if limit <= 0:
        return rows.limit(0).withColumn("zone", zone)
    c, d, m, h = quotas(limit)
    rows = rows.withColumn("zone", zone)
    # the quotas need only the first rows of each zone, and the fill at most `limit` of each
    rows = first_ranks(rows, "r0", limit + c, group, "zone")
    taken = F.col("r0") <= c
    rows = rows.withColumn("take", F.when((F.col("zone") == "centre") & taken, 0))
    rows = rows.withColumn("in_disk", F.col("take").isNull() & (F.abs("b") <= 15.0))
    rows = with_rank(rows, "r1", group, "in_disk").withColumn("take", F.when(F.col("in_disk") & (F.col("r1") <= d), 1).otherwise(F.col("take")))
    rows = rows.withColumn("late", F.when(F.col("take").isNull() & (F.abs("b") > 15.0), F.when(F.abs("b") <= 45.0, "mid").otherwise("halo")))
    rows = with_rank(rows, "r2", group, "late")
    rows = rows.withColumn("take", F.when((F.col("late") == "mid") & (F.col("r2") <= m), 2).when((F.col("late") == "halo") & (F.col("r2") <= h), 3).otherwise(F.col("take")))
    rows = rows.withColumn("left", F.col("take").isNull())
    rows = with_rank(rows, "r3", group, "left").withColumn("got", F.count("take").over(Window.partitionBy(group)))
    kept = rows.filter(F.col("take").isNotNull() | (F.col("r3") <= limit - F.col("got")))
    return kept.drop("r0", "r1", "r2", "r3", "take", "in_disk", "late", "left", "got")


def class_sample(rows: DataFrame, limit: int, group: str = "cls", parallax: bool = True) -> DataFrame:
    """The sample of each class: `limit` Magellanic rows, and a sky-balanced `limit` of the others."""
    marked = rows.withColumn("bucket", bucket(parallax))
    clouds = cap(marked.filter("bucket = 'magellanic'"), limit, group).withColumn("zone", sky_zone(F.col("l"), F.col("b")))
    return clouds.unionByName(sky_balanced(marked.filter("bucket = 'galactic'"), limit, group))


def magellanic_cap(rows: DataFrame, limit: int = MAGELLANIC_LIMIT) -> DataFrame:
    """All rows, but at most `limit` Magellanic ones over all classes."""
    clouds = rows.filter("bucket = 'magellanic'").orderBy(uniform(F.col("source_id"), SEED), "source_id").limit(limit)
    return rows.filter("bucket <> 'magellanic'").unionByName(clouds)
