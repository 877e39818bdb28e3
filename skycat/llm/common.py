"""Helpers shared by the training-data operators: a shared folder, lineage cuts and range groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import range_group
from ..workspace import fresh_dir, shared_dir, written

__all__ = ["cut", "cut_points", "fresh_dir", "join_hot", "narrow", "partitions", "range_group", "shared_dir", "small", "small_batches", "written"]


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by files in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of 1,000 rows at most and about 4 MB, where the session has no smaller ones: that
    bounds what both sides hold at a time.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under their working names: extra columns of the input can't clash with them."""
    small_batches(df.sparkSession)
    return df.select(*(df[name].alias(alias) for alias, name in columns.items()))


def cut_points(df: DataFrame, key: str, groups: int) -> list[int]:
    """At most `groups` - 1 ascending values of `key` that split the rows about evenly; the sketch covers all rows."""
    if groups < 2:
        return []
    at = [i / groups for i in range(1, groups)]
    return sorted({int(x) for x in df.approxQuantile(key, at, min(0.01, 0.2 / groups)) if x is not None})


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A frame to join with: `df`, already cut, with a broadcast hint if it has at most `most` (narrow) rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_hot(rows: DataFrame, table: DataFrame, key: str, count_col: str, total: int, share: int = 1000) -> DataFrame:
    """`rows` joined with `table` on `key`, without its `count_col`: how many of the `total` rows hold the key.

    Keys that hold over one row in `share` are broadcast, so their rows stay where they are; there are fewer than
    `share` of them. All others meet in a shuffle. Both frames should be cut: they are read twice.
    """
    often = F.col(count_col) > total / share
    hot = F.broadcast(table.filter(often).drop(count_col))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.filter(~often).drop(count_col), key)
    return rows.join(hot, key).unionByName(rest)
