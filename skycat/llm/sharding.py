"""Shards by jump consistent hashing: a key and the number of shards tell the shard, without a table of ring places."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_row_number
from .common import narrow, partitions

# Fixed value: the multiplier of the generator that the method jumps by.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. A key's jumps are those of any smaller number of shards and, at times, one more into
    the newest shards, so that a further shard only takes rows into itself. About ln(shards) steps a key.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    state, at, out = keys.astype(np.uint64), np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(at):
        state = state * MULTIPLIER + np.uint64(1)
        place = ((out[at] + 1).astype(np.float64) * (2147483648.0 / ((state >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        inside = place < shards
        at, state = at[inside], state[inside]
        out[at] = place[inside]
    return out


def shard_of(shards: int, *keys: str) -> Column:
    """The shard of a row by the columns `keys`; null keys are a key like others."""

    @F.pandas_udf("int")
    def run(key: pd.Series) -> pd.Series:
        return pd.Series(jump(key.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return run(F.xxhash64(*keys))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes of the text, and 8), text_crc32 (unsigned), law ('key'), shard, slot (from
    0 without gaps in each shard, by ascending doc_id) and grown_shard (its shard with one more shard).

    Null text: no bytes, size 8, crc 0. A null doc_id is a key of its own and comes first; rows of one doc_id share its
    shard. Slots are counted over sorted chunks, so that a shard, one id or one row repeated any number of times is no
    single task; equal rows get slots in an order of their own. No other column is read. No rows: no rows.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = rows.select("doc_id", size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    rows = rows.select("*", F.lit("key").alias("law"), shard_of(shards, "doc_id").alias("shard"), shard_of(shards + 1, "doc_id").alias("grown_shard"))
    placed = with_row_number(rows, "slot", ["doc_id", "text_crc32", "size"], 0, ["shard"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, folder: str, shards: int = 24, key_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Writes all rows and columns as Parquet files in `folder`/shard=0 and so on, by the key's shard.

    Each shard is dealt to its share of the tasks without regard to keys, so none has more than about
    1 / shuffle partitions of the rows unless shards outnumber those. A column named shard must not exist already.
    """
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("the rows have a column named shard")
    each = max(1, -(-partitions(docs.sparkSession) // shards))
    dealt = docs.withColumn("shard", shard_of(shards, key_col)).withColumn("__deal", F.pmod(F.monotonically_increasing_id(), F.lit(each)))
    dealt = dealt.repartition(each * shards, "shard", "__deal").sortWithinPartitions("shard").drop("__deal")
    dealt.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(folder)
