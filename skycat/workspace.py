"""The folder that driver and executors share, and tables kept in it between the steps of a query."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new temporary folder where it is unset (tests).

    Only a local session may do without the setting: on a cluster a machine's own folder would lose data.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
        where = where.rsplit("/", 1)[0] if where else None
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-skycat-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path inside the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as Parquet files in the shared folder: computed once, with a short lineage and columns that are read apart."""
    df.write.parquet(path := fresh_dir(df.sparkSession, label))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_tasks(spark: SparkSession) -> int:
    """Into how many parts the session's shuffles deal rows; at least three."""
    return max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: What a task sorts or groups in steps that `dealt` bounds. Up to 200 tasks, here 250 million rows, Spark's shuffles are
#: written without sorting by default.
ROWS_A_TASK = 1_250_000


def dealt(rows: DataFrame, count: int, *keys: str | Column) -> DataFrame:
    """`rows` dealt by `keys` to a task for each ROWS_A_TASK of `count`, where the session's shuffles have fewer tasks.

    Joins and groups by these keys then need no other shuffle, and the memory of a task doesn't grow with the table. Of two
    sides of a join, both are dealt by the greater count.
    """
    tasks = math.ceil(count / ROWS_A_TASK)
    return rows.repartition(tasks, *keys) if tasks > shuffle_tasks(rows.sparkSession) else rows


def compile_in_parts(spark: SparkSession) -> None:
    """For steps of very long expressions: sets spark.sql.codegen.hugeMethodLimit to 8,000 where the session has more.

    The JVM interprets a method of over 8,000 bytes for ever; Spark's documentation names that limit for HotSpot. Stages
    with longer ones are then generated operator by operator, in short methods.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key, "65535")) > 8_000:
        spark.conf.set(key, "8000")
