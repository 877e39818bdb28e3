"""Incremental catalogues: chunk files are taken up once, and a histogram grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.coords import allsky_cell
from ..functions.photometry import flux, temperature
from ..sources import versions


def chunks(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet chunks that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_new(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends chunks that `target` doesn't have yet, then ends; a restart goes on where the last run stopped."""
    valid = stream.filter("l is not null and b between -90 and 90 and phot_g_mean_mag is not null")
    return valid.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns of a histogram that add up.
SUMS = ("flux", "temp_flux", "n")


def add_up(cells: DataFrame) -> DataFrame:
    """One row for each cell of a histogram in parts."""
    return cells.groupBy("x", "y").agg(*(F.sum(c).alias(c) for c in SUMS))


def histogram_parts(rows: DataFrame, width: int, height: int) -> DataFrame:
    """(x, y, flux, temp_flux, n) of some rows."""
    x, y = allsky_cell(F.col("l"), F.col("b"), width, height)
    valid = rows.filter("phot_g_mean_mag is not null").select(x.alias("x"), y.alias("y"), flux(F.col("phot_g_mean_mag")).alias("w"), temperature(F.col("teff_gspphot"), F.col("bp_rp")).alias("t"))
    return valid.filter("x is not null").groupBy("x", "y").agg(F.sum("w").alias("flux"), F.sum(F.col("w") * F.col("t")).alias("temp_flux"), F.count("*").alias("n"))


def histogram_stream(stream: DataFrame, width: int, height: int) -> DataFrame:
    """histogram_parts of all rows so far; the state is one row a cell."""
    return histogram_parts(stream, width, height)


def write_histogram(cells: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Replaces `target` with the whole histogram after each batch; keep_histogram writes the batch's cells alone."""

    def put(batch: DataFrame, number: int) -> None:
        versions.replace(batch, target)

    return cells.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_histogram(stream: DataFrame, width: int, height: int, target: str, checkpoint: str, most: int = 16) -> StreamingQuery:
    """Adds the histogram of each batch to a versioned table, which read_histogram adds up.

    A batch writes its own cells only, whatever the table holds, and keeps no state. Its version carries the batch's
    number: one that is run again after a failure is published once. After `most` parts they are merged into one; old
    versions stay until vacuum.
    """

    def put(batch: DataFrame, number: int) -> None:
        versions.publish(histogram_parts(batch, width, height), target, "append", mark=number)
        versions.compact(batch.sparkSession, target, add_up, most)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_histogram(spark: SparkSession, target: str) -> DataFrame:
    """The histogram of all batches that are published."""
    return add_up(versions.read(spark, target))
