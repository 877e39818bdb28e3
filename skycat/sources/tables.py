"""Reading catalogues: delimited text, ECSV, HEALPix tables, rasters, star lists, and ranges of a database."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords
from ..operators.ordering import first_rows
from ..schema import POINT_ALIASES, clean, find_column, require, resolve_columns

#: HEALPix values at or below the first, or near the second, stand for a missing one.
BAD_LIMIT, BAD_DATA = -1e29, -1.6375e30


def scan(spark: SparkSession, path: str, columns: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """The named columns of a Parquet catalogue, names in any case; an error lists required ones that are absent.

    Only these columns are read.
    """
    df = require(spark.read.parquet(path), required)
    found = {c: find_column(df, [c]) for c in columns}
    return clean(df.select(*(F.col(f"`{f}`").alias(c) for c, f in found.items() if f)))


def read_delimited(spark: SparkSession, path: str, longitude: Sequence[str], latitude: Sequence[str], value: Sequence[str] = (), sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """(longitude, latitude, value) of a CSV or TSV file; a row with any text that isn't a number loses all three."""
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    wanted = {"longitude": longitude, "latitude": latitude} | ({"value": value} if value else {})
    rows = resolve_columns(raw, wanted)
    numbers = {c: F.trim(F.col(c)).try_cast("double") for c in wanted}
    whole = None
    for n in numbers.values():
        whole = n.isNotNull() if whole is None else whole & n.isNotNull()
    return rows.select(*(F.when(whole, n).alias(c) for c, n in numbers.items()), *([] if value else [F.when(whole, 1.0).alias("value")]))


def read_ecsv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a commented header, columns typed as that says, else as text; see kinds.read_typed."""
    from .kinds import read_typed

    return read_typed(spark, path)


def healpix_values(rows: DataFrame, value: str, pixel: str | None = None, position: str | None = None, width: int = 1, nside: int | None = None) -> DataFrame:
    """(pix, value) of a HEALPix table.

    With `pixel` the table names its pixels; those outside the sphere go. Otherwise `position` numbers the rows from 0
    and each holds `width` values (an array if over 1). Sentinels become null.
    """
    if pixel:
        out = rows.select(F.col(pixel).cast("long").alias("pix"), F.col(value).cast("double").alias("value"))
    elif width > 1:
        out = rows.select(F.col(position).alias("p"), F.posexplode(value).alias("i", "v")).select((F.col("p") * width + F.col("i")).cast("long").alias("pix"), F.col("v").cast("double").alias("value"))
    else:
        out = rows.select(F.col(position).cast("long").alias("pix"), F.col(value).cast("double").alias("value"))
    if nside:
        out = out.filter(F.col("pix").between(0, 12 * nside * nside - 1))
    good = (F.col("value") > BAD_LIMIT) & ~F.isnan("value")
    return out.select("pix", F.when(good, F.col("value")).alias("value"))


def nside_of(pixels: int) -> int:
    """The resolution of a full HEALPix table of so many pixels."""
    nside = round((pixels / 12) ** 0.5)
    if nside < 1 or 12 * nside * nside != pixels:
        raise ValueError(f"{pixels} pixels are no HEALPix map")
    return nside


def luminance(red: Column, green: Column, blue: Column) -> Column:
    """Rec. 709 luminance of linear channels."""
    return 0.2126 * red + 0.7152 * green + 0.0722 * blue


def raster_cells(rows: DataFrame, width: int, height: int, channel: str = "luminance", longitudes: tuple[float, float] = (-180.0, 180.0), order: str = "north_to_south") -> DataFrame:
    """(ix, iy, l, b, value) of an equirectangular raster (ix, iy, and value or red, green, blue).

    channel: red, green, blue, or Rec. 709 luminance; ignored for a raster of values. l and b are a cell's centre; order
    says whether row 0 is the northernmost or the southernmost.
    """
    if "value" in rows.columns:
        value = F.col("value")
    elif channel in ("red", "green", "blue"):
        value = F.col(channel)
    elif channel == "luminance":
        value = luminance(F.col("red"), F.col("green"), F.col("blue"))
    else:
        raise ValueError(f"unknown channel: {channel}")
    if order not in ("north_to_south", "south_to_north"):
        raise ValueError(f"unknown order of rows: {order}")
    first, last = longitudes
    l = F.pmod(first + (F.col("ix") + 0.5) * ((last - first) / width), F.lit(360.0))
    up = (F.col("iy") + 0.5) * (180.0 / height)
    b = 90.0 - up if order == "north_to_south" else up - 90.0
    return rows.select("ix", "iy", l.alias("l"), b.alias("b"), value.cast("double").alias("value"))


def star_list(rows: DataFrame) -> DataFrame:
    """(l, b, magnitude, temperature_k) of a user's stars; the last two have defaults, in rows and as columns."""
    out = resolve_columns(rows, {"l": ("l", "glon", "longitude"), "b": ("b", "glat", "latitude"), "magnitude": ("magnitude", "mag", "g_mag"), "temperature_k": ("temperature_k", "teff", "temperature")}, {"magnitude": None, "temperature_k": None})
    return out.select(F.col("l").cast("double").alias("l"), F.col("b").cast("double").alias("b"), F.coalesce(F.col("magnitude").cast("double"), F.lit(12.0)).alias("magnitude"), F.coalesce(F.col("temperature_k").cast("double"), F.lit(5800.0)).alias("temperature_k"))


def ranges(total: int, count: int) -> list[tuple[int, int]]:
    """`count` equal ranges of [0, total); the last takes the remainder."""
    step = total // count
    return [(i * step, total if i == count - 1 else (i + 1) * step) for i in range(count)]


def pull_ranges(spark: SparkSession, url: str, table: str, column: str, total: int, count: int, properties: dict | None = None) -> DataFrame:
    """A database table read in ranges of a column, one task each."""
    return spark.read.jdbc(url, table, column=column, lowerBound=0, upperBound=total, numPartitions=count, properties=properties or {})


def pull_missing(rows: DataFrame, bounds: Sequence[tuple[int, int]], done: DataFrame | None, column: str = "random_index", most: int | None = None) -> DataFrame:
    """The rows of the ranges that `done` (range_id) lacks, with range_id; at most `most` of each range, the first by
    `column` (a cap is a feature of the pull). The wanted ranges are one filter, which reaches the scan; the rows of a
    range over its cap are chosen by counted intervals.
    """
    todo = unfinished(range(len(bounds)), done)
    if not todo:
        return rows.limit(0).withColumn("range_id", F.lit(0))
    inside = {i: (F.col(column) >= bounds[i][0]) & (F.col(column) < bounds[i][1]) for i in todo}
    wanted, number = inside[todo[0]], F.when(inside[todo[0]], F.lit(todo[0]))
    for i in todo[1:]:
        wanted, number = wanted | inside[i], number.when(inside[i], F.lit(i))
    found = rows.filter(wanted).withColumn("range_id", number)
    return found if most is None else first_rows(found, most, [column], ["range_id"])


def unfinished(every: Iterable[int], done: DataFrame | None, column: str = "range_id") -> list[int]:
    """The ranges that a resumable pull still has to read; both lists are as short as the number of ranges."""
    finished = set() if done is None else {r[0] for r in done.select(column).distinct().collect()}
    return [r for r in every if r not in finished]


def kind_of(path: str) -> str:
    """What a file is, by its ending."""
    name = path.lower().rstrip("/").removesuffix(".gz")
    for kind, ends in {"parquet": (".parquet",), "delimited": (".csv", ".tsv", ".txt"), "ecsv": (".ecsv",), "json": (".json", ".jsonl"), "fits": (".fits", ".fit", ".fts")}.items():
        if name.endswith(ends):
            return kind
    raise ValueError(f"unknown kind of file: {path}")


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row that depends on the content but not on its order: count, xor and sum of row hashes."""
    h = F.xxhash64(*rows.columns)
    return rows.agg(F.count("*").alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in rows.columns)}))").alias("xor"), F.sum(F.shiftrightunsigned(h, 33)).alias("sum"))


def galactic_positions(df: DataFrame, header: dict[str, str] | None = None, fallback: str = "galactic") -> DataFrame:
    """`df` with galactic l and b in place of its positions, in whatever frame its header or its columns' names tell of.

    Null positions stay null. A frame that isn't known is a ValueError, a missing column a KeyError.
    """
    frame = coords.guess_frame(header, df.columns, fallback)
    lon, lat = (find_column(df, (*POINT_ALIASES[axis], *more)) for axis, more in (("longitude", ("elon", "ecl_lon")), ("latitude", ("elat", "ecl_lat"))))
    if lon is None or lat is None:
        raise KeyError("no columns of positions")
    l, b = coords.to_galactic(F.col(f"`{lon}`"), F.col(f"`{lat}`"), frame)
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in (lon, lat)), l.alias("l"), b.alias("b"))
