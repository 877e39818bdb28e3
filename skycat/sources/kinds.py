"""What a catalogue file is, by its first bytes, and one reader for all kinds; typed headers of commented tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import fits
from .versions import _files

# Names that a user may give a kind, and the datatypes of a commented header with Spark's.
ALIASES = {"fits": "fits_image", "wcs": "fits_image", "fits_wcs": "fits_image", "healpix_fits": "healpix", "table": "catalog", "fits_catalog": "catalog", "csv_catalog": "catalog", "npy": "equirectangular", "npz": "equirectangular", "image": "equirectangular_image", "raster": "equirectangular_image"}
DATATYPES = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double", "float128": "double", "string": "string"}
#: First bytes of images and arrays.
MAGIC = {b"\x89PNG": "equirectangular_image", b"\xff\xd8\xff": "equirectangular_image", b"II*\0": "equirectangular_image", b"MM\0*": "equirectangular_image", b"\x93NUMPY": "equirectangular", b"PK\x03\x04": "equirectangular"}


def _first_file(spark: SparkSession, path: str) -> str:
    """A file, or the first one of a folder or pattern."""
    at, fs = _files(spark, path)
    found = list(fs.globStatus(at) or [])
    while found and found[0].isDirectory():
        inside = sorted(fs.listStatus(found[0].getPath()), key=lambda s: s.getPath().getName())
        found = [s for s in inside if s.getPath().getName()[0] not in "._"]
    if not found:
        raise FileNotFoundError(path)
    return found[0].getPath().toString()


def _lines(spark: SparkSession, path: str, mark: str, most: int = 100_000) -> list[str]:
    """The lines at the start of a file that begin with a mark, and the one after them; packed files are unpacked."""
    jvm, (at, fs) = spark.sparkContext._jvm, _files(spark, _first_file(spark, path))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    stream = fs.open(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    out: list[str] = []
    try:
        while len(out) < most and (line := reader.readLine()) is not None:
            out.append(line)
            if not line.startswith(mark):
                break
    finally:
        reader.close()
    return out


@dataclass(frozen=True)
class TypedColumn:
    name: str
    datatype: str
    unit: str | None = None


def typed_header(lines: list[str]) -> tuple[str, list[TypedColumn]]:
    """(delimiter, columns) of a commented header: the items of its datatype list, on one line or on several.

    A type that is none of DATATYPES, or has a subtype, is read as text.
    """
    text = "\n".join(line[1:] for line in lines if line.startswith("#"))
    value = lambda key, item: (m := re.search(rf"(?:^|[\s{{,]){key}:\s*('[^']*'|\"[^\"]*\"|[^,}}\n]+)", item)) and m[1].strip().strip("'\"")
    body = re.search(r"^\s*datatype:\s*\n((?:\s*-.*\n?|\s{3,}.*\n?)*)", text, re.MULTILINE)
    items = re.split(r"^\s*-\s", body[1], flags=re.MULTILINE)[1:] if body else []
    columns = []
    for item in items:
        kind = value("datatype", item) or "string"
        columns.append(TypedColumn(value("name", item) or "", "string" if value("subtype", item) else DATATYPES.get(kind, "string"), value("unit", item)))
    mark = re.search(r"^\s*delimiter:\s*('[^']*'|\"[^\"]*\"|\S+)", text, re.MULTILINE)
    return (mark[1].strip("'\"") if mark else " "), columns


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """A table with a commented header, or a folder of such files with one header: its columns have the header's types and
    units (metadata). Fields that don't fit their type, and empty ones, are null. Without a list of types: all text.
    """
    sep, columns = typed_header(_lines(spark, path, "#"))
    reader = spark.read.option("comment", "#").option("header", True).option("sep", sep)
    if not columns:
        return reader.csv(path)
    schema = ", ".join(f"`{c.name}` {c.datatype}" for c in columns)
    rows = reader.schema(schema).option("nanValue", "nan").option("positiveInf", "inf").option("negativeInf", "-inf").csv(path)
    return rows.select(*(rows[f"`{c.name}`"].alias(c.name, metadata={"unit": c.unit}) if c.unit else rows[f"`{c.name}`"] for c in columns))


def _first_bytes(spark: SparkSession, path: str, count: int = 8192) -> bytes:
    import zlib

    at, fs = _files(spark, _first_file(spark, path))
    stream = fs.open(at)
    try:
        data = bytes(stream.readNBytes(count))
    finally:
        stream.close()
    return zlib.decompressobj(31).decompress(data) if data[:2] == b"\x1f\x8b" else data


def detect(spark: SparkSession, path: str, requested: str = "auto") -> tuple[str, str]:
    """(kind, format) of a file: catalog, healpix, fits_image, equirectangular or equirectangular_image, as requested or by
    what stands in it, whatever its name is. format: parquet, fits, ecsv, csv, tsv, json or image.
    """
    kind = ALIASES.get(requested.strip().lower(), requested.strip().lower())
    data = _first_bytes(spark, path)
    found = next((k for magic, k in MAGIC.items() if data.startswith(magic)), None)
    if data.startswith(b"PAR1"):
        guess = "catalog", "parquet"
    elif data.startswith(b"SIMPLE  ="):
        guess = fits.kind(_first_file(spark, path)), "fits"
    elif found:
        guess = found, "image"
    elif data.startswith(b"# %ECSV"):
        guess = "catalog", "ecsv"
    else:
        first = data.decode("utf-8", "replace").lstrip("﻿").split("\n")[0].strip("\r")
        if not first or "\0" in first or "�" in first:
            raise ValueError(f"unknown kind of file: {path}")
        guess = "catalog", "json" if first[0] in "{[" else "tsv" if "\t" in first else "csv"
    return (guess[0] if kind == "auto" else kind), guess[1]


def read_catalogue(spark: SparkSession, path: str, requested: str = "auto") -> DataFrame:
    """The rows of a catalogue of any of the table formats; delimited text has columns of text."""
    kind, form = detect(spark, path, requested)
    if kind not in ("catalog", "healpix") or form == "image":
        raise ValueError(f"{path} is no table but {kind}")
    if form == "fits":
        return fits.load(spark, path)
    if form == "ecsv":
        return read_typed(spark, path)
    if form in ("csv", "tsv"):
        rows = spark.read.option("header", True).option("sep", "\t" if form == "tsv" else ",").csv(path)
        return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    return spark.read.format(form).load(path)

