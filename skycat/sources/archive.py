"""Resumable pulls of a database table: a task reads one range of a column, and a finished range is a file that stays."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from importlib import import_module

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .tables import ranges

_FILE = re.compile(r"range-(\d+)\.parquet")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))


def finished(path: str) -> set[int]:
    """The ranges whose files are there."""
    from pyarrow import fs

    store, name = _store(path)
    found = store.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return {int(m[1]) for f in found if (m := _FILE.fullmatch(f.base_name))}


def _connection(options: dict):
    """A DB-API connection: by the function that option connect (module:function) names, else of a SQLite file."""
    module, _, function = options.get("connect", "sqlite3:connect").partition(":")
    return getattr(import_module(module), function)(options["database"])


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, number: int, low: int, high: int):
        self.number, self.low, self.high = number, low, high


class RangeReader(DataSourceReader):
    """One partition for each range that is still to be read; each asks for its rows alone, in order, up to the cap."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.shape = dict(options), schema

    def partitions(self) -> list[InputPartition]:
        bounds = ranges(int(self.options["total"]), int(self.options["count"]))
        return [_Range(i, *bounds[i]) for i in map(int, self.options["todo"].split(","))]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.shape if f.name != "range_id"]
        key, cap = _quoted(self.options["column"]), self.options.get("cap")
        asked = f"select {', '.join(map(_quoted, names))} from {_quoted(self.options['table'])} where {key} >= ? and {key} < ? order by {key}" + (f" limit {int(cap)}" if cap else "")
        kinds, connection = to_arrow_schema(self.shape), _connection(self.options)
        try:
            cursor = connection.cursor()
            cursor.execute(asked, (partition.low, partition.high))
            while rows := cursor.fetchmany(50_000):
                columns = dict(zip(names, zip(*rows)))
                yield pa.RecordBatch.from_arrays([pa.array([partition.number] * len(rows) if f.name == "range_id" else columns[f.name], f.type) for f in kinds], schema=kinds)
        finally:
            connection.close()


class RangeSource(DataSource):
    """spark.read.format("ranges") with a schema, which may have range_id. Options: database, table, column, total, count,
    todo (numbers of ranges), cap (rows of a range), connect.
    """

    @classmethod
    def name(cls) -> str:
        return "ranges"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(self.options, schema)


class Finished(WriterCommitMessage):
    def __init__(self, number: int, rows: int):
        self.number, self.rows = number, rows


class RangeWriter(DataSourceArrowWriter):
    """A task's rows are a range's: they are written under another name and renamed when the range is whole."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.todo, self.shape = options["path"], [int(i) for i in options["todo"].split(",")], to_arrow_schema(schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        number, rows = self.todo[TaskContext.get().partitionId()], 0
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        aside = f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as out, pq.ParquetWriter(out, self.shape) as file:
            for batch in iterator:
                file.write_batch(batch.cast(self.shape) if batch.schema != self.shape else batch)
                rows += len(batch)
        store.move(aside, f"{folder}/range-{number:06d}.parquet")
        return Finished(number, rows)

    def commit(self, messages: list) -> None:
        """Each range has committed itself."""

    def abort(self, messages: list) -> None:
        """What is finished stays, for the next run."""


class RangeSink(DataSource):
    """df.write.format("range_files").mode("append"): a file for each partition. Options: path, todo."""

    @classmethod
    def name(cls) -> str:
        return "range_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RangeWriter(self.options, schema)


def pull(spark: SparkSession, path: str, schema: str, database: str, table: str, column: str, total: int, count: int, cap: int | None = None, connect: str | None = None) -> list[int]:
    """Reads the ranges of `column` that `path` lacks, one task each, and returns their numbers.

    A run that fails keeps the ranges that it finished, also those of tasks that ran beside the failing one; the next one
    asks the database for the others only. cap: rows of a range at most, the first in order (a limit of the archive).
    """
    todo = sorted(set(range(count)) - finished(path))
    if not todo:
        return []
    for source in (RangeSource, RangeSink):
        spark.dataSource.register(source)
    numbers = ",".join(map(str, todo))
    options = {"database": database, "table": table, "column": column, "total": total, "count": count, "todo": numbers} | ({"cap": cap} if cap else {}) | ({"connect": connect} if connect else {})
    rows = spark.read.format("ranges").schema(f"{schema}, range_id int").options(**options).load()
    rows.write.format("range_files").mode("append").options(path=path, todo=numbers).save()
    return todo


def pulled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the finished ranges."""
    return spark.read.schema(f"{schema}, range_id int").parquet(f"{path}/range-*.parquet")


def pull_or_keep(spark: SparkSession, *args, wait: Callable[[int], None] = lambda tries: None, tries: int = 5, **kwargs) -> int:
    """`pull` until all ranges are there, at most `tries` times, waiting in between; returns how often it ran."""
    for done in range(1, tries + 1):
        try:
            pull(spark, *args, **kwargs)
            return done
        except Exception:
            if done == tries:
                raise
            wait(done)
    return tries
