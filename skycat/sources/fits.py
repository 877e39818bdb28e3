"""FITS binary tables as a Spark data source: row ranges of files are read in parallel, filters are applied while reading,
and each task writes files of its own.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_CARD, _BLOCK = 80, 2880
# Column codes of the format with their NumPy and Spark types.
_CODES = {"L": ("S1", "boolean"), "B": ("u1", "int"), "I": (">i2", "int"), "J": (">i4", "int"), "K": (">i8", "long"), "E": (">f4", "double"), "D": (">f8", "double"), "A": ("S", "string")}


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _open(path: str):
    store, name = _store(path)
    return store.open_input_file(name)


def _paths(path: str) -> list[str]:
    """A file, or the files of a folder that don't start with a point or an underscore."""
    from pyarrow import fs

    store, name = _store(path)
    if store.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    return [path.rstrip("/") + "/" + f.base_name for f in sorted(store.get_file_info(fs.FileSelector(name)), key=lambda f: f.path) if f.is_file and f.base_name[0] not in "._"]


def _header(file, at: int) -> tuple[dict[str, str], int]:
    """(cards, offset after them) of the header that starts at a byte."""
    cards: dict[str, str] = {}
    file.seek(at)
    while True:
        block = file.read(_BLOCK).decode("ascii", "replace")
        if len(block) < _BLOCK:
            raise EOFError("no table")
        at += _BLOCK
        for i in range(0, _BLOCK, _CARD):
            card = block[i : i + _CARD]
            if card.startswith("END "):
                return cards, at
            if card[8:10] == "= ":
                value = card[10:]
                text = re.match(r"\s*'((?:[^']|'')*)'", value)
                cards[card[:8].strip()] = text[1].rstrip() if text else value.split("/")[0].strip()


def headers(path: str) -> Iterator[tuple[dict[str, str], int]]:
    """(cards, offset of the data) of each part of a file."""
    with _open(path) as file:
        at = 0
        while True:
            try:
                cards, data = _header(file, at)
            except EOFError:
                return
            yield cards, data
            axes = [int(cards[f"NAXIS{i}"]) for i in range(1, int(cards.get("NAXIS", 0)) + 1)]
            size = abs(int(cards.get("BITPIX", 8))) // 8 * (math.prod(axes) + int(cards.get("PCOUNT", 0))) if axes else 0
            at = data + -(-size // _BLOCK) * _BLOCK


def _table(path: str) -> tuple[dict[str, str], int]:
    """The first binary table's header and the offset of its rows."""
    for cards, data in headers(path):
        if cards.get("XTENSION") == "BINTABLE":
            return cards, data
    raise EOFError("no table")


def kind(path: str) -> str:
    """healpix if a table says so, else fits_image if any part has an image, else catalog if there is a table."""
    parts = [cards for cards, _ in headers(path)]
    tables = [c for c in parts if c.get("XTENSION") in ("BINTABLE", "TABLE")]
    if any(c.get("PIXTYPE", "").upper() == "HEALPIX" or "NSIDE" in c or "ORDERING" in c for c in tables):
        return "healpix"
    if any(c not in tables and int(c.get("NAXIS", 0)) for c in parts):
        return "fits_image"
    if tables:
        return "catalog"
    raise ValueError(f"no data in {path}")


class _Column:
    """One column: its name, its place in the row type, Spark's type, how often it is repeated, scale, zero and null."""

    def __init__(self, cards: dict[str, str], i: int):
        form = re.match(r"(\d*)([A-Z])", cards[f"TFORM{i}"])
        self.repeat, self.code, self.name, self.field = int(form[1] or 1), form[2], cards.get(f"TTYPE{i}", f"col{i}"), f"f{i}"
        if self.code not in _CODES:
            raise ValueError(f"column {self.name}: code {self.code} is not supported")
        self.raw, kind = _CODES[self.code]
        self.scale, self.zero = float(cards.get(f"TSCAL{i}", 1)), float(cards.get(f"TZERO{i}", 0))
        self.null = int(cards[f"TNULL{i}"]) if f"TNULL{i}" in cards and self.code in "BIJK" else None
        self.shift = self.scale == 1 and self.zero == int(self.zero)
        if self.code in "BIJKED" and not (self.scale == 1 and self.zero == 0):
            # whole offsets make unsigned integers, other scales fractions
            kind = "long" if self.code in "BIJ" and self.shift else "decimal(20,0)" if self.code == "K" and self.shift else "double"
        self.kind = kind
        self.spark = kind if self.code == "A" or self.repeat == 1 else f"array<{kind}>"

    @property
    def dtype(self) -> tuple:
        return (self.field, f"S{self.repeat}") if self.code == "A" else (self.field, self.raw, (self.repeat,)) if self.repeat != 1 else (self.field, self.raw)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Numbers as they are meant; nulls aren't taken out."""
        if self.kind == "decimal(20,0)":
            return x.astype(object) + int(self.zero)
        if self.code in "BIJK" and self.shift:
            return x.astype(np.int64) + int(self.zero)
        return x.astype(np.float64) * self.scale + self.zero

    def array(self, block: np.ndarray) -> pa.Array:
        x = block[self.field]
        if self.code == "A":
            return pa.array([v.decode("ascii", "replace").rstrip("\0 ") for v in x.tolist()], pa.string())
        if self.code == "L":
            flags = [{b"T": True, b"F": False}.get(v) for v in x.ravel().tolist()]
            return pa.array(flags, pa.bool_()) if x.ndim == 1 else pa.FixedSizeListArray.from_arrays(pa.array(flags, pa.bool_()), self.repeat).cast(pa.list_(pa.bool_()))
        kind = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0)}[self.kind]
        gone = None if self.null is None else (x == self.null).ravel()
        flat = self.values(x).ravel()
        flat = pa.array(flat.tolist(), kind, mask=gone) if self.kind == "decimal(20,0)" else pa.array(flat, mask=gone).cast(kind)
        return flat if x.ndim == 1 else pa.FixedSizeListArray.from_arrays(flat, self.repeat).cast(pa.list_(kind))


def _columns(cards: dict[str, str]) -> tuple[np.dtype, list[_Column]]:
    """The packed row type and the columns."""
    found = [_Column(cards, i) for i in range(1, int(cards["TFIELDS"]) + 1)]
    return np.dtype([c.dtype for c in found]), found


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class FitsReader(DataSourceReader):
    """Reads ranges of rows; only the wanted columns are decoded."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.rows, self.names = options["path"], int(options.get("rowsPerPartition", 1_000_000)), schema.names
        self.tests: list[tuple[str, str, object]] = []

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _paths(self.path):
            n = int(_table(path)[0]["NAXIS2"])
            out += [_Rows(path, at, min(self.rows, n - at)) for at in range(0, n, self.rows)]
        return out or [_Rows("", 0, 0)]

    def _kept(self, block: np.ndarray, columns: dict[str, _Column]) -> np.ndarray:
        keep = np.ones(len(block), bool)
        for name, kind, value in self.tests:
            c = columns[name]
            x = block[c.field]
            known = np.ones(len(x), bool) if c.null is None else x != c.null
            v = c.values(x)
            nan = v != v  # Spark's order: NaN is above all numbers
            test = {"=": lambda: v == value, ">": lambda: (v > value) | nan, ">=": lambda: (v >= value) | nan, "<": lambda: v < value, "<=": lambda: v <= value, "in": lambda: np.isin(v, list(value or ())), "known": lambda: known}[kind]()
            keep &= test & known
        return keep

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        cards, data = _table(partition.path)
        row, found = _columns(cards)
        columns = {c.name: c for c in found}
        with _open(partition.path) as file:
            for at in range(partition.first, partition.first + partition.count, 50_000):
                count = min(50_000, partition.first + partition.count - at)
                file.seek(data + at * row.itemsize)
                block = np.frombuffer(file.read(count * row.itemsize), dtype=row)
                if self.tests:
                    block = block[self._kept(block, columns)]
                if len(block):
                    yield pa.RecordBatch.from_arrays([columns[n].array(block) for n in self.names], names=self.names)


class FilteringReader(FitsReader):
    """Comparisons of single numbers and tests for null are applied to the packed rows, before anything is decoded."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        paths = _paths(self.path)
        plain = {c.name for c in (_columns(_table(paths[0])[0])[1] if paths else []) if c.repeat == 1 and c.kind in ("int", "long", "double")}
        kinds = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<=", D.In: "in", D.IsNotNull: "known"}
        for f in filters:
            column, value = ".".join(f.attribute) if hasattr(f, "attribute") else "", getattr(f, "value", None)
            numbers = value if isinstance(f, D.In) else (value,)
            # NaN has an order of its own in Spark
            fits = type(f) in kinds and column in plain and (isinstance(f, D.IsNotNull) or all(isinstance(v, (int, float)) and not isinstance(v, bool) and v == v for v in numbers))
            if fits:
                self.tests.append((column, kinds[type(f)], value))
            else:
                yield f


# The codes that columns are written with.
_WRITTEN = {"boolean": "L", "tinyint": "I", "smallint": "I", "int": "J", "bigint": "K", "float": "E", "double": "D"}
#: What stands for a null integer in a written table.
NULLS = {"I": -(2**15), "J": -(2**31), "K": -(2**63)}


def _card(key: str, value: object) -> str:
    text = f"'{value}'" if isinstance(value, str) else "T" if value is True else str(value)
    return f"{key:<8}= {text if isinstance(value, str) else text.rjust(20)}".ljust(_CARD)


def _blocks(data: bytes, fill: bytes) -> bytes:
    return data + fill * (-len(data) % _BLOCK)


def _head(cards: list[str]) -> bytes:
    return _blocks("".join([*cards, "END".ljust(_CARD)]).encode("ascii"), b" ")


class FitsWriter(DataSourceArrowWriter):
    """Each task writes files of at most rowsPerFile rows under other names and renames them when they are whole.

    Numbers and flags, and texts of ASCII, whose column is as wide as the longest one of its file. Null integers are
    marked by TNULL, null fractions are NaN, null texts empty.
    """

    def __init__(self, options: dict, schema: StructType):
        self.path, self.most = options["path"], int(options.get("rowsPerFile", 1_000_000))
        self.kinds = {f.name: f.dataType.simpleString() for f in schema}
        if odd := [n for n, k in self.kinds.items() if k not in _WRITTEN and k != "string"]:
            raise ValueError(f"columns that a FITS table can't hold: {', '.join(odd)}")

    def _packed(self, name: str, x: pa.ChunkedArray) -> tuple[str, str, np.ndarray]:
        kind = self.kinds[name]
        if kind == "string":
            texts = np.array([(v or "").encode("ascii", "replace") for v in x.to_pylist()] or [b""], "S")[: len(x)]
            width = max(1, texts.dtype.itemsize)
            return f"{width}A", f"S{width}", texts
        code = _WRITTEN[kind]
        raw = _CODES[code][0]
        if code == "L":
            return "L", "S1", np.array([b"\0" if v is None else b"T" if v else b"F" for v in x.to_pylist()], "S1")
        return code, raw, x.fill_null(NULLS[code] if code in NULLS else math.nan).to_numpy().astype(raw)

    def _file(self, table: pa.Table) -> bytes:
        packed = {n: self._packed(n, table[n]) for n in self.kinds}
        rows = np.zeros(len(table), np.dtype([(f"f{i}", p[1]) for i, p in enumerate(packed.values())]))
        cards = []
        for i, (name, (form, _, values)) in enumerate(packed.items()):
            rows[f"f{i}"] = values
            cards += [_card(f"TTYPE{i + 1}", name), _card(f"TFORM{i + 1}", form)] + ([_card(f"TNULL{i + 1}", NULLS[form])] if form in NULLS else [])
        first = _head([_card("SIMPLE", True), _card("BITPIX", 8), _card("NAXIS", 0), _card("EXTEND", True)])
        head = _head([_card("XTENSION", "BINTABLE"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", rows.dtype.itemsize), _card("NAXIS2", len(rows)), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", len(packed)), *cards])
        return first + head + _blocks(rows.tobytes(), b"\0")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        held, done = [], 0

        def put(batches: list[pa.RecordBatch]) -> None:
            name = uuid.uuid4().hex
            with store.open_output_stream(f"{folder}/.{name}") as out:
                out.write(self._file(pa.Table.from_batches(batches)))
            store.move(f"{folder}/.{name}", f"{folder}/part-{name}.fits")

        for batch in iterator:
            while len(batch):
                room = self.most - sum(map(len, held))
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(map(len, held)) == self.most:
                    put(held)
                    held, done = [], done + 1
        if held:
            put(held)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        """Files are whole once they have their names."""

    def abort(self, messages: list) -> None:
        """Files of tasks that ended stay."""


class FitsSource(DataSource):
    """spark.dataSource.register(FitsSource); spark.read.format("fits").load(path) of a file or of a folder of files of one
    shape. Option columns (names by commas): only these are decoded. Undefined fractions stay NaN: use schema.clean.
    Scaled integers and undefined ones (TSCAL, TZERO, TNULL) are understood; variable-length columns are not.
    Option pushFilters: filters reach the reader, which the session has to allow (spark.sql.python.filterPushdown.enabled);
    load sees to both.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        paths = _paths(self.options["path"])
        if not paths:
            raise ValueError(f"no FITS file in {self.options['path']}")
        _, columns = _columns(_table(paths[0])[0])
        wanted = [n.strip() for n in self.options["columns"].split(",")] if "columns" in self.options else [c.name for c in columns]
        known = {c.name: c for c in columns}
        if gone := [n for n in wanted if n not in known]:
            raise ValueError(f"missing columns: {', '.join(gone)}")
        return ", ".join(f"`{n}` {known[n].spark}" for n in wanted)

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteringReader if self.options.get("pushFilters", "false").lower() == "true" else FitsReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FitsWriter(self.options, schema)


def load(spark: SparkSession, path: str, columns: Sequence[str] = (), rows_per_partition: int = 1_000_000) -> DataFrame:
    """A FITS file or a folder of them, read with filters if the session lets data sources have them."""
    spark.dataSource.register(FitsSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("fits").option("pushFilters", push).option("rowsPerPartition", rows_per_partition)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def save(rows: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Adds `rows` to a folder of FITS tables."""
    rows.sparkSession.dataSource.register(FitsSource)
    rows.write.format("fits").mode("append").option("rowsPerFile", rows_per_file).save(path)
