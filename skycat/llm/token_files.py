"""Writing and reading the token ids of a corpus as wavelet-matrix shards."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wavelet
from .common import cut, narrow, partitions, small


def _put(uri: str, name: str, data: bytes) -> None:
    """Writes one file whole: under another name first, so that a lost or repeated task leaves no part of it."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(part := f"{root}/.{name}.{uuid.uuid4().hex}") as f:
        f.write(data)
    store.move(part, f"{root}/{name}")


def _make(uri: str) -> None:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)


def write_token_shards(
    docs: DataFrame,
    folder: str,
    encoder: Callable[[], Callable[[str | None], bytes]],
    end_id: int,
    bits: int = 16,
    shard_tokens: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes the ids of every document, in ascending doc_id order, as files `folder`/ids-<range>-<part>.wvm.

    One shuffle by doc_id range; a task streams its sorted range and closes a file at `shard_tokens`, so memory is
    bounded by that and one document. Files are put in place whole and their names depend on the range alone, so a
    task that runs again writes the same file. folder: a URI in the folder shared by driver and executors.

    Null doc_id: before all others. Repeated doc_ids: by text. Null or empty text: the end id alone. An id that needs
    more than `bits` bits is an error.
    """
    _make(folder)
    ordered = narrow(docs, doc_id=id_col, text=text_col).repartitionByRange(partitions(docs.sparkSession), F.asc_nulls_first("doc_id"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def run(batches):
        encode, end, pid = encoder(), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        keys, parts, held, number = [], [], 0, 0
        written = []

        def close():
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            _put(folder, f"ids-{pid:08d}-{number:06d}.wvm", wavelet.dump(keys, [len(p) // 4 for p in parts], ids, bits))
            written.append(len(ids))

        for batch in batches:
            for key, text in zip(batch[0].to_pylist(), batch[1]):
                keys.append(key)
                parts.append(encode(text.as_py()) + end)
                held += len(parts[-1]) // 4
                if held >= shard_tokens:
                    close()
                    keys, parts, held, number = [], [], 0, number + 1
        if keys:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([sum(written)], pa.int64()), pa.array([len(written)], pa.int64())], names=["tokens", "files"])

    ordered.mapInArrow(run, "tokens long, files long").agg(F.sum("tokens"), F.sum("files")).collect()


def read_token_shards(spark: SparkSession, folder: str, count_id: int | None = None) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    with `count_id`, n_counted: how often that id is in the document, by ranks at its two ends.

    An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.wvm").load(folder)

    def run(batches):
        for batch in batches:
            for path, data in zip(batch[0], batch[1]):
                shard = wavelet.load(data.as_py())
                at, view = shard.starts, memoryview(shard.matrix.decode().astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                counted = np.diff(shard.matrix.ranks(-1 if count_id is None else count_id, at))
                columns = [pa.array([path.as_py()] * shard.docs), pa.array(shard.doc_ids, pa.int64()), pa.array(at[:-1]), pa.array(shard.lengths), pa.array(crc, pa.int64()), pa.array(counted)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "doc_id", "at", "n_tokens", "ids_crc32", "n_counted"])

    rows = cut(files.select("path", "content").mapInArrow(run, "path string, doc_id long, at long, n_tokens long, ids_crc32 long, n_counted long"))
    # ids before a file: those of all ranges before its own, one row for each range, and those of its range's files before it
    sizes = rows.groupBy("path").agg(F.sum("n_tokens").alias("tokens")).withColumn("range", F.regexp_extract("path", r"ids-(\d+)-\d+\.wvm$", 1))
    whole = sizes.groupBy("range").agg(F.sum("tokens").alias("tokens"))
    sum_before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = whole.select("range", sum_before(Window.orderBy("range")).alias("base"))
    starts = sizes.join(F.broadcast(whole), "range").select("path", (F.col("base") + sum_before(Window.partitionBy("range").orderBy("path"))).alias("base"))
    kept = ["doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *([] if count_id is None else ["n_counted"])]
    return rows.join(small(cut(starts)), "path").select(*kept)


def _open(path: str) -> wavelet.Shard:
    """Called in a task: a shard whose file is read in ranges."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
    file = store.open_input_file(name)
    return wavelet.Shard(lambda at, n: file.read_at(n, at))


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path")


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the ids is in all files, by two ranks a file; no plane is read whole."""

    def run(batches):
        for batch in batches:
            for path in batch[0].to_pylist():
                matrix = _open(path).matrix
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return _paths(spark, folder).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_occurrences(spark: SparkSession, folder: str, tokens: list[int], step: int = 100_000) -> DataFrame:
    """(token, doc_id, at): every place of the ids, from 0 in its document, by selects."""

    def run(batches):
        for batch in batches:
            for path in batch[0].to_pylist():
                shard = _open(path)
                for token in tokens:
                    total = shard.matrix.count(token)
                    for k in range(0, total, step):
                        where = shard.matrix.selects(token, np.arange(k, min(total, k + step)))
                        doc = np.searchsorted(shard.starts, where, side="right") - 1
                        columns = [pa.array(np.full(len(where), token)), pa.array([shard.doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array(where - shard.starts[doc])]
                        yield pa.RecordBatch.from_arrays(columns, names=["token", "doc_id", "at"])

    return _paths(spark, folder).mapInArrow(run, "token long, doc_id long, at long")


def tokens_at(spark: SparkSession, folder: str, wanted: DataFrame, id_col: str = "doc_id", at_col: str = "at") -> DataFrame:
    """(doc_id, at, token) for the rows of `wanted` (a document's id and a place in it, from 0) that exist.

    The files' document lists say which file has a document; each file then gets its places, and answers by access.
    Null ids or places find nothing. Rows of a repeated doc_id find the place in each of its documents.
    """

    def held(batches):
        for batch in batches:
            for path in batch[0].to_pylist():
                shard = _open(path)
                yield pa.RecordBatch.from_arrays([pa.array([path] * shard.docs), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1]), pa.array(shard.lengths)], names=["path", "doc_id", "first", "size"])

    places = narrow(wanted, doc_id=id_col, at=at_col).filter("doc_id is not null and at >= 0").distinct()
    found = _paths(spark, folder).mapInArrow(held, "path string, doc_id long, first long, size long").join(places, "doc_id").filter("at < size")
    found = found.select("path", "doc_id", "at", (F.col("first") + F.col("at")).alias("where"))
    dealt = found.repartition(partitions(spark), "path").sortWithinPartitions("path")

    def run(batches):
        path, matrix = None, None
        for batch in batches:
            names, where = np.array(batch[0].to_pylist()), batch[3].to_numpy()
            for a, b in zip(*_runs(names)):
                if names[a] != path:
                    path = names[a]
                    matrix = _open(str(path)).matrix
                yield pa.RecordBatch.from_arrays([batch[1].slice(a, b - a), batch[2].slice(a, b - a), pa.array(matrix.access(where[a:b]))], names=["doc_id", "at", "token"])

    return dealt.mapInArrow(run, "doc_id long, at long, token long")


def _runs(names: np.ndarray) -> tuple[list[int], list[int]]:
    edges = (np.flatnonzero(names[1:] != names[:-1]) + 1).tolist()
    return [0, *edges], [*edges, len(names)]
