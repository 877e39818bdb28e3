"""Tables of which readers see one whole version at a time: files are written aside, one small manifest publishes them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Where the manifests are, one for each version, named by its number.
MANIFESTS = "_versions"


@dataclass(frozen=True)
class Version:
    """number: from 1. folders: those whose files are the table. mark: how far a stream has come. schema: of the table."""

    number: int
    folders: tuple[str, ...]
    mark: int
    schema: StructType


class Conflict(RuntimeError):
    """Another writer has published the version that this one wanted to."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, base: str) -> list[int]:
    at, fs = _files(spark, f"{base}/{MANIFESTS}")
    if not fs.exists(at):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(at))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())


def version(spark: SparkSession, base: str, number: int | None = None) -> Version | None:
    """A version of a table, the last one unless told; None if there is none."""
    known = _numbers(spark, base)
    if not known:
        return None
    if number is not None and number not in known:
        raise ValueError(f"no version {number}")
    at, fs = _files(spark, f"{base}/{MANIFESTS}/{known[-1] if number is None else number:012d}.json")
    with_stream = fs.open(at)
    try:
        body = json.loads(bytes(with_stream.readAllBytes()).decode())
    finally:
        with_stream.close()
    return Version(body["number"], tuple(body["folders"]), body["mark"], StructType.fromJson(body["schema"]))


def _commit(spark: SparkSession, base: str, new: Version) -> None:
    """Writes a manifest under another name, then renames it: the rename fails where the number is taken."""
    jvm = spark.sparkContext._jvm
    body = {"number": new.number, "folders": list(new.folders), "mark": new.mark, "schema": json.loads(new.schema.json())}
    aside, fs = _files(spark, f"{base}/{MANIFESTS}/.{uuid.uuid4().hex}")
    target, _ = _files(spark, f"{base}/{MANIFESTS}/{new.number:012d}.json")
    out = fs.create(aside, False)
    try:
        out.write(json.dumps(body).encode())
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        fs.delete(aside, False)
        if fs.exists(target):
            raise Conflict(f"version {new.number} of {base} is there already") from error
        raise


def replace(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes `rows` beside a plain folder and swaps the two when the job is done. A failing job changes nothing; a swap
    that stops half-way leaves both folders, the old one under the path or as path.old-*.
    """
    spark, tag = rows.sparkSession, uuid.uuid4().hex
    rows.write.format(kind).save(f"{path}.new-{tag}")
    at, fs = _files(spark, path)
    new, old = _files(spark, f"{path}.new-{tag}")[0], _files(spark, f"{path}.old-{tag}")[0]
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise RuntimeError(f"{path} can't be moved")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise RuntimeError(f"{path}.new-{tag} can't be moved")
    if had:
        fs.delete(old, True)


def publish(rows: DataFrame, base: str, mode: str = "overwrite", mark: int | None = None, tries: int = 5) -> Version:
    """Makes `rows` the next version of a table, or adds them to it (mode append); errorifexists and ignore are as in Spark.

    The rows are written to a folder that no version names yet; a job that fails leaves only that behind, and readers keep
    the version they have. mark: a number that grows with each version, such as a stream's batch; where the last version
    has it already, nothing is done, so that a repeated batch counts once. Appends that meet another writer are tried
    again on its version; a replacement raises Conflict.
    """
    spark, last = rows.sparkSession, version(rows.sparkSession, base)
    if mode not in ("overwrite", "append", "errorifexists", "ignore"):
        raise ValueError(f"unknown mode: {mode}")
    if last is not None and mode == "errorifexists":
        raise FileExistsError(base)
    if last is not None and (mode == "ignore" or (mark is not None and mark <= last.mark)):
        return last
    if last is not None and mode == "append" and [(f.name, f.dataType) for f in last.schema] != [(f.name, f.dataType) for f in rows.schema]:
        raise ValueError("the rows' schema isn't that of the table")
    folder = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/{folder}")
    for left in range(tries, 0, -1):
        before = last.folders if last is not None and mode == "append" else ()
        new = Version((last.number if last else 0) + 1, (*before, folder), last.mark if last and mark is None else -1 if mark is None else mark, rows.schema)
        try:
            _commit(spark, base, new)
            return new
        except Conflict:
            last = version(spark, base)
            if left == 1 or mode != "append" or (mark is not None and mark <= last.mark):
                raise
    raise Conflict(base)


def read(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """The rows of a version, the last one unless told."""
    found = version(spark, base, number)
    if found is None:
        raise FileNotFoundError(f"no version of {base}")
    return spark.read.schema(found.schema).parquet(*(f"{base}/{f}" for f in found.folders))


def compact(spark: SparkSession, base: str, merge: Callable[[DataFrame], DataFrame], most: int = 16) -> Version:
    """Where the last version has over `most` folders, `merge` of its rows becomes the next one, with the same mark."""
    last = version(spark, base)
    if last is None or len(last.folders) <= most:
        return last
    folder = f"data-{uuid.uuid4().hex}"
    merged = merge(read(spark, base)).select(*last.schema.names)
    merged.write.parquet(f"{base}/{folder}")
    new = Version(last.number + 1, (folder,), last.mark, last.schema)
    _commit(spark, base, new)
    return new


def vacuum(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Deletes the manifests before the last `keep` and all folders that none of those names; returns how many went.

    Only for a time when nobody writes or reads older versions.
    """
    known = _numbers(spark, base)
    kept = {f for n in known[-keep:] for f in version(spark, base, n).folders}
    at, fs = _files(spark, base)
    gone = 0
    for n in known[:-keep]:
        gone += bool(fs.delete(_files(spark, f"{base}/{MANIFESTS}/{n:012d}.json")[0], False))
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name.startswith("data-") and name not in kept:
            gone += bool(fs.delete(s.getPath(), True))
    return gone
