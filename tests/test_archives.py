"""Resumable pulls and FITS tables: restarts, caps, filters while reading, scaled and undefined values."""

import os
import sqlite3
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skycat.sources import archive, fits

SCHEMA = "source_id long, random_index long, g double, name string"


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "stars.db")
    with sqlite3.connect(path) as db:
        db.execute("create table stars (source_id integer, random_index integer, g real, name text)")
        rows = [(i, i * 7919 % 1000, i / 8, f"s{i}" if i % 3 else None) for i in range(900) if not 300 <= i * 7919 % 1000 < 400]
        db.executemany("insert into stars values (?, ?, ?, ?)", rows)
    return path, rows


def asked(log: str) -> list[int]:
    return sorted(int(x) for f in os.listdir(log) for x in open(f"{log}/{f}").read().split())


class Watched:
    """A connection that notes each range's first place, and fails once for the range at 500."""

    def __init__(self, path: str):
        self.log, self.db = f"{path}.log", sqlite3.connect(path)

    def cursor(self):
        return self

    def execute(self, sql, values):
        with open(f"{self.log}/{os.getpid()}-{values[0]}-{os.urandom(4).hex()}", "w") as f:
            f.write(f"{values[0]} ")
        if values[0] == 500 and not os.path.exists(f"{self.log}.failed"):
            open(f"{self.log}.failed", "w").close()
            raise sqlite3.OperationalError("the archive went away")
        self.rows = self.db.execute(sql, values)

    def fetchmany(self, n):
        return self.rows.fetchmany(n)

    def close(self):
        self.db.close()


def watched(path: str):
    return Watched(path)


@pytest.mark.parametrize("cap", [None, 40])
def test_pull_goes_on_where_it_stopped(spark, database, tmp_path, cap):
    import shutil

    path, rows = str(tmp_path / "stars.db"), database[1]
    shutil.copy(database[0], path)
    os.mkdir(f"{path}.log")
    out = str(tmp_path / "out")
    args = (spark, out, SCHEMA, path, "stars", "random_index", 1000, 10, cap, "tests.test_archives:watched")
    with pytest.raises(Exception, match="went away"):
        archive.pull(*args)
    done = None
    while done != (done := (archive.finished(out), asked(f"{path}.log"))):
        time.sleep(3)  # tasks beside the failing one may still end
    done = done[0]
    assert 5 not in done and len(done) < 10
    before = asked(f"{path}.log")
    assert archive.pull(*args) == sorted(set(range(10)) - done)
    again = asked(f"{path}.log")
    for x in before:
        again.remove(x)
    assert again == [100 * i for i in sorted(set(range(10)) - done)]
    got = archive.pulled(spark, out, SCHEMA)
    wanted = {}
    for r in sorted(rows, key=lambda r: r[1]):
        wanted.setdefault(r[1] // 100, []).append(r)
    wanted = [(*r, i) for i, some in wanted.items() for r in some[:cap]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)
    # a range without rows is finished too
    assert archive.finished(out) == set(range(10)) and archive.pull(*args) == []
    assert pq.read_metadata(f"{out}/range-000003.parquet").num_rows == 0


def test_pull_tries_again(spark, database, tmp_path):
    import shutil

    path, waits = str(tmp_path / "stars.db"), []
    shutil.copy(database[0], path)
    os.mkdir(f"{path}.log")
    runs = archive.pull_or_keep(spark, str(tmp_path / "out"), SCHEMA, path, "stars", "random_index", 1000, 10, connect="tests.test_archives:watched", wait=waits.append)
    assert runs == 2 and waits == [1] and archive.pulled(spark, str(tmp_path / "out"), SCHEMA).count() == len(database[1])


def card(key, value):
    return f"{key:<8}= {value}".ljust(80)


def fits_bytes(row, data, columns):
    block = lambda cards: "".join([*cards, "END".ljust(80)]).ljust(-(-80 * (len(cards) + 1) // 2880) * 2880).encode()
    head = [card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", row.itemsize), card("NAXIS2", len(data)), card("TFIELDS", len(columns))]
    for i, c in enumerate(columns, 1):
        head += [card(f"{k}{i}", f"'{v}'" if isinstance(v, str) else v) for k, v in c.items()]
    return block([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0)]) + block(head) + data.tobytes()


@pytest.fixture()
def scaled(spark, tmp_path):
    """Unsigned, scaled and undefined integers, logical arrays."""
    row = np.dtype([("u", ">i2"), ("s", ">i4"), ("n", ">i4"), ("k", ">i8"), ("x", ">f8"), ("v", ">i2", (2,)), ("f", "S1", (2,))])
    data = np.zeros(6, row)
    data["u"], data["s"], data["n"], data["k"] = [-32768, -1, 0, 1, 2, 32767], np.arange(6) * 10, [1, -99, 3, -99, 5, 6], [-(2**63), 0, 1, 2, 3, 2**63 - 1]
    data["x"], data["v"], data["f"] = [0.5, np.nan, 2.5, 3.5, np.nan, 5.5], [[i, 7] for i in range(6)], [[b"T", b"F"]] * 5 + [[b"\0", b"T"]]
    columns = [{"TTYPE": "u", "TFORM": "I", "TZERO": 32768}, {"TTYPE": "s", "TFORM": "J", "TSCAL": 0.5, "TZERO": 1.0}, {"TTYPE": "n", "TFORM": "J", "TNULL": -99}, {"TTYPE": "k", "TFORM": "K", "TZERO": 2**63}, {"TTYPE": "x", "TFORM": "D"}, {"TTYPE": "v", "TFORM": "2I", "TNULL": 7}, {"TTYPE": "f", "TFORM": "2L"}]
    path = tmp_path / "t.fits"
    path.write_bytes(fits_bytes(row, data, columns))
    spark.dataSource.register(fits.FitsSource)
    return str(path)


def test_scaled_and_undefined_values(spark, scaled):
    rows = spark.read.format("fits").option("rowsPerPartition", 4).load(scaled)
    assert dict(rows.dtypes) == {"u": "bigint", "s": "double", "n": "int", "k": "decimal(20,0)", "x": "double", "v": "array<int>", "f": "array<boolean>"}
    got = rows.orderBy("s").collect()
    assert [r.u for r in got] == [0, 32767, 32768, 32769, 32770, 65535] and [r.s for r in got] == [1.0, 6.0, 11.0, 16.0, 21.0, 26.0]
    assert [r.n for r in got] == [1, None, 3, None, 5, 6] and [int(r.k) for r in got] == [0, 2**63, 2**63 + 1, 2**63 + 2, 2**63 + 3, 2**64 - 1]
    assert [r.v for r in got] == [[i, None] for i in range(6)] and got[5].f == [None, True] and got[0].f == [True, False]
    some = spark.read.format("fits").option("columns", "x, u").load(scaled)
    assert some.columns == ["x", "u"] and some.count() == 6
    with pytest.raises(Exception, match="missing columns: zz"):
        spark.read.format("fits").option("columns", "zz").load(scaled)


@pytest.mark.parametrize("test", ["u > 32767", "u >= 32769 and n is not null", "n = 3", "n <> 3", "x > 2.5", "x <= 3.5", "x = double('NaN')", "n in (1, 6, 99)", "s < 16 or u = 65535", "k > 5", "x is null", "not (x < 3)", "size(v) = 2", "f[0]"])
def test_filters_give_the_same_rows(spark, scaled, test):
    whole = spark.read.format("fits").load(scaled)
    wanted = spark.createDataFrame(whole.collect(), whole.schema).filter(test)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        got = fits.load(spark, scaled, rows_per_partition=4).filter(test)
        assert sorted(r.s for r in got.collect()) == sorted(r.s for r in wanted.collect())
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_are_taken_by_the_reader(spark):
    D = fits.D
    shape = spark.createDataFrame([], "x double, n int").schema
    reader = fits.FilteringReader({"path": "x"}, shape)
    cards = {"TFIELDS": "2", "TTYPE1": "x", "TFORM1": "D", "TTYPE2": "n", "TFORM2": "J", "TNULL2": "-1"}
    old = fits._paths, fits._table
    fits._paths, fits._table = lambda p: [p], lambda p: (cards, 0)
    try:
        left = list(reader.pushFilters([D.GreaterThan(("x",), 1.5), D.IsNotNull(("n",)), D.EqualTo(("x",), float("nan")), D.StringContains(("s",), "a"), D.In(("n",), (1, 2))]))
    finally:
        fits._paths, fits._table = old
    assert [type(f) for f in left] == [D.EqualTo, D.StringContains] and len(reader.tests) == 3


def test_written_tables_come_back(spark, tmp_path):
    spark.dataSource.register(fits.FitsSource)
    rows = spark.range(1000).selectExpr("id", "cast(if(id % 5 = 0, null, id) as int) as i", "cast(id as smallint) as h", "if(id % 7 = 0, null, id / 3e0) as d", "cast(id as float) as e", "if(id % 11 = 0, null, id % 2 = 0) as b", "concat('star ', id) as s")
    path = str(tmp_path / "out")
    fits.save(rows.repartition(3), path, 150)
    assert len([f for f in os.listdir(path) if f.endswith(".fits")]) >= 7
    back = spark.read.format("fits").load(path).select("id", "i", "h", F.nanvl("d", F.lit(None)).alias("d"), "e", "b", "s")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    with pytest.raises(Exception, match="can't hold"):
        spark.range(1).selectExpr("array(id) as a").write.format("fits").mode("append").save(str(tmp_path / "bad"))
