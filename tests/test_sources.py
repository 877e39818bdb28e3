"""Readers, writers and streams on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycat.operators import grid
from skycat.schema import contract_report
from skycat.sources import fits, sinks, tables
from skycat.streaming import ingest


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("﻿GLON\tGLAT\tflux\n1\t2\t3\nx\t2\t3\n4\t\t5\n", encoding="utf-8")
    rows = tables.read_delimited(spark, str(tmp_path / "a.tsv"), ("l", "glon"), ("b", "glat"), ("flux",), sep="\t").collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.0, 3.0), (None, None, None), (None, None, None)]


def test_ecsv(spark, tmp_path):
    (tmp_path / "a.ecsv").write_text("# %ECSV 1.0\n# ---\n# datatype: []\nl b\n1.5 2\n")
    assert tables.read_ecsv(spark, str(tmp_path / "a.ecsv")).first().asDict() == {"l": "1.5", "b": "2"}


def test_healpix(spark):
    implicit = spark.createDataFrame([(0, [1.0, -1.6375e30]), (1, [3.0, 4.0])], "p long, v array<double>")
    assert [tuple(r) for r in tables.healpix_values(implicit, "v", position="p", width=2).orderBy("pix").collect()] == [(0, 1.0), (1, None), (2, 3.0), (3, 4.0)]
    explicit = spark.createDataFrame([(5, 1.0), (48, 2.0), (-1, 3.0)], "pixel long, v double")
    assert [tuple(r) for r in tables.healpix_values(explicit, "v", pixel="pixel", nside=2).collect()] == [(5, 1.0)]
    assert tables.nside_of(48) == 2
    with pytest.raises(ValueError):
        tables.nside_of(50)


def test_star_list_and_ranges(spark):
    rows = tables.star_list(spark.createDataFrame([(1.0, 2.0, None)], "GLON double, b double, mag double"))
    assert tuple(rows.first()) == (1.0, 2.0, 12.0, 5800.0)
    assert tables.ranges(10, 3) == [(0, 3), (3, 6), (6, 10)]
    done = spark.createDataFrame([(0,), (2,)], "range_id int")
    assert tables.unfinished(range(4), done) == [1, 3] and tables.unfinished(range(2), None) == [0, 1]
    assert tables.kind_of("x/Map.FITS.gz") == "fits"


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).withColumn("x", F.col("id") % 7)
    assert tables.fingerprint(a).first() == tables.fingerprint(a.orderBy(F.desc("id"))).first()
    assert tables.fingerprint(a).first() != tables.fingerprint(a.withColumn("x", F.col("x") + 1)).first()


def test_fits(spark, tmp_path):
    def block(cards):
        text = "".join(f"{c:<80}" for c in [*cards, "END"])
        return text.ljust(-(-len(text) // 2880) * 2880).encode()

    row = np.dtype([("id", ">i8"), ("l", ">f8"), ("g", ">f4"), ("ok", "S1"), ("name", "S5"), ("v", ">i2", (2,))])
    data = np.zeros(7, row)
    data["id"], data["l"], data["g"], data["ok"], data["name"] = np.arange(7), np.arange(7) * 1.5, np.nan, b"T", b"star "
    data["v"] = [[1, 2]] * 7
    cards = ["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {row.itemsize}", "NAXIS2  = 7 / rows", "TFIELDS = 6"]
    for i, (n, f) in enumerate((("source_id", "K"), ("l", "1D"), ("g", "E"), ("ok", "L"), ("name", "5A"), ("v", "2I")), 1):
        cards += [f"TTYPE{i}  = '{n}'", f"TFORM{i}  = '{f}'"]
    path = tmp_path / "t.fits"
    path.write_bytes(block(["SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0"]) + block(cards) + data.tobytes())
    spark.dataSource.register(fits.FitsSource)
    rows = spark.read.format("fits").option("rowsPerPartition", 3).load(str(path))
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == 7
    first = rows.orderBy("source_id").collect()[2]
    assert (first.source_id, first.l, first.ok, first.name, first.v) == (2, 3.0, True, "star", [1, 2]) and first.g != first.g


def test_map_batch(spark, tmp_path):
    specs = [{"name": "Good One", "n": 3}, {"name": "bad"}, {"name": "off", "enabled": False}, {"id": "last", "n": 1}]
    rows = sinks.run_maps(spark, specs, lambda s: spark.range(s["n"]), str(tmp_path))
    assert {(r.id, r.rows, r.error is None) for r in rows.collect()} == {("good-one", 3, True), ("bad", None, False), ("last", 1, True)}
    assert [s["id"] for s in sinks.choose(specs, "2-3, good one")] == ["bad", "last", "good-one"]
    with pytest.raises(ValueError):
        sinks.choose(specs, "9")
    with pytest.raises(ValueError):
        sinks.choose([{"id": "a"}, {"id": "A"}])


def test_save_modes(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.save(spark.range(3), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.save(spark.range(5), path)
    sinks.save(spark.range(5), path, "ignore")
    assert spark.read.parquet(path).count() == 3


def test_stream_resumes(spark, tmp_path):
    chunk = lambda i: spark.createDataFrame([(float(i), 0.0, 10.0, None, 0.5), (None, 0.0, 9.0, None, None)], "l double, b double, phot_g_mean_mag double, teff_gspphot double, bp_rp double")
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for i in range(2):
        chunk(i).write.mode("append").parquet(folder)
        ingest.append_new(ingest.chunks(spark, folder, chunk(0).schema), out, check).awaitTermination()
        assert spark.read.parquet(out).count() == i + 1
    cells = ingest.histogram_stream(ingest.chunks(spark, folder, chunk(0).schema), 8, 4)
    ingest.write_histogram(cells, str(tmp_path / "hist"), str(tmp_path / "check2")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "hist")).collect()))
    assert got == sorted(map(tuple, grid.sky_histogram(spark.read.parquet(folder), 8, 4).collect()))


def test_galactic_positions(spark):
    rows = spark.createDataFrame([(1, 266.405, -28.936), (2, None, None)], "id int, `RA` double, `Dec` double")
    one, none = tables.galactic_positions(rows).orderBy("id").collect()
    assert min(one.l, 360 - one.l) < 0.01 and abs(one.b) < 0.01 and none.l is None and none.b is None
    assert tables.galactic_positions(rows).columns == ["id", "l", "b"]
    plain = spark.createDataFrame([(10.0, 20.0)], "lon double, lat double")
    assert tables.galactic_positions(plain).first() == (10.0, 20.0)
    assert abs(tables.galactic_positions(plain, {"CTYPE1": "RA---CAR"}).first().b - 20.0) > 1
    with pytest.raises(KeyError):
        tables.galactic_positions(spark.createDataFrame([(1.0,)], "ra double"))
    with pytest.raises(ValueError):
        tables.galactic_positions(plain, {"COORDSYS": "Mars"})


def test_contract_report(spark):
    contract = {"id": ("long", 1, 3), "Mag": ("double", None, 2.0), "gone": ("double", None, None)}
    rows = spark.createDataFrame([("1", 1.0), ("x", float("nan")), (None, None), ("4", 3.0), ("4", 3.0)], "ID string, mag double")
    assert [tuple(r) for r in contract_report(rows, contract).collect()] == [("id", True, 5, 1, 1, 2), ("Mag", True, 5, 2, 0, 2), ("gone", False, 5, None, None, None)]
    assert [tuple(r) for r in contract_report(rows.limit(0), contract).collect()] == [("id", True, 0, 0, 0, 0), ("Mag", True, 0, 0, 0, 0), ("gone", False, 0, None, None, None)]
