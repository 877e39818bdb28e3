"""Versioned tables and the additive histogram: failures, races, repeated batches and merges."""

import pytest
from pyspark.sql import functions as F

from skycat.operators import grid
from skycat.sources import sinks, versions
from skycat.streaming import ingest


def ids(rows) -> list[int]:
    return sorted(r.id for r in rows.collect())


def failing(spark):
    return spark.range(5).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")).alias("id"))


def test_publish_and_read(spark, tmp_path):
    base = str(tmp_path / "t")
    assert versions.version(spark, base) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, base)
    assert versions.publish(spark.range(3), base).number == 1
    assert versions.publish(spark.range(3, 5), base, "append").folders.__len__() == 2
    assert ids(versions.read(spark, base)) == [0, 1, 2, 3, 4] and ids(versions.read(spark, base, 1)) == [0, 1, 2]
    with pytest.raises(FileExistsError):
        versions.publish(spark.range(1), base, "errorifexists")
    assert versions.publish(spark.range(1), base, "ignore").number == 2
    with pytest.raises(ValueError):
        versions.publish(spark.range(1).selectExpr("cast(id as int) as id"), base, "append")
    assert versions.publish(spark.range(0), base).number == 3 and ids(versions.read(spark, base)) == []
    assert versions.read(spark, base).dtypes == spark.range(0).dtypes
    with pytest.raises(ValueError):
        versions.read(spark, base, 9)
    assert versions.vacuum(spark, base, 1) == 4
    assert ids(versions.read(spark, base)) == []


def test_a_failing_job_leaves_the_old_version(spark, tmp_path):
    base, plain = str(tmp_path / "t"), str(tmp_path / "p")
    versions.publish(spark.range(3), base)
    sinks.save(spark.range(3), plain)
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="stop"):
            versions.publish(failing(spark), base, mode)
    with pytest.raises(Exception, match="stop"):
        sinks.save(failing(spark), plain, "overwrite")
    assert ids(versions.read(spark, base)) == ids(spark.read.parquet(plain)) == [0, 1, 2]
    sinks.save(spark.range(7), plain, "overwrite")
    sinks.save(spark.range(2), str(tmp_path / "new"), "overwrite")
    assert spark.read.parquet(plain).count() == 7 and spark.read.parquet(str(tmp_path / "new")).count() == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    """The number that both want is given once; an append goes on the other's version, a replacement says so."""
    base = str(tmp_path / "t")
    versions.publish(spark.range(3), base)
    real = versions.version

    def stale(spark, base, number=None, calls=[]):
        calls.append(1)
        return real(spark, base, 1) if len(calls) == 1 else real(spark, base, number)

    versions.publish(spark.range(10, 12), base, "append")
    monkeypatch.setattr(versions, "version", stale)
    assert versions.publish(spark.range(20, 22), base, "append").number == 3
    monkeypatch.setattr(versions, "version", lambda s, b, n=None: real(s, b, 1))
    with pytest.raises(versions.Conflict):
        versions.publish(spark.range(1), base)
    monkeypatch.undo()
    assert ids(versions.read(spark, base)) == [0, 1, 2, 10, 11, 20, 21]


SCHEMA = "l double, b double, phot_g_mean_mag double, teff_gspphot double, bp_rp double"


def chunk(spark, i: int):
    rows = [(float(7 * i + k) % 360, float(k * 9 - 80), 8.0 + k / 4, None, 0.5) for k in range(15)] + [(None, 0.0, 9.0, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def same(spark, target: str, folder: str) -> bool:
    tidy = lambda df: sorted((r.x, r.y, round(r.flux, 12), round(r.temp_flux, 9), r.n) for r in df.collect())
    return tidy(ingest.read_histogram(spark, target)) == tidy(grid.sky_histogram(spark.read.schema(SCHEMA).parquet(folder), 16, 8))


def test_histogram_is_exact_after_a_kill(spark, tmp_path, monkeypatch):
    """Stopped before the rows of a batch are published, and between that and the stream's own commit."""
    folder, target, check = (str(tmp_path / n) for n in ("in", "hist", "check"))

    def run(most=3):
        stream = ingest.chunks(spark, folder, chunk(spark, 0).schema, 1)
        ingest.keep_histogram(stream, 16, 8, target, check, most).awaitTermination()

    chunk(spark, 0).coalesce(1).write.parquet(folder)
    run()
    assert same(spark, target, folder)
    real_commit, real_compact = versions._commit, versions.compact
    for name in ("_commit", "compact"):
        chunk(spark, 1 if name == "_commit" else 2).coalesce(1).write.mode("append").parquet(folder)

        def stop(*args, **kwargs):
            raise RuntimeError("killed")

        monkeypatch.setattr(versions, name, stop)
        before = versions.version(spark, target).mark
        with pytest.raises(Exception, match="killed"):
            run()
        # the readers' version is a whole one, with the batch or without it
        assert versions.version(spark, target).mark == before + (name == "compact")
        monkeypatch.setattr(versions, "_commit", real_commit)
        monkeypatch.setattr(versions, "compact", real_compact)
        run()
        assert same(spark, target, folder)
    for i in range(3, 7):
        chunk(spark, i).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert same(spark, target, folder) and len(versions.version(spark, target).folders) <= 3
    assert versions.vacuum(spark, target, 1) > 0 and same(spark, target, folder)
